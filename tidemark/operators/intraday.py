"""Sessions of 5-minute bars, their moves, and the gates that ask whether a signal comes too late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sheets import steps

# A move that is too large, and the larger ones that a strong mismatch allows.
LARGEST = 0.07
BY_MISMATCH = [(">= 7", 0.12), (">= 5", 0.09)]


def minute_bars(ticks: DataFrame, width: str = "5 minutes") -> DataFrame:
    """ticker, bar (its start), open, close from ticks(ticker, ts, seq, price), in the order of (ts, seq)."""
    order = F.struct("ts", "seq")
    rows = ticks.where("price is not null").groupBy("ticker", F.window("ts", width)["start"].alias("bar"))
    return rows.agg(F.min_by("price", order).alias("open"), F.max_by("price", order).alias("close"))


def session_moves(bars: DataFrame, gap: str = "119 minutes") -> DataFrame:
    """ticker, start, last, bars, open, close, move, available: a session is a ticker's bars without a gap of `gap` between them. Its move
    is its last close over its first open; fewer than two bars, or an open of 0 or less, give none."""
    s = bars.groupBy("ticker", F.session_window("bar", gap).alias("w")).agg(F.count("*").alias("bars"), F.min_by("open", "bar").alias("open"), F.max_by("close", "bar").alias("close"), F.max("bar").alias("last"))
    known = (F.col("bars") >= 2) & (F.col("open") > 0)
    move = F.when(known, F.round(F.col("close") / F.col("open") - 1 + 1e-9, 4)).otherwise(0.0)
    return s.select("ticker", F.col("w.start").alias("start"), "last", "bars", "open", "close", move.alias("move"), known.alias("available"))


def day_moves(moves: DataFrame) -> DataFrame:
    """ticker, day, move, available of the last session that began on each day."""
    x = moves.groupBy("ticker", F.to_date("start").alias("day")).agg(F.max_by(F.struct("move", "available"), "start").alias("x"))
    return x.select("ticker", "day", "x.move", "x.available")


def late_signals(signals: DataFrame, moves: DataFrame, largest: float = LARGEST) -> DataFrame:
    """signals(id, ticker, day, direction, mismatch) with the move of their ticker's session, `limit` (by mismatch, `largest` at least),
    `too_late` (moved beyond it either way) and `moved_already` (by more than `largest` in the signal's own direction). Where no move
    is known a signal isn't late."""
    rows = signals.join(day_moves(moves), ["ticker", "day"], "left")
    move = F.when(F.coalesce("available", F.lit(False)), F.col("move")).otherwise(0.0)
    rows = rows.withColumn("move", move).withColumn("limit", F.greatest(F.lit(largest), F.expr(steps("coalesce(mismatch, 0)", BY_MISMATCH, largest))))
    own = F.when(F.col("direction") == "BEARISH", F.col("move") < -largest).otherwise(F.col("move") > largest)
    return rows.select("id", "ticker", "day", "move", "limit", (F.abs("move") > F.col("limit")).alias("too_late"), own.alias("moved_already"))
