"""Exit monitor with a state for each trade: entry, peak, open or closed, and the marks that wait for their turn.

Marks may come in any order up to `delay` late. They wait in the state until the watermark has passed them, and are then judged in the
order of (ts, event_id), so that entry, peak and first exit are those of a batch run over the same marks. Output is append-only:
an `exit` row when a rule ends a trade, and before it an `overdue` row if the day of its holding limit is over without one. Three kinds of
timers drive a trade: the next waiting mark, the end of the holding limit's day, and the expiry of its state. A closed trade stays
known, and takes no more marks, for `expire` days after its last one.

The state holds a trade's marks of the watermark's delay, not its history. All marks of a trade meet in one task, as its order asks."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.columns import rounded_double
from tidemark.functions.sheets import add
from tidemark.operators.lifecycle import HOLD, RULES
from tidemark.sources import adapters
from tidemark.streaming.shared import file_stream, folder

OUT = "trade_id long, kind string, event_id long, reason string, outcome double, peak double, age int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
EPOCH, MS = datetime.datetime(1970, 1, 1), datetime.timedelta(milliseconds=1)


def _ms(ts: datetime.datetime) -> int:
    """Milliseconds of a time, rounded up. Plain datetimes: for each mark, pandas' scalars cost more than its rules."""
    return -((EPOCH - ts) // MS)


def _days(later: datetime.datetime, earlier: datetime.datetime) -> int:
    return later.toordinal() - earlier.toordinal()


class Exits(StatefulProcessor):
    def __init__(self, hold: int, expire: int):
        self.hold, self.expire = hold, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trade = handle.getValueState("trade", "entry timestamp, first double, peak double, last double, closed boolean, overdue boolean, seen timestamp")
        self.waiting = handle.getListState("waiting", "ts timestamp, event_id long, value double, stop double, take double, term_days int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come = [r for pdf in rows for r in pdf[["ts", "event_id", "value", "stop", "take", "term_days"]].itertuples(index=False, name=None)]
        yield from self._advance(key, come, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, come: list[tuple], upto: int) -> Iterator[pd.DataFrame]:
        known = self.trade.get() if self.trade.exists() else None
        entry, first, peak, last, closed, overdue, seen = known or (None, None, None, None, False, False, None)
        rows = [] if closed else sorted([*(tuple(r) for r in (self.waiting.get() if self.waiting.exists() else ())), *((t.to_pydatetime(), *(None if v != v else v for v in r)) for t, *r in come)], key=lambda r: r[:2])
        if come:
            newest = max(r[0] for r in come).to_pydatetime()
            seen = newest if seen is None else max(seen, newest)
        due = [r for r in rows if _ms(r[0]) <= upto]
        left, out = rows[len(due) :], []
        limit = lambda: (entry.toordinal() - EPOCH.toordinal() + self.hold + 1) * DAY_MS
        late = lambda: (key[0], "overdue", None, "holding_limit", last, peak, self.hold)
        for ts, event, value, stop, take, term in due:
            if entry is None:
                entry, first = ts, value
            if not overdue and _ms(ts) >= limit():
                overdue = True
                out.append(late())
            outcome = None if first in (None, 0) or value is None else value / first - 1
            if outcome is not None:
                last, peak = outcome, outcome if peak is None else max(peak, outcome)
            if reason := self._reason(outcome, _days(ts, entry), stop, take, int(term)):
                closed, left = True, []
                out.append((key[0], "exit", int(event), reason, outcome, peak, _days(ts, entry)))
                break
        if entry is not None and not closed and not overdue:
            if upto >= limit():
                overdue = True
                out.append(late())
            else:
                self.handle.registerTimer(limit())
        if left:
            self.handle.registerTimer(_ms(left[0][0]))
        end = _ms(seen) + self.expire * DAY_MS if seen is not None else None
        if end is not None and upto >= end and not left:
            self.trade.clear()
            self.waiting.clear()
        else:
            if end is not None and upto < end:
                self.handle.registerTimer(end)
            self.trade.update((entry, first, peak, last, closed, overdue, seen))
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def _reason(self, outcome: float | None, age: int, stop: float, take: float, term: int) -> str | None:
        if outcome is not None:
            if outcome <= stop:
                return "stop_loss"
            if outcome >= take:
                return "take_profit"
            if term > 0 and term - age <= term * 0.5 and outcome < 0.20:
                return "time_exit"
        return "max_holding_period" if age >= self.hold else None

    def close(self) -> None:
        pass


def exit_states(marks: DataFrame, hold: int = HOLD, delay: str = "2 days", expire: int = 400) -> DataFrame:
    """Rows of OUT from a stream of marks(trade_id, ts, event_id, value)."""
    rows = add(marks.withColumn("ts", F.col("ts").cast("timestamp")), adapters.TERMS, RULES[0]).withColumn("term_days", F.col("term_days").cast("int"))
    rows = rows.select(F.col("trade_id").cast("long").alias("trade_id"), "ts", F.col("event_id").cast("long").alias("event_id"), "value", "stop", "take", "term_days").withWatermark("ts", delay)
    return rows.groupBy("trade_id").transformWithStateInPandas(Exits(hold, expire), OUT, "Append", "EventTime")


def run_appending(result: DataFrame, out: str, state: str) -> None:
    """Run a stream over all that is there, adding its rows to the folder `out`; `state` holds its offsets and states, and a later run
    with the same folders goes on where this one ended."""
    conf = result.sparkSession.conf
    before = conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        result.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set("spark.sql.streaming.stateStore.providerClass", before)


def heartbeat(spark: SparkSession, where: str, ts: datetime.datetime) -> DataFrame:
    """A stream of one mark of no trade (id -1) at that time: it moves the watermark on when nothing else does."""
    spark.createDataFrame([(-1, ts, 0, None)], "trade_id long, ts timestamp, event_id long, value double").write.mode("overwrite").parquet(where)
    return file_stream(spark, where)


def stream_exit_states(spark: SparkSession, sf_dir: str, hold: int = 14) -> DataFrame:
    """The events table as a stream of marks, and a heartbeat three days after its last mark, run to the end."""
    marks = file_stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("trade_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    if last is not None:
        marks = marks.unionByName(heartbeat(spark, folder(spark, "heartbeat"), last + datetime.timedelta(days=3)))
    out = folder(spark, "exit-states")
    run_appending(exit_states(marks, hold), out, folder(spark, "exit-states-state"))
    rows = spark.read.schema(OUT).parquet(out)
    return rows.select("trade_id", "kind", "event_id", "reason", rounded_double("outcome", 6).alias("outcome"), rounded_double("peak", 6).alias("peak"), "age")
