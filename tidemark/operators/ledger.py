"""Trade statistics, threshold sweeps, learned weights and book rules over the trade ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import safe_corr, trade_stats

# Thresholds of the sweep, by field; mismatch is an upper limit, the others are lower ones.
SWEEP = {"dte": (30, 45, 60, 90, 120), "mismatch": (5, 6, 7, 8), "impact": (4, 5, 6, 7), "surprise": (3, 4, 5, 6), "hit_rate": (0.45, 0.50, 0.55, 0.60), "score": (40, 50, 55, 60, 70)}
# Alternatives of the thresholds that may be tuned.
TUNABLE = {"dte": (30, 45, 60, 90, 120), "mismatch": (4, 5, 6, 7, 8), "impact": (4, 5, 6), "surprise": (3, 4, 5), "score": (40, 50, 55, 60, 70)}
CURRENT = {"dte": 120, "mismatch": 8, "impact": 4, "surprise": 3, "score": 55}
UPPER = ("mismatch",)


def scored(trades: DataFrame) -> DataFrame:
    """Rows with an outcome: unknown isn't 0."""
    return trades.where("outcome is not null")


def counted(trades: DataFrame, *keys) -> DataFrame:
    """keys, outcome, times."""
    return trades.groupBy(*keys, "outcome").agg(F.count("*").alias("times"))


def threshold_sweep(trades: DataFrame, grid: dict[str, tuple] = SWEEP) -> DataFrame:
    """field, threshold and the statistics of the trades within it. A row becomes one row a field, with the number of thresholds
    that it meets; only counts of (field, number, outcome) then meet the thresholds. Rows without a field's value are left out of it."""
    known = {f: ts for f, ts in grid.items() if f in trades.columns}
    meets = lambda f, t: F.when(F.col(f) <= t if f in UPPER else F.col(f) >= t, 1).otherwise(0)
    fields = [F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNotNull(), sum((meets(f, t) for t in ts), F.lit(0))).alias("met")) for f, ts in known.items()]
    counts = counted(scored(trades).select("outcome", F.explode(F.array(*fields)).alias("g")).where("g.met > 0"), F.col("g.field").alias("field"), F.col("g.met").alias("met"))
    loosest = F.create_map(*[x for f, ts in known.items() for x in (F.lit(f), F.array(*[F.lit(float(t)) for t in (sorted(ts, reverse=f in UPPER))]))])
    rows = counts.withColumn("threshold", F.explode(F.slice(F.element_at(loosest, F.col("field")), 1, F.col("met"))))
    return rows.groupBy("field", "threshold", "outcome").agg(F.sum("times").alias("times")).groupBy("field", "threshold").agg(*trade_stats())


def threshold_suggest(trades: DataFrame, current: dict[str, float] = CURRENT, least: int = 20, gain: float = 0.05) -> DataFrame:
    """For each field the alternative with the best win rate (ties: the first), if it gains enough and its mean isn't worse than with
    the current threshold, which needn't be among the alternatives. One sweep covers both."""
    wanted = {f: tuple(sorted({*ts, current[f]})) for f, ts in TUNABLE.items() if f in current}
    swept = threshold_sweep(trades, wanted)
    now = F.element_at(F.create_map(*[F.lit(x) for f in wanted for x in (f, float(current[f]))]), F.col("field"))
    by = Window.partitionBy("field")  # at most six rows a field
    at_now = lambda c: F.max(F.when(F.col("threshold") == now, F.col(c))).over(by)
    rows = swept.withColumn("current", now).withColumn("current_win_rate", at_now("win_rate")).withColumn("current_mean", at_now("mean"))
    offered = F.array_contains(F.element_at(F.create_map(*[x for f, ts in TUNABLE.items() for x in (F.lit(f), F.array(*[F.lit(float(t)) for t in ts]))]), F.col("field")), F.col("threshold"))
    better = rows.where(offered & (F.col("n") >= least) & (F.col("threshold") != F.col("current")) & (F.round(F.col("win_rate") - F.col("current_win_rate"), 6) >= gain) & (F.col("mean") >= F.col("current_mean")))
    best = Window.partitionBy("field").orderBy(F.desc("win_rate"), "threshold")
    return better.withColumn("k", F.row_number().over(best)).where("k = 1").select("field", "current", F.col("threshold").alias("suggested"), "n", "win_rate", "current_win_rate", "mean")


def stats_by(trades: DataFrame, **keys) -> DataFrame:
    return counted(scored(trades), *[c.alias(n) for n, c in keys.items()]).groupBy(*keys).agg(*trade_stats())


def month_over_month(trades: DataFrame) -> DataFrame:
    """Mean of each month next to the previous calendar month's, NULL over gaps."""
    m = stats_by(trades, month=F.trunc("entry_date", "month"))
    prev = m.select(F.add_months("month", 1).alias("month"), F.col("mean").alias("prev_mean"), F.col("win_rate").alias("prev_win_rate"))
    return m.join(prev, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), "n", "mean", "prev_mean", F.round(F.col("mean") - F.col("prev_mean"), 6).alias("change"), "prev_win_rate")


def spread_class():
    return F.when(F.col("strategy").contains("SPREAD"), "spread").otherwise("long")


def spread_vs_long(trades: DataFrame) -> DataFrame:
    s = stats_by(trades.where("source = 'closed'"), kind=spread_class())
    pair = s.groupBy().agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in ("spread", "long") for c in ("n", "mean", "win_rate")])
    gap = F.col("long_mean") - F.col("spread_mean")
    ready = (F.col("spread_n") >= 10) & (F.col("long_n") >= 10)
    return pair.withColumn("gap", F.round(gap, 6)).withColumn("ready", ready).withColumn("recommend", F.when(ready & (gap >= 0.10), "long").when(ready & (gap <= -0.10), "spread").otherwise("none"))


def sector_stats(trades: DataFrame) -> DataFrame:
    """n, mean, win_rate, wins of each sector, its share of all wins, and whether that is most of them. Groups of three at least are shown."""
    known = F.col("outcome").isNotNull()
    s = counted(trades.where(known), "sector").groupBy("sector").agg(*trade_stats(), F.sum(F.when(F.col("outcome") > 0, F.col("times")).otherwise(0)).alias("wins"))
    every = Window.partitionBy()  # one row a sector
    out = s.withColumn("share", F.round(F.try_divide("wins", F.sum("wins").over(every)), 6))
    return out.where("n >= 3").withColumn("dominant", F.col("share") > 0.5).select("sector", "n", "mean", "win_rate", "wins", "share", "dominant")


def sector_verdict(trades: DataFrame, total: int = 20) -> DataFrame:
    """Of closed trades and shadows that survived to the end, one row: how many there are, known or not; whether that is enough; the best and the worst sector; the one that has
    most wins, if any; and the only sector with a positive mean, if all others have none."""
    own = trades.where("source = 'closed' or reject_reason = 'final_mc_survivor'")
    s = sector_stats(own)
    n = own.agg(F.count("sector").alias("n"))
    edge = lambda f: f(F.struct("sector", "mean"), F.struct("mean", "sector"))["sector"]
    out = s.agg(F.count("*").alias("sectors"), edge(F.max_by).alias("best"), edge(F.min_by).alias("worst"), F.max(F.when(F.col("dominant"), F.col("sector"))).alias("dominant"), F.count_if(F.col("mean") > 0).alias("_up"), F.max(F.when(F.col("mean") > 0, F.col("sector"))).alias("_only"))
    out = n.crossJoin(out)  # one row each
    ready = F.col("n") >= total
    return out.select("n", ready.alias("ready"), "sectors", "best", "worst", "dominant", F.when(ready & (F.col("_up") == 1) & (F.col("sectors") > 1), F.col("_only")).alias("recommended"))


def bins():
    """The three features as bins, unpivoted: feature, bin, place (0, 0.5 or 1). A missing feature is in the middle bin; missing drift is noise."""
    c = F.col
    impact = F.when(c("impact") <= 4, 0).when(c("impact") > 7, 2).otherwise(1)
    mismatch = F.when(c("mismatch") < 3, 0).when(c("mismatch") > 6, 2).otherwise(1)
    drift = F.when(F.abs("eps_drift") > 0.10, 2).when(F.abs("eps_drift") > 0.05, 1).otherwise(0)
    named = lambda k, labels: F.get(F.array(*map(F.lit, labels)), k)
    rows = (("impact", impact, ("low", "mid", "high")), ("mismatch", mismatch, ("weak", "good", "strong")), ("eps", drift, ("noise", "relevant", "massive")))
    return F.array(*[F.struct(F.lit(n).alias("feature"), named(k, labels).alias("bin"), (k / 2).alias("place")) for n, k, labels in rows])


def bin_stats(trades: DataFrame) -> DataFrame:
    rows = scored(trades).where("source = 'closed'").select("outcome", F.explode(bins()).alias("b"))
    return rows.groupBy("b.feature", "b.bin").agg(F.count("*").alias("count"), F.round(F.avg("outcome"), 6).alias("avg_return"))


def pearson_weights(trades: DataFrame, rate: float = 0.05) -> DataFrame:
    """Weights .35/.45/.20 moved towards the positive correlations of the bins with the outcome."""
    old = {"impact": 0.35, "mismatch": 0.45, "eps": 0.20}
    x = scored(trades).where("source = 'closed'").select("outcome", *[bins()[k]["place"].alias(f"x_{f}") for k, f in enumerate(old)])
    r = x.agg(F.count("*").alias("n"), *[F.greatest(safe_corr(f"x_{f}", "outcome"), F.lit(0.0)).alias(f) for f in old])
    total = sum((F.col(f) for f in old), F.lit(0.0))
    new = {f: F.when((F.col("n") < 5) | (total == 0), F.lit(w)).otherwise(w + rate * (F.try_divide(F.col(f), total) - w)) for f, w in old.items()}
    return r.select("n", *[F.round(c, 4).alias(f) for f, c in new.items()])


def cooldown_entered(trades: DataFrame, days: int = 30) -> DataFrame:
    """Trades that are entered: a ticker that was entered in the last `days` days is blocked, also by the same batch; blocked
    trades block nothing. Of a day only the first trade can be entered, so a ticker is a fold over its days, however many rows
    it has. Trades without a date neither block nor are blocked."""
    dated = trades.where("entry_date is not null").groupBy("ticker", "entry_date").agg(F.min("trade_id").alias("trade_id"))
    day = "array<struct<entry_date:date,trade_id:bigint>>"
    start = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast(day).alias("entered"))
    free = lambda acc, x: acc["last"].isNull() | (F.datediff(x["entry_date"], acc["last"]) > days)
    enter = lambda acc, x: F.struct(x["entry_date"].alias("last"), F.concat(acc["entered"], F.array(x)).alias("entered"))
    in_order = F.sort_array(F.collect_list(F.struct("entry_date", F.col("trade_id").cast("long").alias("trade_id")))).cast(day)
    by_ticker = dated.groupBy("ticker").agg(in_order.alias("days"))
    entered = by_ticker.select("ticker", F.explode(F.aggregate("days", start, lambda acc, x: F.when(free(acc, x), enter(acc, x)).otherwise(acc), lambda acc: acc["entered"])).alias("x"))
    undated = trades.where("entry_date is null").select("trade_id", "ticker", "entry_date")
    return entered.select("x.trade_id", "ticker", "x.entry_date").unionByName(undated)


def shadow_maturity(trades: DataFrame, hold: int = 45, soon: int = 14) -> DataFrame:
    """By reject reason: shadows, those evaluated, those ready within `soon` days of the last entry, and the next date."""
    shadows = trades.where("source = 'shadow' or reject_reason is not null")
    asof = shadows.agg(F.max("entry_date").alias("asof"))
    due = F.date_add("entry_date", hold)
    open_ = F.col("outcome").isNull()
    rows = shadows.crossJoin(F.broadcast(asof))  # one row
    return rows.groupBy(F.coalesce("reject_reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("total"), F.count_if(~open_).alias("evaluated"), F.count_if(open_ & (due <= F.date_add("asof", soon))).alias("ready"), F.min(F.when(open_, due)).alias("next_date"))


def rank_trades(trades: DataFrame, top: int = 5) -> DataFrame:
    w = Window.partitionBy("entry_date").orderBy(F.desc("score"), "ticker", "trade_id")
    grade = F.when(F.col("score") >= 75, "STRONG BUY").when(F.col("score") >= 60, "BUY").when(F.col("score") >= 45, "WATCH").otherwise("AVOID")
    return trades.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("entry_date", "rank", "trade_id", "score", grade.alias("grade"))


def gate_reasons(trades: DataFrame) -> DataFrame:
    """How many trades each gate stops, the first failing one counting, and a few of their tickers."""
    from tidemark.functions.columns import first_reason

    c = F.col
    reason = first_reason((c("dte") < 14, "dte_too_short"), (c("impact") < 4, "impact_too_low"), (c("surprise") < 3, "surprise_too_low"), (c("mismatch") > 7, "mismatch_too_high"), (c("score") < 40, "score_too_low"))
    rows = trades.select(F.coalesce(reason, F.lit("passed")).alias("reason"), "ticker")
    return rows.groupBy("reason").agg(F.count("*").alias("count"), F.countDistinct("ticker").alias("tickers"))
