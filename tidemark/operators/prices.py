"""Price features: returns, volatility, relative strength, correlation, barrier hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_day():
    return Window.partitionBy("ticker").orderBy("d")


def returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(by_day())) - 1)


def look_back(bars: DataFrame, days: int) -> DataFrame:
    """The bars of each ticker's last `days` days, counted from its last bar."""
    return bars.withColumn("last", F.max("d").over(Window.partitionBy("ticker"))).where(F.col("d") > F.date_sub("last", days)).drop("last")


def mismatch(bars: DataFrame, impact: int = 8) -> DataFrame:
    """At each ticker's last day: move over two days up to the day before, population sigma of 35 days, z and mismatch.
    Fewer than 5 rows: no move; fewer than 10: sigma 0, and the row goes."""
    r = returns(bars)
    last = Window.partitionBy("ticker")
    recent = r.withColumn("last", F.max("d").over(last)).where("d > date_sub(last, 35)")
    n = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("d")))
    agg = recent.withColumn("k", n).groupBy("ticker").agg(
        F.count("*").alias("rows"), F.stddev_pop("ret").alias("s"), F.max(F.when(F.col("k") == 2, F.col("close"))).alias("c2"), F.max(F.when(F.col("k") == 4, F.col("close"))).alias("c4")
    )
    sigma = F.when(F.col("rows") >= 10, F.col("s")).otherwise(0.0)
    move = F.when(F.col("rows") >= 5, F.try_divide(F.col("c2"), F.col("c4")) - 1).otherwise(0.0)
    z = F.try_divide(F.abs(F.col("move")), F.col("sigma"))
    out = agg.withColumn("sigma", sigma).withColumn("move", move).withColumn("z", z).where("sigma > 0").withColumn("mismatch", impact - 5 * F.col("z"))
    return out.where("mismatch > 0").select("ticker", *[F.round(c, 6).alias(c) for c in ("sigma", "move", "z", "mismatch")])


def sigma(bars: DataFrame, least: int = 30, days: int = 182) -> DataFrame:
    """Of the last six months: mean and both standard deviations of the daily returns; 0 and .02 with fewer than `least` bars, and
    each where it is out of range."""
    a = returns(look_back(bars, days)).groupBy("ticker").agg(F.count("*").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.stddev_pop("ret").alias("p"))
    few = F.col("n") < least
    return a.select(
        "ticker",
        "n",
        F.round(F.when(few | (F.abs("m") > 0.005), 0.0).otherwise(F.col("m")), 6).alias("mu"),
        F.round(F.when(few | ~F.col("s").between(0.005, 0.15), 0.02).otherwise(F.col("s")), 6).alias("sigma_samp"),
        F.round("p", 6).alias("sigma_pop"),
    )


def relative_strength(bars: DataFrame, days: int = 35) -> DataFrame:
    """Return of the ticker over its last `days` days less that of its sector's mean close over the same days."""
    end = bars.agg(F.max("d").alias("end"))
    recent = bars.crossJoin(F.broadcast(end)).where(F.col("d") > F.date_sub("end", days))  # one row
    change = lambda rows, key: rows.groupBy(key).agg((F.max_by("close", "d") / F.min_by("close", "d") - 1).alias(f"{key}_ret"), F.count("*").alias(f"{key}_rows"))
    sector = recent.groupBy("sector", "d").agg(F.expr("sum(cast(round(close * 1000000) as bigint)) / count(*) / 1000000").alias("close"))
    own = change(recent, "ticker").join(recent.select("ticker", "sector").distinct(), "ticker").join(change(sector, "sector"), "sector")
    strength = F.round(F.col("ticker_ret") - F.col("sector_ret"), 4)
    return own.select("ticker", "sector", strength.alias("strength"), ((F.col("ticker_rows") < 5) | (strength >= -0.15)).alias("ok"), ((F.col("ticker_rows") < 5) | (strength <= 0.15)).alias("ok_bearish"))


def pair_correlation(bars: DataFrame, least: int = 20) -> DataFrame:
    """Pearson r of the returns of each two tickers of one sector on their common days."""
    r = returns(bars).where("ret is not null").select("sector", "d", "ticker", "ret")
    a, b = r.withColumnRenamed("ticker", "a").withColumnRenamed("ret", "x"), r.withColumnRenamed("ticker", "b").withColumnRenamed("ret", "y")
    pairs = a.join(b, ["sector", "d"]).where("a < b")
    corr = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.coalesce(corr, F.lit(0.0)), 6).alias("corr")).where(F.col("n") >= least)


def whole_days(bars: DataFrame) -> DataFrame:
    """Returns of the days on which every ticker has one."""
    r = returns(bars).where("ret is not null").select("d", "ticker", "ret")
    size = r.agg(F.countDistinct("ticker").alias("tickers"))
    days = r.groupBy("d").agg(F.count("*").alias("n")).crossJoin(F.broadcast(size)).where("n = tickers").select("d")  # one row
    return r.join(days, "d")


def correlation_matrix(bars: DataFrame) -> DataFrame:
    """Pearson r of each two tickers on the days that all tickers have; 0 where one is constant."""
    r = whole_days(bars)
    a, b = r.select("d", F.col("ticker").alias("a"), F.col("ret").alias("x")), r.select("d", F.col("ticker").alias("b"), F.col("ret").alias("y"))
    corr = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return a.join(b, "d").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.coalesce(corr, F.lit(0.0)), 6).alias("corr"))


def frame_returns(ranked: DataFrame, bars: DataFrame, days: int = 35) -> DataFrame:
    """For ranked(run, ticker, rank): run, ticker, rank, d, ret of each run's last `days` days, on the days on which all tickers of the run
    have a return; the first bar in the frame has none. A frame meets bars by ticker and month, not by a range."""
    months = F.sequence(F.trunc(F.date_sub("run", days), "month"), F.trunc("run", "month"), F.expr("interval 1 month"))
    want = ranked.select("run", "ticker", "rank", F.explode(months).alias("month"))
    have = bars.select("ticker", "d", "close", F.trunc("d", "month").alias("month"))
    rows = want.join(have, ["ticker", "month"]).where((F.col("d") > F.date_sub("run", days)) & (F.col("d") <= F.col("run")))
    before = F.lag("close").over(Window.partitionBy("run", "ticker").orderBy("d"))
    rows = rows.withColumn("ret", F.try_divide(F.col("close"), before) - 1).where("ret is not null").select("run", "ticker", "rank", "d", "ret")
    size = ranked.groupBy("run").agg(F.count("*").alias("size"))
    whole = rows.groupBy("run", "d").agg(F.count("*").alias("n")).join(size, "run").where("n = size").select("run", "d")
    return rows.join(whole, ["run", "d"])


def run_correlations(ranked: DataFrame, bars: DataFrame, days: int = 35) -> DataFrame:
    """run, i, j, a, b, n, corr of each two tickers of a run, the better ranked one first: Pearson r over its frame, 0 where one is
    constant. A run's tickers are its proposals, which are few; its pairs are what is asked for."""
    r = frame_returns(ranked, bars, days)
    a = r.select("run", "d", F.col("rank").alias("i"), F.col("ticker").alias("a"), F.col("ret").alias("x"))
    b = r.select("run", "d", F.col("rank").alias("j"), F.col("ticker").alias("b"), F.col("ret").alias("y"))
    sums = a.join(b, ["run", "d"]).where("i < j").groupBy("run", "i", "j", "a", "b")
    corr = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return sums.agg(F.count("*").alias("n"), F.round(F.coalesce(corr, F.lit(0.0)), 9).alias("corr"))


def prune_correlated(ranked: DataFrame, corr: DataFrame, limit: float = 0.75) -> DataFrame:
    """ranked(run, ticker, rank, score) with `kept`. From the front, each ticker that is still in goes through those behind it that are
    still in: of two correlated above the limit, the one with the lower score goes, the one behind if they are equal. One that goes
    in its own turn still ends its turn. Only a run's correlated pairs are gathered into one row, in order, for the fold."""
    score = ranked.select("run", F.col("ticker").alias("a"), F.col("score").alias("s")), ranked.select("run", F.col("ticker").alias("b"), F.col("score").alias("t"))
    pairs = corr.where(F.col("corr") > limit).select("run", "i", "j", "a", "b").join(score[0], ["run", "a"]).join(score[1], ["run", "b"])
    by_run = pairs.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("i", "j", "a", "b", (F.col("s") >= F.col("t")).alias("first")))).alias("pairs"))
    kind = ranked.schema["ticker"].dataType
    start = F.struct(F.array().cast(f"array<{kind.simpleString()}>").alias("gone"), F.lit(-1).cast(ranked.schema["rank"].dataType).alias("i"), F.lit(False).alias("out"))

    def step(acc, p):
        out = F.when(acc["i"] == p["i"], acc["out"]).otherwise(F.array_contains(acc["gone"], p["a"]))
        gone = F.when(out | F.array_contains(acc["gone"], p["b"]), acc["gone"]).otherwise(F.array_union(acc["gone"], F.array(F.when(p["first"], p["b"]).otherwise(p["a"]))))
        return F.struct(gone.alias("gone"), p["i"].alias("i"), out.alias("out"))

    removed = by_run.select("run", F.explode(F.aggregate("pairs", start, step, lambda acc: acc["gone"])).alias("ticker"), F.lit(False).alias("in"))
    return ranked.join(removed, ["run", "ticker"], "left").select("run", "ticker", "rank", "score", F.coalesce("in", F.lit(True)).alias("kept"))


def correlation_losers(pruned: DataFrame) -> DataFrame:
    """What pruning has taken out, as registrations for the shadow book: ticker, entry_date, reason."""
    return pruned.where("not kept").select("ticker", F.col("run").alias("entry_date"), F.lit("correlation").alias("reason"))


def month_returns(bars: DataFrame) -> DataFrame:
    """Last close of a month over its first, less 1; unknown with fewer than two bars."""
    a = bars.groupBy("ticker", F.trunc("d", "month").alias("month")).agg(F.max_by("close", "d").alias("last"), F.min_by("close", "d").alias("first"), F.count("*").alias("n"))
    return a.select("ticker", "month", F.round(F.when(F.col("n") >= 2, F.try_divide("last", "first") - 1), 6).alias("index_return"))


def against_index(trades: DataFrame, bars: DataFrame, index: str) -> DataFrame:
    """Per month the trades' mean outcome beside the index' return."""
    mean = trades.where("outcome is not null").groupBy(F.trunc("entry_date", "month").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("outcome"), 6).alias("mean"))
    own = month_returns(bars).where(F.col("ticker") == index).drop("ticker")
    return mean.join(own, "month", "left").select("month", "n", "mean", "index_return", F.round(F.col("mean") - F.col("index_return"), 6).alias("edge"))


def barrier_hits(bars: DataFrame, ahead: int = 20) -> DataFrame:
    """Share of days whose highest close in the next `ahead` bars reaches close * (1 + target), capped at 75 %, and its standard
    error. The target is 8 % or half of what the ticker's daily standard deviation makes of the time, whichever is more."""
    high = F.max("close").over(by_day().rowsBetween(1, ahead))
    left = F.count("close").over(by_day().rowsBetween(1, ahead))
    spread = F.stddev_pop("ret").over(Window.partitionBy("ticker"))
    target = F.greatest(F.lit(0.08), F.round(0.5 * F.coalesce(spread, F.lit(0.0)) * F.sqrt(F.lit(float(ahead))), 6))
    rows = returns(bars).withColumn("target", target).withColumn("high", high).withColumn("left", left).where(F.col("left") == ahead)
    a = rows.groupBy("ticker", "target").agg(F.count("*").alias("n"), F.avg((F.col("high") >= F.col("close") * (1 + F.col("target"))).cast("double")).alias("p"))
    p = F.least(F.col("p"), F.lit(0.75))
    return a.select("ticker", "target", "n", F.round(p, 6).alias("hit_rate"), F.round(F.sqrt(p * (1 - p) / F.col("n")), 6).alias("stderr"))


def rv_rank(bars: DataFrame, width: int = 21, least: int = 60) -> DataFrame:
    """Where the last rolling volatility stands between the 5 % and 95 % quantiles of its year, 0 to 100."""
    w = by_day().rowsBetween(1 - width, 0)
    r = returns(bars).withColumn("rv", F.when(F.count("ret").over(w) == width, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(252.0))))
    last = F.max("d").over(Window.partitionBy("ticker"))
    year = r.where("rv is not null").withColumn("last", last).where("d > date_sub(last, 365)")
    a = year.groupBy("ticker").agg(F.count("*").alias("n"), F.max_by("rv", "d").alias("rv"), F.percentile("rv", 0.05).alias("lo"), F.percentile("rv", 0.95).alias("hi"))
    rank = F.least(F.greatest(F.try_divide(F.col("rv") - F.col("lo"), F.col("hi") - F.col("lo")) * 100, F.lit(0.0)), F.lit(100.0))
    return a.where(F.col("n") >= least).select("ticker", "n", F.round("rv", 6).alias("rv"), F.round(F.coalesce(rank, F.lit(50.0)), 1).alias("rv_rank"))


def iv_rank(bars: DataFrame, term: DataFrame) -> DataFrame:
    """0.8 of the volatility's rank and 0.2 of the term structure's score, which is 20 where unknown."""
    rows = rv_rank(bars).join(term, "ticker", "left")
    return rows.select("ticker", "rv_rank", F.round(F.col("rv_rank") * 0.80 + F.coalesce("term_score", F.lit(20.0)) * 0.20 + 1e-9, 1).alias("iv_rank"))
