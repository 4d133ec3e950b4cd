"""Slots of a tuning review, and the health of a book: verdicts that can't fail each other.

Each slot and each check is a plan of its own that ends in one row, run by itself: one whose input is broken or unreadable says so in
its row, and the others aren't touched. Values that are no numbers count as missing. Nothing but these rows comes to the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WAIT = "collect more data"
SLOT = "name string, n long, finding string, recommendation string, ready boolean"


def number(c: str) -> Column:
    """A value as a finite double, or NULL."""
    v = F.expr(f"try_cast({c} as double)")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def points(c: Column) -> Column:
    """A share in hundredths of a percent, as text."""
    return F.coalesce(F.round(c * 10_000 + 1e-6).cast("long").cast("string"), F.lit("none"))


def said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def trailing_slot(trailing: DataFrame, least: int = 5, gain: float = 0.05) -> DataFrame:
    """trailing(tp_outcome, trailing_outcome): is it better to follow a trade on than to take its profit?"""
    rows = trailing.select(number("tp_outcome").alias("a"), number("trailing_outcome").alias("b")).where("a is not null and b is not null")
    x = rows.agg(F.count("*").alias("n"), F.avg("a").alias("hard"), F.avg("b").alias("on"), F.avg(F.col("b") - F.col("a")).alias("delta"))
    ready = F.col("n") >= least
    pays = ready & (F.round("delta", 9) >= gain)
    return x.select("n", said("take profit ", points(F.col("hard")), ", trailing ", points(F.col("on")), ", delta ", points(F.col("delta"))).alias("finding"), F.when(pays, "trail profits").when(~ready, WAIT).alias("recommendation"), ready.alias("ready"))


def strategy_slot(closed: DataFrame, least: int = 10, gap: float = 0.10) -> DataFrame:
    """closed(strategy, outcome): spreads against single contracts."""
    kind = F.when(F.upper("strategy").contains("SPREAD"), "s").when(F.upper("strategy").contains("LONG"), "l")
    rows = closed.select(kind.alias("kind"), number("outcome").alias("o")).where("kind is not null and o is not null")
    of = lambda k: F.when(F.col("kind") == k, F.col("o"))
    x = rows.agg(F.count(of("s")).alias("s"), F.count(of("l")).alias("l"), F.avg(of("s")).alias("ms"), F.avg(of("l")).alias("ml"))
    ready = (F.col("s") >= least) & (F.col("l") >= least)
    some = (F.col("s") > 0) & (F.col("l") > 0)
    better = ready & (F.round(F.col("ml") - F.col("ms"), 9) >= gap)
    text = F.when(some, said("spreads ", F.col("s"), " at ", points(F.col("ms")), ", single ", F.col("l"), " at ", points(F.col("ml")))).otherwise(said("spreads ", F.col("s"), ", single ", F.col("l")))
    return x.select((F.col("s") + F.col("l")).alias("n"), text.alias("finding"), F.when(better, "raise the gate of spreads").when(~ready, WAIT).alias("recommendation"), ready.alias("ready"))


def sector_slot(book: DataFrame, total: int = 20, least: int = 3) -> DataFrame:
    """book(sector, outcome, source, reject_reason): closed trades and shadows that survived to the end; is one sector alone positive?"""
    own = book.where("sector <> '' and (source = 'closed' or reject_reason = 'final_mc_survivor')").select("sector", number("outcome").alias("o"))
    by = own.groupBy("sector").agg(F.count("*").alias("rows"), F.count("o").alias("n"), F.avg("o").alias("mean"))
    shown = F.col("n") >= least
    up = shown & (F.col("mean") > 0)
    pick = lambda f: f(F.when(shown, F.struct("sector", "mean")), F.when(shown, F.struct("mean", "sector")))["sector"]
    x = by.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.count_if(shown).alias("sectors"), F.count_if(up).alias("up"), F.max(F.when(up, F.col("sector"))).alias("only"), pick(F.max_by).alias("best"), pick(F.min_by).alias("worst"))
    ready = F.col("n") >= total
    text = F.when(~ready, "too few with a sector").when(F.col("sectors") == 0, "no sector has enough").otherwise(said(F.col("sectors"), " sectors, best ", F.col("best"), ", worst ", F.col("worst")))
    alone = ready & (F.col("up") == 1) & (F.col("sectors") > 1)
    return x.select("n", text.alias("finding"), F.when(~ready, WAIT).when(alone, F.concat(F.lit("only "), F.col("only"))).alias("recommendation"), ready.alias("ready"))


def one_row_each(spark: SparkSession, plans: dict[str, Callable[[], DataFrame]], schema: str, failed: Callable[[str, str], tuple]) -> DataFrame:
    """Each plan's one row behind its name; failed(name, reason) in place of one that can't be made or run."""
    rows = []
    for name, plan in plans.items():
        try:
            rows.append((name, *plan().first()))
        except Exception as e:  # noqa: BLE001  whatever breaks a plan is its own row's finding, and no other's
            rows.append(failed(name, type(e).__name__))
    return spark.createDataFrame(rows, schema)


def slot_summary(spark: SparkSession, trailing: Callable[[], DataFrame], closed: Callable[[], DataFrame], book: Callable[[], DataFrame]) -> DataFrame:
    """One row a slot. Inputs are given as functions, so that one which can't even be opened is its slot's finding."""
    plans = {"trailing_stop": lambda: trailing_slot(trailing()), "spreads_vs_single": lambda: strategy_slot(closed()), "sectors": lambda: sector_slot(book())}
    return one_row_each(spark, plans, SLOT, lambda name, why: (name, 0, f"failed: {why}", WAIT, False))


CHECK = "check string, warned boolean, message string"


def weights_check(weights: DataFrame) -> DataFrame:
    """weights(feature, weight): NaN weights, or all of them 0."""
    w = F.expr("try_cast(weight as double)")
    rows = weights.select("feature", w.alias("w"), F.coalesce(F.isnan(w), F.lit(False)).alias("nan"))
    x = rows.agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("nan"), F.col("feature")))), ",").alias("nans"), F.count(F.when(~F.col("nan"), F.col("w"))).alias("n"), F.count_if(~F.col("nan") & (F.col("w") != 0)).alias("some"))
    text = F.when(F.col("nans") != "", F.concat(F.lit("NaN: "), F.col("nans"))).when((F.col("n") > 0) & (F.col("some") == 0), "all 0")
    return x.select(text.isNotNull().alias("warned"), text.alias("message"))


def overdue_check(active: DataFrame, today: str, hold: int = 45, grace: int = 30, shown: int = 5) -> DataFrame:
    """active(ticker, entry_date): trades older than the holding limit and its grace; the `shown` oldest are named."""
    age = F.datediff(F.to_date(F.lit(today)), F.expr("try_cast(entry_date as date)"))
    rows = active.select(F.coalesce(F.col("ticker").cast("string"), F.lit("?")).alias("ticker"), age.alias("age")).where(F.col("age") > hold + grace)
    n = rows.agg(F.count("*").alias("n"))
    oldest = rows.orderBy(F.desc("age"), "ticker").limit(shown).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.negate("age").alias("less"), "ticker"))), lambda r: F.concat(r["ticker"], F.lit(" "), F.negate(r["less"]).cast("string"))), ", ").alias("names"))
    return n.crossJoin(oldest).select((F.col("n") > 0).alias("warned"), F.when(F.col("n") > 0, said(F.col("n"), " overdue: ", F.col("names"))).alias("message"))  # one row each


def reports_check(reports: DataFrame, today: str, stale: int = 5) -> DataFrame:
    """reports(run_date, universe, vix): no report, an old one, an empty universe or no volatility in the newest."""
    x = reports.agg(F.max("run_date").alias("last"), F.max_by("universe", "run_date").alias("universe"), F.max_by(F.coalesce(number("vix"), F.lit(-1.0)), "run_date").alias("vix"))
    age = F.datediff(F.to_date(F.lit(today)), "last")
    text = F.when(F.col("last").isNull(), "no reports").otherwise(F.array_join(F.array_compact(F.array(F.when(age > stale, said("last report ", age, " days old")), F.when(F.coalesce("universe", F.lit(0)) == 0, "universe 0"), F.when(F.col("vix") < 0, "no volatility"))), ", "))
    return x.select((text != "").alias("warned"), F.nullif(text, F.lit("")).alias("message"))


def book_health(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """One row a check, each (warned, message), and one for the whole."""
    rows = one_row_each(spark, checks, CHECK, lambda name, why: (name, True, f"failed: {why}"))
    whole = rows.agg(F.lit("status").alias("check"), F.bool_or("warned").alias("warned"), F.when(F.bool_or("warned"), "WARN").otherwise("OK").alias("message"))
    return rows.unionByName(whole)
