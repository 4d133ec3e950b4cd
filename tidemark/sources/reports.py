"""Daily reports, ledger and landing feeds: readers with explicit schemas, and sinks.

Readers never infer: broken files and rows are told apart by the corrupt-record column and skipped. Sinks replace the partitions
they write, and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STAGES = ("universe", "candidates", "prescreened", "sector_ok", "pre_mc", "roi_precheck", "analyzed", "after_isf", "mismatch_ok", "quick_mc", "intraday_ok", "final_mc", "rl_scored", "roi_ok", "trades")
REPORT = (
    "date string, stats struct<vix:double," + ",".join(f"{s}:bigint" for s in STAGES) + ",stop_reason:string>, "
    "rejects map<string, struct<count:bigint, tickers:array<string>>>, proposals array<struct<ticker:string, strategy:string>>, _corrupt_record string"
)
#: The funnel's order, as far as it tells which stage ended a day.
ORDER = ("universe", "prescreened", "analyzed", "mismatch_ok", "quick_mc", "intraday_ok", "final_mc", "roi_ok", "trades")
TRADE = "ticker string, entry_date string, strategy string, outcome double, catalyst_type string, sector_etf string, reject_reason string, trade_score double, entry_debit double, option struct<strike:double, expiry:string, dte:int>, features struct<mismatch:double>, simulation struct<hit_rate:double>, deep_analysis struct<impact:double, surprise:double>"
# Weights of a ledger without its own.
WEIGHTS = {"impact": 0.35, "mismatch": 0.45, "eps_drift": 0.20}


def _struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()


def ledger_schema() -> str:
    trade = _struct(TRADE)
    kinds = [f"{n} array<{trade}>" for n in ("active_trades", "closed_trades", "shadow_trades")]
    return ", ".join([*kinds, "model_weights map<string, double>", "feature_stats map<string, map<string, struct<count:bigint, avg_return:double>>>", "_corrupt_record string"])


def read_reports(spark: SparkSession, folder: str, today: str | None = None, month: str | None = None) -> DataFrame:
    """day, and REPORT's columns: files named like a day, not after `today`, that hold an object. With `month` (yyyy-MM) only that
    month's files are listed."""
    rows = spark.read.schema(REPORT).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", f"{month}-*.json" if month else "*.json").json(folder)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = rows.withColumn("day", F.when(name.rlike(r"^\d{4}-\d{2}-\d{2}\.json$"), F.try_to_date(F.substring(name, 1, 10))))
    rows = rows.where("day is not null and _corrupt_record is null and (stats is not null or rejects is not null or proposals is not null or date is not null)")
    return (rows.where(F.col("day") <= F.to_date(F.lit(today))) if today else rows).drop("_corrupt_record")


def newest_reports(reports: DataFrame, limit: int = 10) -> DataFrame:
    return reports.orderBy(F.desc("day")).limit(limit)


def trades_of(report: str = "") -> Column:
    """A report's trades: its count, else the number of its proposals."""
    return F.coalesce(F.col("stats.trades"), F.size(F.coalesce("proposals", F.array().cast("array<struct<ticker:string, strategy:string>>"))).cast("long"), F.lit(0).cast("long"))


def killer() -> Column:
    """The stage after the last one with a positive count; the first if there is none."""
    last = F.greatest(*[F.when(F.coalesce(F.col(f"stats.{s}"), F.lit(0)) > 0, i + 1).otherwise(0) for i, s in enumerate(ORDER)])
    return F.element_at(F.array(*map(F.lit, (*ORDER, ORDER[-1]))), last + 1)


def drought(reports: DataFrame, limit: int = 10) -> DataFrame:
    """One row: how many of the newest reports in a row have no trade, and what ended them most often (ties: the first by name)."""
    rows = newest_reports(reports, limit).select("day", trades_of().alias("trades"), killer().alias("killer"))
    w = Window.partitionBy().orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)  # at most `limit` rows
    dry = rows.withColumn("seen", F.sum("trades").over(w)).where("seen = 0").groupBy("killer").agg(F.count("*").alias("n"))
    return dry.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("streak"), F.min(F.struct(F.negate("n").alias("less"), "killer"))["killer"].alias("killer"))


def month_funnel(reports: DataFrame, rejects: int = 5, stops: int = 3) -> DataFrame:
    """Per month: days, days without a trade, the most frequent reject reasons and stop reasons."""
    rows = reports.select(F.trunc("day", "month").alias("month"), trades_of().alias("trades"), F.col("stats.stop_reason").alias("stop"), "rejects")
    days = rows.groupBy("month").agg(F.count("*").alias("days"), F.count_if(F.col("trades") == 0).alias("zero_days"))

    def top(counts: DataFrame, name: str, k: int) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("n"), "reason"))
        return counts.withColumn("k", n).where(F.col("k") <= k).groupBy("month").agg(F.array_sort(F.collect_list(F.struct("k", "reason", "n"))).alias(name))

    reasons = rows.select("month", F.explode("rejects").alias("reason", "x")).groupBy("month", "reason").agg(F.sum("x.count").alias("n"))
    stopped = rows.where("trades = 0 and stop is not null").groupBy("month", F.col("stop").alias("reason")).agg(F.count("*").alias("n"))
    shown = lambda c: F.transform(F.col(c), lambda x: F.concat_ws(":", x["reason"], x["n"].cast("string"))).alias(c)
    out = days.join(top(reasons, "top_rejects", rejects), "month", "left").join(top(stopped, "top_stops", stops), "month", "left")
    return out.select("month", "days", "zero_days", shown("top_rejects"), shown("top_stops"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's document with its lists and weights; what is missing, broken or not finite takes the defaults."""
    rows = spark.read.schema(ledger_schema()).option("multiLine", True).json(path)
    sound = lambda k, d: F.when(F.isnan(w := F.element_at("model_weights", k)) | w.isNull() | (F.abs(w) == float("inf")), F.lit(d)).otherwise(w)
    weights = F.create_map(*[x for k, d in WEIGHTS.items() for x in (F.lit(k), sound(k, d))])
    lists = [F.coalesce(F.filter(n, lambda t: t.isNotNull()), F.array().cast(rows.schema[n].dataType)).alias(n) for n in ("active_trades", "closed_trades", "shadow_trades")]
    return rows.select(*lists, weights.alias("model_weights"), "feature_stats")


def ledger_rows(ledger: DataFrame) -> DataFrame:
    """Closed trades and evaluated shadows as flat rows, told apart by `source`."""
    part = lambda name, source: ledger.select(F.explode(name).alias("t")).where("t.outcome is not null").withColumn("source", F.lit(source))
    rows = part("closed_trades", "real").unionByName(part("shadow_trades", "shadow"))
    flat = {"mismatch": "features.mismatch", "impact": "deep_analysis.impact", "surprise": "deep_analysis.surprise", "hit_rate": "simulation.hit_rate", "dte": "option.dte", "score": "trade_score", "catalyst": "catalyst_type"}
    return rows.select("source", "t.ticker", "t.outcome", "t.strategy", "t.sector_etf", F.try_to_date(F.substring("t.entry_date", 1, 10)).alias("entry_date"), *[F.col(f"t.{path}").alias(n) for n, path in flat.items()])


def read_feed(spark: SparkSession, path: str, schema: str, items: str) -> DataFrame:
    """The records of a landing feed: JSON files with the array `items` of structs inside, one row an element; broken files are skipped."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).json(path)
    return rows.where("_corrupt_record is null").select(F.explode(items).alias("x")).select("x.*")


def news_feed(spark: SparkSession, path: str, newest: int = 5) -> DataFrame:
    """Per ticker the newest articles of a company-news feed."""
    kind = "data array<struct<ticker:string, headline:string, datetime:bigint, source:string, url:string, summary:string>>"
    rows = read_feed(spark, path, kind, "data").where("headline <> ''")
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("datetime"), "headline"))
    return rows.withColumn("k", k).where(F.col("k") <= newest).select("ticker", "k", "headline", F.timestamp_seconds("datetime").alias("ts"), "source", "url", F.substring("summary", 1, 200).alias("summary"))


def chain_feed(spark: SparkSession, path: str) -> DataFrame:
    """Contracts of an option-chain feed: implied volatility from the middle, else the smoothed one, else .30; .30 as well if it is
    .01 or less; a delta that is no number is 0. A single contract instead of a list is a list of one."""
    one = "symbol:string,option_type:string,strike:double,bid:double,ask:double,open_interest:bigint,expiration_date:string,greeks:struct<mid_iv:double,smv_vol:double,delta:string>"
    raw = spark.read.text(path, wholetext=True)
    option = F.get_json_object("value", "$.options.option")
    rows = raw.select(F.explode(F.from_json(F.when(option.startswith("["), option).otherwise(F.concat(F.lit("["), option, F.lit("]"))), f"array<struct<{one}>>")).alias("x")).select("x.*")
    iv = F.coalesce(F.nullif("greeks.mid_iv", F.lit(0.0)), F.nullif("greeks.smv_vol", F.lit(0.0)), F.lit(0.30))
    return rows.select("symbol", F.to_date("expiration_date").alias("expiry"), F.col("option_type").alias("type"), "strike", F.coalesce("bid", F.lit(0.0)).alias("bid"), F.coalesce("ask", F.lit(0.0)).alias("ask"), F.coalesce("open_interest", F.lit(0)).alias("oi"), F.when(iv <= 0.01, 0.30).otherwise(iv).alias("iv"), F.coalesce(F.expr("try_cast(greeks.delta as double)"), F.lit(0.0)).alias("delta"))


def series_feed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of (date, value): the days whose value isn't '.' or empty."""
    rows = spark.read.schema("date string, value string").option("header", True).csv(path)
    return rows.select(F.try_to_date("date").alias("d"), F.expr("try_cast(value as double)").alias("value")).where("d is not null and value is not null")


def cik_feed(spark: SparkSession, path: str) -> DataFrame:
    """ticker (upper case) and its registration number, ten digits wide, from the published map: one object whose keys number its
    records. A ticker that is there twice keeps its first record."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", "map<string, struct<cik_str:bigint, ticker:string, title:string>>")).alias("key", "x"))
    rows = rows.select(F.upper(F.trim("x.ticker")).alias("ticker"), F.lpad(F.col("x.cik_str").cast("string"), 10, "0").alias("cik"), F.col("x.title").alias("title"), F.expr("try_cast(key as bigint)").alias("key"))
    best = rows.where("ticker <> '' and cik is not null").groupBy("ticker").agg(F.min_by(F.struct("cik", "title"), F.struct(F.coalesce("key", F.lit(2**62)), "cik")).alias("x"))
    return best.select("ticker", "x.cik", "x.title")


def constituents(spark: SparkSession, path: str, fallback: DataFrame) -> DataFrame:
    """Symbols of an index list, dots as dashes; the fallback's if the list has none."""
    rows = spark.read.option("header", True).schema("symbol string").csv(path).select(F.regexp_replace(F.trim("symbol"), r"\.", "-").alias("symbol"), F.lit(0).alias("rank")).where("symbol <> ''")
    both = rows.unionByName(fallback.select("symbol", F.lit(1).alias("rank"))).distinct()
    best = both.agg(F.min("rank").alias("best"))
    return both.crossJoin(F.broadcast(best)).where("rank = best").select("symbol")  # one row


def write_snapshot(rows: DataFrame, folder: str, day: str = "run_date") -> None:
    """Replace the partitions of the days in rows, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(folder)


def report_document(judged: DataFrame, shown: int = 10) -> DataFrame:
    """run_date and the report's document: counts of trades and candidates, and each reason with its count and smallest tickers."""
    by = judged.where("reject_reason is not null").groupBy("run_date", "reject_reason", "ticker").agg(F.count("*").alias("n"))
    by = by.withColumn("k", F.row_number().over(Window.partitionBy("run_date", "reject_reason").orderBy("ticker")))
    reasons = by.groupBy("run_date", "reject_reason").agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.col("ticker").cast("string")))).alias("tickers"))
    rejects = reasons.groupBy("run_date").agg(F.map_from_entries(F.collect_list(F.struct("reject_reason", F.struct("count", "tickers")))).alias("rejects"))
    stats = judged.groupBy("run_date").agg(F.count("*").alias("universe"), F.count_if(F.col("reject_reason").isNull()).alias("trades"))
    return stats.join(rejects, "run_date", "left").select("run_date", F.date_format("run_date", "yyyy-MM-dd").alias("date"), F.struct("universe", "trades").alias("stats"), "rejects")


def write_reports(documents: DataFrame, folder: str) -> None:
    """One JSON document a day, below run_date=...; days that are written again are replaced."""
    documents.repartition("run_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(folder)
