"""Landing feeds by declaration: where a feed's items are, and each field's path, kind and default.

A document is the body that a feed returned for a key (a ticker, a company, a forum). Bodies are parsed as VARIANT and taken apart by
path, so that a field that is missing, null or of another kind takes its default, and never breaks its record. What isn't sound JSON,
or has no list where the items should be, goes to quarantine with its reason, and is counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feed:
    """items: path of the list ('' for a body that is one item); take: the first so many, before any filter (None: all); fields: name ->
    path, kind, default; where: SQL that items have to meet."""

    items: str
    fields: dict[str, tuple[str, str, object]]
    take: int | None = None
    where: str = "true"


# Paths, kinds and defaults of the feeds' fields.
FEEDS = {
    "article_search": Feed("$.articles", {"title": ("$.title", "string", "")}, 5, "title <> ''"),
    "provider_news": Feed("$", {"title": ("$.title", "string", ""), "published": ("$.providerPublishTime", "bigint", 0)}, 5, "title <> ''"),
    "insider_filings": Feed("$.hits.hits", {"date": ("$._source.period_of_report", "string", ""), "insider": ("$._source.display_names[0]", "string", "Unknown"), "filed": ("$._source.file_date", "string", "")}, 10),
    "adverse_events": Feed("$.results", {"date": ("$.receivedate", "string", ""), "country": ("$.primarysource.reportercountry", "string", "")}, 5),
    "drug_approvals": Feed("$.results", {"sponsor": ("$.sponsor_name", "string", ""), "drug_1": ("$.products[0].brand_name", "string", None), "drug_2": ("$.products[1].brand_name", "string", None)}, 10),
    "earnings_calendar": Feed("$.earningsCalendar", {"date": ("$.date", "string", "")}, None, "date <> ''"),
    "forum_posts": Feed("$.data.children", {"title": ("$.data.title", "string", ""), "score": ("$.data.score", "bigint", 0), "comments": ("$.data.num_comments", "bigint", 0), "body": ("$.data.selftext", "string", ""), "forum": ("$.data.subreddit", "string", "")}),
    "dealer_positioning": Feed("", {"gex": ("$.gex", "double", 0.0), "gamma_flip_level": ("$.gamma_flip_level", "double", None), "put_wall": ("$.put_wall", "double", None), "call_wall": ("$.call_wall", "double", None), "net_positioning": ("$.net_positioning", "string", "neutral")}),
    "vol_surface": Feed("", {"iv_skew": ("$.iv_skew", "double", 0.0), "iv_percentile": ("$.iv_percentile", "double", 50.0), "vol_surface_trend": ("$.vol_surface_trend", "string", "flat"), "net_call_flow": ("$.net_call_flow", "double", 0.0), "net_put_flow": ("$.net_put_flow", "double", 0.0), "oi_change_pct": ("$.oi_change_pct_24h", "double", 0.0)}),
}


def documents(spark: SparkSession, path: str) -> DataFrame:
    """key, body: the files below a folder, whose name without its ending is the key. An empty file holds nothing and has no row."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.url_decode(F.regexp_replace(name, r"\.[^.]*$", "")).alias("key"), F.col("value").alias("body"))


def _opened(docs: DataFrame, feed: Feed) -> DataFrame:
    """docs with `found`, the list of items (the body itself, for a feed of one item), and `reason`, why there is none."""
    doc = docs.withColumn("doc", F.try_parse_json("body"))
    found = F.try_variant_get("doc", feed.items or "$", "variant")
    kind = F.schema_of_variant(F.coalesce(found, F.parse_json(F.lit("null"))))
    right = kind.startswith("ARRAY") if feed.items else kind.startswith("OBJECT")
    return doc.withColumn("found", found).withColumn("reason", F.when(F.col("doc").isNull(), "broken").when(~right, "no items"))


def quarantine(docs: DataFrame, feed: Feed) -> DataFrame:
    """key, reason, body of the documents that give no items because they aren't what the feed should be."""
    return _opened(docs, feed).where("reason is not null").select("key", "reason", "body")


def feed_counts(docs: DataFrame, feed: Feed) -> DataFrame:
    """One row: documents, those read, and those in quarantine by reason."""
    o = _opened(docs, feed)
    of = lambda r: F.count_if(F.col("reason") == r)
    return o.agg(F.count("*").alias("documents"), F.count_if(F.col("reason").isNull()).alias("read"), of("broken").alias("broken"), of("no items").alias("no_items"))


def _field(path: str, kind: str, default: object) -> Column:
    got = F.try_variant_get("item", path, kind)
    return got if default is None else F.coalesce(got, F.lit(default).cast(kind))


def items(docs: DataFrame, feed: Feed) -> DataFrame:
    """key, place (from 0) and the feed's fields of each item."""
    sound = _opened(docs, feed).where("reason is null").select("key", "found")
    if feed.items:
        rows = docs.sparkSession.sql("SELECT d.key, i.pos AS place, i.value AS item FROM {sound} AS d, LATERAL variant_explode(d.found) AS i", sound=sound)
        rows = rows.where(F.col("place") < feed.take) if feed.take is not None else rows
    else:
        rows = sound.select("key", F.lit(0).alias("place"), F.col("found").alias("item"))
    return rows.select("key", "place", *[_field(*f).alias(n) for n, f in feed.fields.items()]).where(feed.where)


def provider_news(docs: DataFrame, now: str, hours: int = 48) -> DataFrame:
    """Headlines of the last `hours` hours among each key's first five."""
    rows = items(docs, FEEDS["provider_news"])
    return rows.where(F.timestamp_seconds("published") >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(hours=F.lit(hours))).select("key", "place", "title")


def approvals(docs: DataFrame) -> DataFrame:
    """sponsor in capitals, drugs: the first two brand names."""
    rows = items(docs, FEEDS["drug_approvals"])
    return rows.select("key", "place", F.upper("sponsor").alias("sponsor"), F.array_compact(F.array("drug_1", "drug_2")).alias("drugs"), F.concat(F.lit("FDA Approval: "), F.concat_ws(", ", "drug_1", "drug_2")).alias("headline"))


def next_earnings(calendar: DataFrame, snapshots: DataFrame, today: str, within: int = 30) -> DataFrame:
    """ticker, earnings, days_until: the first date of the calendar documents (key: ticker) in the next `within` days, else that of
    snapshots(ticker, earnings_timestamp in seconds)."""
    dates = items(calendar, FEEDS["earnings_calendar"]).select(F.col("key").alias("ticker"), F.try_to_date("date").alias("d"))
    day = F.to_date(F.lit(today))
    first = dates.where(F.datediff("d", day).between(0, within)).groupBy("ticker").agg(F.min("d").alias("listed"))
    own = snapshots.groupBy("ticker").agg(F.min(F.to_date(F.timestamp_seconds(F.nullif("earnings_timestamp", F.lit(0))))).alias("told"))
    rows = first.join(own, "ticker", "full_outer").withColumn("earnings", F.coalesce("listed", "told"))
    return rows.select("ticker", "earnings", F.datediff("earnings", day).alias("days_until"))


def earnings_soon(dates: Column, today: Column, within: int = 14) -> Column:
    """Whether any of several dates lies within the next `within` days; no dates: no."""
    return F.coalesce(F.exists(dates, lambda d: F.coalesce(F.datediff(d, today).between(0, within), F.lit(False))), F.lit(False))


def news_age_hours(times: Column, now: Column) -> Column:
    """Hours since the newest positive time (in seconds), to one digit; unknown if there is none."""
    return F.round((F.unix_timestamp(now) - F.array_max(F.filter(times, lambda t: t > 0))) / 3600, 1)


def rss(spark: SparkSession, path: str) -> DataFrame:
    """title, link of the entries of RSS files; an entry without a title is none, broken markup ends its file."""
    rows = spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").schema("title string, link string, _broken string").load(path)
    return rows.where("_broken is null and trim(title) <> ''").select(F.trim("title").alias("title"), F.coalesce("link", F.lit("")).alias("link"))
