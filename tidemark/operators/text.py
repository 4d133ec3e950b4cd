"""Posts: credibility, bullish and bearish words, weighted sentiment, top posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.words import ascii_words, lower

# Words that count as bullish and as bearish.
BULLISH = ("bull", "bullish", "moon", "rocket", "buy", "long", "call", "calls", "squeeze", "breakout", "beat", "upside", "strong", "outperform")
BEARISH = ("bear", "bearish", "short", "put", "puts", "crash", "dump", "sell", "downside", "miss", "weak", "underperform", "resistance")

# Fixed value: what shows that a post is about options.
OPTIONS = r"\b(call|calls|put|puts|strike|expiry|dte|leaps?|\d+[cp]\s*\$?\d+|\$\d+c|\$\d+p)\b"


def _count(words: tuple[str, ...]):
    return F.regexp_count(ascii_words(lower(F.col("text"))), F.lit(r"\b(" + "|".join(sorted(words, reverse=True)) + r")\b"))


def credibility(posts: DataFrame) -> DataFrame:
    """Scores and comments under 0, or missing, count as 0."""
    score, comments = (F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in ("score", "comments"))
    weight = F.log1p(score) * (1 + F.least(comments / (score + 1), F.lit(2.0)))
    return posts.select("id", "source", F.round(weight, 3).alias("credibility"), _count(BULLISH).alias("bull"), _count(BEARISH).alias("bear"), F.coalesce(ascii_words(lower(F.col("text"))).rlike(OPTIONS), F.lit(False)).alias("has_options"))


def weighted_sentiment(posts: DataFrame) -> DataFrame:
    c = credibility(posts)
    w = F.round(F.col("credibility") * 1000).cast("long")
    tone = (F.col("bull") - F.col("bear")) / (F.col("bull") + F.col("bear") + 1)
    s = F.coalesce(F.try_divide(F.sum(w * tone), F.sum(w)), F.lit(0.0))
    return c.groupBy("source").agg(F.count("*").alias("mentions"), F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)), 6).alias("sentiment"), F.round(F.avg(F.col("has_options").cast("double")), 6).alias("options_intent"))


def top_posts(posts: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("credibility"), "id")
    return credibility(posts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("source", "rank", "id", "credibility")
