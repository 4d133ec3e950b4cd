"""Substring joins by an index of grams: which texts contain which needles, without comparing each with each.

A text is cut into short pieces, each of which reaches as far into the next as the longest needle does, so that a needle lies whole in one
of them and reading a place in a text costs the same wherever it is. A piece is indexed by its grams of up to three characters. Each needle
is looked up by the one of its grams that is rarest in the texts, and only the pieces that hold it are searched for it. So the rows between
are those of the rarest grams, and a needle with a gram that no text holds costs nothing.

Needles and their grams are stored, so that Spark knows their size: few ones are broadcast, and then no text is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.words import SPACES, lower, upper
from tidemark.streaming.shared import folder

GRAM = 3
#: Characters of a piece, and of the stretches that pieces are cut from: finding a piece takes time in proportion to what is before it.
PIECE, STRETCH = 64, 16_384


def stored(rows: DataFrame, label: str) -> DataFrame:
    where = folder(rows.sparkSession, label)
    rows.write.parquet(where)
    return rows.sparkSession.read.schema(rows.schema).parquet(where)


def grams(text: str, size: int) -> Column:
    """The distinct substrings of this size."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def pieces(texts: DataFrame, width: int, overlap: int) -> DataFrame:
    """id, text: a piece from every `width` characters of texts(id, text), with the next `overlap` ones."""
    at = F.explode(F.expr(f"sequence(0, cast((length(text) - 1) div {width} as int))"))
    return texts.select("id", "text", at.alias("at")).select("id", F.substring("text", F.col("at") * width + 1, F.lit(width + overlap)).alias("text"))


def _indexed(rows: DataFrame, least: int, most: int) -> DataFrame:
    """id, text, gram: for each place of a text the grams of these sizes that begin there, cut off at its end."""
    n = most - least + 1
    at = F.explode(F.expr(f"sequence(0, length(text) * {n} - 1)"))
    return rows.select("id", "text", at.alias("at")).select("id", "text", F.expr(f"substring(text, at div {n} + 1, at % {n} + {least})").alias("gram"))


def candidates(texts: DataFrame, needles: DataFrame, gram: int = GRAM) -> DataFrame:
    """id, text, needle: pieces and the needles to search in them, from texts(id, text) and needles(needle), not empty. Rows may repeat.
    Needles of no more than a gram's size are grams themselves, so only those of longer ones are counted."""
    needles = stored(needles, "needles")
    keys = stored(needles.where(F.length("needle") > gram).select("needle", F.explode(grams("needle", gram)).alias("gram")), "needle-grams")
    overlap = (needles.agg(F.max(F.length("needle"))).first()[0] or 1) - 1
    cut = pieces(pieces(texts, max(STRETCH, overlap), overlap), max(PIECE, overlap), overlap)
    held = _indexed(cut, gram, gram).join(keys.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("places"))
    rarest = keys.join(held, "gram").groupBy("needle", F.size(grams("needle", gram)).alias("n")).agg(F.count("*").alias("found"), F.min(F.struct("places", "gram")).alias("x"))
    rarest = rarest.where("found = n").select("needle", F.col("x.gram").alias("gram")).unionByName(needles.where(F.length("needle") <= gram).select("needle", F.col("needle").alias("gram")))
    return _indexed(cut, 1, gram).join(stored(rarest, "rarest-grams"), "gram").select("id", "text", "needle")


def containing(texts: DataFrame, needles: DataFrame, gram: int = GRAM) -> DataFrame:
    """id, needle for each text that contains a needle, whatever their case. Rows that repeat an id are one text each; empty and missing
    texts and needles are in no pair."""
    low = texts.select("id", lower(F.col("text")).alias("text")).where("text <> ''")
    want = needles.select(lower(F.col("needle")).alias("needle")).where("needle <> ''").distinct()
    return candidates(low, want, gram).where(F.contains("text", F.col("needle"))).select("id", "needle").distinct()


def first_word(name: Column) -> Column:
    return F.get(F.split(F.trim(name, F.lit(SPACES)), r"[\t\n\f\r ]+"), F.lit(0))


def sponsor_matches(approvals: DataFrame, companies: DataFrame, least: int = 3) -> DataFrame:
    """id, company, word: approvals(id, sponsor) whose sponsor contains the first word of the name of companies(company, name), if that has
    `least` letters. Words that many companies share are searched once."""
    words = companies.select("company", lower(first_word(F.col("name"))).alias("needle")).where(F.length("needle") >= least)
    found = containing(approvals.select("id", F.col("sponsor").alias("text")), words.select("needle"))
    return found.join(words.distinct(), "needle").select("id", "company", upper(F.col("needle")).alias("word"))


def ticker_mentions(posts: DataFrame, tickers: DataFrame, preview: int = 200) -> DataFrame:
    """id, ticker, in_title: posts(id, title, body) whose title, or the first `preview` characters of whose body, contain a ticker as a
    substring (not as a word)."""
    shown = posts.select("id", "title", F.substring("body", 1, preview).alias("start"))
    other = shown.where(~F.coalesce(F.startswith("title", "start"), F.lit(False)))  # else the title holds whatever the start holds
    both = shown.select("id", F.col("title").alias("text"), F.lit(True).alias("in_title")).unionByName(other.select("id", F.col("start").alias("text"), F.lit(False).alias("in_title")))
    found = containing(both.select(F.struct("id", "in_title").alias("id"), "text"), tickers.select(F.col("ticker").alias("needle")))
    return found.groupBy(F.col("id.id").alias("id"), F.upper("needle").alias("ticker")).agg(F.bool_or("id.in_title").alias("in_title"))
