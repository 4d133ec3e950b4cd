"""Company facts: nested documents whose keys are data, read by path as VARIANT.

A document is `{"cik": n, "entityName": s, "facts": {taxonomy: {tag: {"units": {unit: [{"end", "val", "form", ...}]}}}}}`. Tags and units
are keys, so no schema lists them: the object is taken apart level by level, and each level is rows before the next one is opened, so
that a large document costs its own size and no more. What isn't sound is counted, not dropped in silence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags of earnings per share, what they are called here, and their unit.
EPS_TAGS = {"EarningsPerShareBasic": "basic", "EarningsPerShareDiluted": "diluted"}
EPS_UNIT = "USD/shares"


def fact_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, body: the documents below a folder, one a file; an empty file holds none."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))


def parsed(documents: DataFrame) -> DataFrame:
    """documents with `doc`: the body as a variant, NULL where it is no sound JSON."""
    return documents.withColumn("doc", F.try_parse_json("body"))


def unsound(documents: DataFrame) -> DataFrame:
    """One row: documents, those that aren't JSON, and those without facts."""
    p = parsed(documents)
    facts = F.try_variant_get("doc", "$.facts", "variant")
    return p.agg(F.count("*").alias("documents"), F.count_if(F.col("doc").isNull()).alias("broken"), F.count_if(F.col("doc").isNotNull() & (facts.isNull() | (F.schema_of_variant(facts) == "VOID"))).alias("without_facts"))


def facts(documents: DataFrame, taxonomy: str = "us-gaap", tags: tuple[str, ...] | None = None) -> DataFrame:
    """cik, tag, unit, position, form, end_date, value, one row a reported figure of documents(body, ...): all of the taxonomy's tags, or
    the given ones. Broken documents, missing levels and levels of another kind give no rows; a field of another kind is NULL."""
    spark = documents.sparkSession
    wanted = "" if tags is None else f"WHERE t.key IN ({', '.join(repr(t) for t in tags)})"
    rows = parsed(documents).select(F.try_variant_get("doc", "$.cik", "bigint").alias("cik"), F.try_variant_get("doc", f"$.facts['{taxonomy}']", "variant").alias("tags")).where("tags is not null")
    rows = spark.sql(f"SELECT cik, t.key AS tag, try_variant_get(t.value, '$.units', 'variant') AS units FROM {{rows}}, LATERAL variant_explode(tags) AS t {wanted}", rows=rows)
    rows = spark.sql("SELECT cik, tag, u.key AS unit, u.value AS figures FROM {rows}, LATERAL variant_explode(units) AS u WHERE tag IS NOT NULL AND u.key IS NOT NULL", rows=rows)
    rows = spark.sql("SELECT cik, tag, unit, f.pos AS position, f.value AS figure FROM {rows}, LATERAL variant_explode(figures) AS f", rows=rows)
    field = lambda name, kind: F.try_variant_get("figure", f"$.{name}", kind)
    return rows.select("cik", "tag", "unit", "position", field("form", "string").alias("form"), F.try_to_date(field("end", "string")).alias("end_date"), field("val", "double").alias("value"))


def eps_filings(documents: DataFrame, registered: DataFrame) -> DataFrame:
    """ticker, tag, form, end_date, value, filing_id as `trailing_eps` reads them, of the companies in registered(ticker, cik), whose
    numbers are ten digits wide."""
    rows = facts(documents, tags=tuple(EPS_TAGS)).where(F.col("unit") == EPS_UNIT)
    tag = F.element_at(F.create_map(*[F.lit(x) for kv in EPS_TAGS.items() for x in kv]), F.col("tag"))
    rows = rows.select(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), tag.alias("tag"), "form", "end_date", "value", F.col("position").cast("long").alias("filing_id"))
    return rows.join(registered.select("ticker", "cik"), "cik").drop("cik")
