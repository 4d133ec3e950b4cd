"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a hash of the key. It starts as one bucket; only a bucket over the byte
limit is split, on the next bit, until every shard fits. So a document's shard depends on its key and on how full its
own neighbourhood is, and a growing corpus splits single shards instead of moving all.

One pass sums bytes for cells of the first STEP more bits; the splits of all levels follow from those sums, and only
documents in cells that are still over the limit are looked at again with the next bits. Where all 60 bits are used up
the bucket holds rows of one key (or none could fit: one document over the limit); rows that share a key are split by
the bits of a second hash, of their stored row numbers.

Edge cases: a single document over the limit is a shard of its own; null keys hash like the empty string and null
texts have 0 bytes; rows that repeat a key are told apart by row number; an empty table gives an empty result; with
everything within the limit there is one shard, of depth 0. A column of docs that is named like a result's is ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

BITS, STEP = 60, 12
LIMIT = 4 << 20
#: The limit of the registered query: small, so that even small tables are split.
QUERY_LIMIT = 256 << 10


def hash_bits(text: Column) -> Column:
    """The first 60 bits of the md5 digest."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _round(rows: DataFrame, depth: int, limit: int) -> DataFrame:
    """base, cell, prefix, depth, shard_bytes, shard_docs: where the documents of each cell of depth + STEP bits belong;
    prefix is null if the cell must be split further."""
    deep = depth + STEP
    cells = stored(rows.groupBy("base", F.shiftright("h", BITS - deep).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "cells")
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(deep)))).withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
    sums = levels.groupBy("base", "depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = stored(sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)), "fits")
    leaf = levels.join(fits, ["base", "depth", "prefix"]).groupBy("base", "cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("x"))
    return stored(cells.select("base", "cell").join(leaf, ["base", "cell"], "left").select("base", "cell", "x.*"), "directory")


def _assigned(rows: DataFrame, limit: int) -> tuple[DataFrame | None, DataFrame]:
    """Rows (row, doc_id, n_bytes, base, h) with their shards, and those that all bits couldn't place."""
    done, depth = None, 0
    while depth < BITS:
        directory = _round(rows, depth, limit)
        joined = rows.withColumn("cell", F.shiftright("h", BITS - depth - STEP)).join(directory, ["base", "cell"]).drop("cell")
        placed = joined.where("depth is not null")
        done = placed if done is None else done.unionByName(placed)
        if directory.where("depth is null").isEmpty():
            return done, rows.limit(0)
        rows = stored(joined.where("depth is null").drop("depth", "prefix", "shard_bytes", "shard_docs"), "over")
        depth += STEP
    return done, rows


def shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, shard (its bits; after a dash those that split one key), depth, shard_bytes, shard_docs."""
    h = hash_bits(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"), h.alias("h"))
    # stored, so that row numbers are drawn once
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("base", F.lit(-1).cast("long")), "rows")
    done, rest = _assigned(rows, limit)
    bits = lambda n, width: F.expr(f"if({width} = 0, '', lpad(bin({n}), {width}, '0'))")
    shown = lambda df, name: df.select("doc_id", "n_bytes", name.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs")
    out = shown(done, bits("prefix", "depth"))
    if not rest.isEmpty():
        again = rest.withColumn("base", F.col("h")).withColumn("h", hash_bits(F.col("row").cast("string")))
        done, _ = _assigned(again, limit)
        out = out.unionByName(shown(done.withColumn("under", F.col("depth")).withColumn("depth", F.col("under") + BITS), F.concat(bits("base", BITS), F.lit("-"), bits("prefix", "under"))))
    return out


def write_shards(docs: DataFrame, folder: str, limit: int = LIMIT, key: str = "doc_id") -> None:
    """Write docs as Parquet, one folder a shard. The key must be unique here: it joins rows to their shards."""
    placed = shards(docs, limit, key).select(F.col("doc_id").alias(key), "shard")
    docs.join(placed, key).repartition("shard").write.partitionBy("shard").parquet(folder)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_LIMIT)


_H = f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}) AS BIGINT)"
#: For keys that are unique, or whose rows fit one shard together.
OP10_SQL = f"""
WITH rows AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, {_H} AS h FROM documents),
levels AS (SELECT rows.*, d::INTEGER AS depth, h >> ({BITS} - d)::INTEGER AS prefix FROM rows, range(0, {BITS + 1}) r(d)),
sums AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM levels GROUP BY ALL),
fits AS (SELECT l.doc_id, l.n_bytes, l.depth, l.prefix, s.shard_bytes, s.shard_docs,
         row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) AS rn
         FROM levels l JOIN sums s USING (depth, prefix) WHERE s.shard_bytes <= {QUERY_LIMIT} OR s.shard_docs = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, shard_bytes, shard_docs
FROM fits WHERE rn = 1
"""
