"""Token counts with a digest cache.

The cache is a Parquet table (digest, n_tokens) with a folder for each digest of a tokenizer's file: the 256-bit digest
of the normalised content (null becomes the empty text; nothing else is changed, so that equal digests mean equal
counts). A run joins the distinct digests of its texts to the cache, encodes one text of each missing digest, appends
the new counts to the cache and joins all counts back to the rows. A second run over the same texts encodes nothing.
The registered query keeps its cache at one place in the shared folder, for all runs and tables.

Skew: texts of a hot digest meet as partial aggregates; the join back has an exchange on both sides, so AQE splits a
hot digest. Each run appends a folder of its own, by Spark's commit; a run that dies leaves no half-written counts. Two runs
at once can both append one digest; reads take the distinct rows.

Edge cases: null and empty texts count 0 tokens and 0 bytes; repeated rows are counted each; a null doc_id stays null;
an empty table gives an empty result; an unpaired surrogate can't occur in a Spark string."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir, stored, table
from tidemark.llm.tokens import json_tokenizer, public_path, sentencepiece_model

LIMIT = 4096
CACHE_SCHEMA = "digest binary, n_tokens long"


class PieceCounter:
    """Numbers of pieces as a SentencePiece model gives them, without begin and end."""

    def __init__(self, path: str):
        self.sp = sentencepiece_model(path)

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(self.sp.encode(t)) for t in texts]


class JsonCounter:
    """Numbers of tokens as a tokenizers file gives them, without added tokens."""

    def __init__(self, path: str):
        self.tok = json_tokenizer(path)

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(self.tok.encode(t, add_special_tokens=False).ids) for t in texts]


def counter(path: str):
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text). cache: the cache table's folder."""
    spark, version = docs.sparkSession, file_digest(tokenizer)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # one folder a tokenizer, in it one a run; this run's own is empty when the known digests' files are listed
    home = f"{cache}/tokenizer={version}"
    own = f"{home}/run=r{uuid.uuid4().hex}"
    spark.createDataFrame([], CACHE_SCHEMA).write.parquet(own)
    known = spark.read.schema(CACHE_SCHEMA).parquet(home)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(count(batch.column("text").to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    # the cache is joined once, to the batch's distinct digests; all that follows has the batch's size
    asked = keyed.select("digest").distinct().join(known.hint("merge"), "digest", "left").groupBy("digest").agg(F.first("n_tokens", True).alias("n_tokens"))
    asked = stored(asked, "asked")
    texts = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = texts.join(asked.where("n_tokens is null").select("digest").hint("merge"), "digest", "left_semi")
    misses.select("digest", "text").mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(own)

    counts = asked.where("n_tokens is not null").unionByName(spark.read.schema(CACHE_SCHEMA).parquet(own))
    rows = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    # two scans with an exchange of their own on either side of the join, so that AQE can split a hot digest
    return rows.join(counts.hint("merge"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"), f"{shared_dir(spark)}/token-cache")
