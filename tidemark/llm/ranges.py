"""Rows in the order of a key over many tasks, and running totals over tasks."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) dealt out in ranges of doc_id and sorted within them; equal ids are told apart by their text."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    return keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")


def with_base(rows: DataFrame, amount: str, name: str) -> DataFrame:
    """rows(part, ...) with `name`: the sum of `amount` over all parts before its own. One row a task is gathered."""
    sums = sorted(rows.groupBy("part").agg(F.sum(amount)).collect())
    base = accumulate((n for _, n in sums), initial=0)
    small = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sums, base)], f"part int, `{name}` long")  # noqa: B905
    return rows.join(F.broadcast(small), "part")
