"""Joins that a hot key can't stall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(rows: DataFrame, few: DataFrame, keys: list[str], by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Inner or left join of many rows with `few` rows a key (an aggregate of them, say). Each key is dealt out over `salts` partitions by the hash
    of the column `by`, which tells its rows apart, and `few` is there once for each: an aggregate is partitioned by its keys already, so without the salt the join
    would shuffle only one side, and neither AQE nor anything else could split a hot key. The number of `few` grows by `salts`, so these
    have to be far fewer than the rows; else see `paired_join`."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def paired_join(rows: DataFrame, others: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Inner or left join with about as many rows on either side, each shuffled once and none copied. The salt is of the key itself: it
    only gives both sides an exchange of their own, so that AQE can split a hot key."""
    salt = F.pmod(F.xxhash64(keys[0]), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(others.withColumn("_salt", salt), [*keys, "_salt"], how).drop("_salt")
