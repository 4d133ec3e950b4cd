"""Joins on an aggregate have an exchange of their own on both sides, with the salt among the keys, and lose nothing."""

import re

from tidemark.functions.joins import salted_join
from tidemark.operators import lifecycle, options
from tidemark.sources import adapters

DIR = "/root/testdata/sf0.001"


def joins(df):
    """Of each sort-merge join: its keys and whether each side is a sort of an exchange."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda s: len(re.match(r"[\s:+-]*", s)[0])
    out = []
    for k, line in enumerate(lines):
        if "SortMergeJoin" in line:
            below = [j for j in range(k + 1, len(lines)) if depth(lines[j]) <= depth(line) + 3 and depth(lines[j]) > depth(line)][:2]
            out.append((re.search(r"SortMergeJoin(?:\(.*?\))? \[(.*?)\]", line)[1], all("Sort" in lines[j] and "Exchange" in lines[j + 1] for j in below)))
    return out


def test_plans(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marks, chain = adapters.marks(spark, DIR), adapters.chain(spark, DIR)
        for df in (lifecycle.outcomes(marks), lifecycle.first_exit(marks, 14), lifecycle.running_peak(marks), options.priced(chain), options.dealer_gamma(chain)):
            found = joins(df)
            assert found and all("_salt" in keys and whole for keys, whole in found), found
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_key_meets_its_aggregate_in_several_tasks(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id % 50) as k", "id as v", "cast(null as string) as n")
    few = rows.groupBy("k").count()
    got = salted_join(rows, few, ["k"], "v")
    assert got.columns == ["k", "v", "n", "count"] and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(few, "k").collect()), key=str)
    salts = rows.selectExpr("pmod(xxhash64(v), 8) as s").groupBy("s").count().collect()
    assert len(salts) == 8
