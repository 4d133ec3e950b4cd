"""Findings of round 4: rows that tell the engines apart, plans, and answers that must not change."""

import datetime

import pytest

from tests.test_round3 import AT, assert_as_sql
from tidemark.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["running_peak", "exit_first_fire", "exit_table", "trailing_stop", "shadow_outcome", "stream_exits"])
def test_outcomes_at_exact_halves(spark, tmp_path, name):
    """64.19 / 32 - 1 is 1.0059375, and the double next to it lies under that."""
    values = {1: [32.0, 64.19, 82.66, 30.01], 2: [32.0, 160.73, 49.69, 2.31], 3: [32.0, 33.11, 34.29, 53.57], 4: [128.0, 129.37, 128.11, 500.03], 5: [0.0, 1.0, 0.0, 2.0]}
    rows = [(10 * u + k, AT + datetime.timedelta(days=9 * k), u, "view", v, "{}") for u, vs in values.items() for k, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert_as_sql(spark, tmp_path, name)


def exchanges(spark, name):
    """How often the plan of a query shuffles, if no table is small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        return sum("Exchange " in line for line in plan.split("\n"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["tier_search", "tier_search_legs"])
def test_tier_search_shuffles_each_table_once(spark, name):
    assert exchanges(spark, name) <= 13  # 35 before


def test_precheck_shuffles_each_table_once(spark):
    assert exchanges(spark, "roi_precheck") <= 8  # 30 before


def test_a_tier_under_the_floor_needs_no_contract(spark):
    """An unknown floor is no floor; a day's lowest floor says which tiers are looked for."""
    from tests.test_tiers import ROWS, candidate, search

    got = search(spark, [candidate(1, dte_floor=None), candidate(2, dte_floor=150), candidate(3, dte_floor=61), candidate(4, "B", dte_floor=400)], ROWS)
    assert [(got[k]["tier"], got[k]["tried"]) for k in (1, 2, 3, 4)] == [("Mid-Term", "theta,pass"), ("Long-Term", "below_floor,below_floor,pass"), ("Mid-Term", "below_floor,pass"), ("no tier", "below_floor,below_floor,below_floor")]


def test_prices_and_gammas_of_the_run_day(spark):
    """With bars and gammas a candidate's price, target and gamma are those that it would bring itself."""
    from pyspark.sql import functions as F

    from tests.test_tiers import DAY, KINDS, ROWS, candidate, chain, later
    from tidemark.operators import tiers

    base = [candidate(k, t, iv_rank=50.0, dte_floor=150, direction=d) for k, (t, d) in enumerate([("A", "BULLISH"), ("A", "BEARISH"), ("none", "BULLISH"), ("A", None)])]
    whole = spark.createDataFrame([tuple((c | dict(gamma="positive")).values()) for c in base], KINDS)
    bare = whole.drop("price", "target", "gamma").withColumn("target_move", F.lit(0.2))
    bars = spark.createDataFrame([("A", later(-3), 100.0), ("A", later(1), 500.0), ("none", DAY, 7.0)], "ticker string, d date, close double")
    gammas = spark.createDataFrame([("A", DAY.replace(day=1), "positive"), ("none", DAY.replace(day=1), "negative")], "ticker string, run_month date, gamma string")
    want = sorted(map(tuple, tiers.tier_search(whole, chain(spark, ROWS)).collect()))
    assert sorted(map(tuple, tiers.tier_search(bare, chain(spark, ROWS), bars=bars, gammas=gammas).collect())) == want
    assert want[0][1:4] == ("Long-Term", "below_floor,below_floor,pass", "BULL_CALL_SPREAD")
    old = gammas.withColumn("run_month", F.date_sub("run_month", 31))  # another month's gamma isn't this one's
    assert [r["strategy"] for r in tiers.tier_search(bare, chain(spark, ROWS), bars=bars, gammas=old).where("candidate_id = 0").collect()] == ["LONG_CALL"]


@pytest.mark.parametrize("name", ["position_value", "trade_outcome"])
def test_valuation_shuffles_each_table_once(spark, name):
    assert exchanges(spark, name) <= 11  # 22 before


def test_mids_by_brute_force(spark):
    """Strikes at and beside the ends of steps, several contracts a strike, both types, ids that repeat or are missing."""
    import random

    from tidemark.operators import valuation

    r = random.Random(4)
    some = lambda: round(r.choice([0.5, 1.0, 1.5, 7.25]) + r.randrange(-3, 4) / 100 + r.choice([0, 0, 0.004]), 3)
    day = AT.date()
    chain = [(r.choice("AB"), day, r.choice(["call", "put"]), some(), r.choice([0.0, 1.0, 2.5]), r.choice([0.0, None, 3.0, 4.1]), n) for n in range(120)]
    rows = [(n % 70 if n else None, r.choice("ABC"), day, day + datetime.timedelta(r.choice([0, 0, -1, 1])), r.choice(["call", "put"]), some(), r.choice([None, 0.0, some()])) for n in range(90)]
    rows += rows[-1:]

    def mid(ticker, value_day, kind, strike):
        near = [(c[2] != kind, round(abs(c[3] - strike), 6), c[6], c[4], c[5]) for c in chain if c[0] == ticker and (c[5] or 0) > 0 and round(abs(c[3] - strike), 6) <= 0.01] if strike and value_day <= day else []
        return round((min(near)[3] + min(near)[4]) / 2 + 1e-9, 4) if near and min(near)[3] > 0 else min(near)[4] if near else None

    want = [(i, t, v, k, s, x, mid(t, v, k, s) if i is not None else None, mid(t, v, k, x) if i is not None else None) for i, t, _, v, k, s, x in rows]
    positions = spark.createDataFrame(rows, "trade_id long, ticker string, expiry date, value_day date, type string, strike double, short_strike double")
    got = valuation.with_mids(positions, spark.createDataFrame(chain, "ticker string, expiry date, type string, strike double, bid double, ask double, row long")).drop("expiry")
    assert sorted(map(repr, map(tuple, got.select("trade_id", "ticker", "value_day", "type", "strike", "short_strike", "long_mid", "short_mid").collect()))) == sorted(map(repr, want))
    assert sum(w[6] is not None for w in want) > 20
