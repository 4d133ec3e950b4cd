"""The search over tiers against cases worked by hand."""

import datetime
import math

import pytest

from tidemark.operators import tiers

DAY = datetime.date(2026, 1, 5)


def later(n):
    return DAY + datetime.timedelta(n)


def chain(spark, rows):
    full = [(t, later(dte), kind, float(k), bid, ask, oi, 0.3, delta, n) for n, (t, dte, kind, k, bid, ask, oi, delta) in enumerate(rows)]
    return spark.createDataFrame(full, "ticker string, expiry date, type string, strike double, bid double, ask double, oi long, iv double, delta double, row long")


def candidate(k, ticker="A", **more):
    base = dict(candidate_id=k, ticker=ticker, run_date=DAY, price=100.0, target=120.0, direction="BULLISH", dte_floor=14, catalyst_type="FDA", hit_rate=0.65, iv_rank=30.0, gamma="neutral", vix=20.0, vix_structure="flat")
    return base | more


KINDS = "candidate_id long, ticker string, run_date date, price double, target double, direction string, dte_floor int, catalyst_type string, hit_rate double, iv_rank double, gamma string, vix double, vix_structure string"


def search(spark, candidates, rows, **more):
    df = spark.createDataFrame([tuple(c.values()) for c in candidates], KINDS)
    return {r["candidate_id"]: r for r in tiers.tier_search(df, chain(spark, rows), **more).collect()}


# one dear short contract (theta), a middle one with a wide market, a long one that passes
ROWS = [
    ("A", 20, "call", 101, 0.485, 0.5, 500, 0.6), ("A", 90, "call", 101, 3.0, 4.0, 500, 0.6), ("A", 90, "call", 102, 3.9, 4.0, 120, 0.6), ("A", 200, "call", 104, 5.9, 6.0, 300, 0.6), ("A", 200, "call", 103, 5.9, 6.0, 300, 0.6),
    ("A", 200, "call", 114, 2.0, 2.2, 10, 0.3), ("A", 200, "call", 112, 2.5, 2.6, 10, 0.3), ("A", 200, "put", 99, 4.9, 5.0, 300, -0.4),
]


def test_first_tier_that_passes(spark):
    got = search(spark, [candidate(1), candidate(2, dte_floor=61), candidate(3, dte_floor=120), candidate(4, dte_floor=400), candidate(5, "none"), candidate(6, target=101.0, dte_floor=61), candidate(7, price=0.0)], ROWS)
    # 20 days: theta of 100 * N'(d1) * .3 / (2 sqrt(T)) / 365 = .068 a day on .5 is above 3 %; so the 90-day contract is taken
    assert (got[1]["tier"], got[1]["tried"], got[1]["strike"], got[1]["dte"]) == ("Mid-Term", "theta,pass", 102.0, 90)
    assert (got[2]["tier"], got[2]["tried"]) == ("Mid-Term", "below_floor,pass")
    assert (got[3]["tier"], got[3]["strike"], got[3]["expiry"]) == ("Long-Term", 103.0, later(200))  # equal interest: lower strike
    assert (got[4]["tier"], got[4]["tried"], got[4]["best_tier"]) == ("no tier", "below_floor,below_floor,below_floor", None)
    assert got[5]["tried"] == got[7]["tried"] == "no_contract,no_contract,no_contract" and got[5]["roi_net"] is None
    assert got[6]["tried"] == "below_floor,roi,roi" and got[6]["best_gap"] < 0
    t = 90 / 365
    d1 = (math.log(100 / 102) + 0.045 * t) / (0.3 * math.sqrt(t))
    vega = 100 * math.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) * math.sqrt(t)
    roi = 0.2 * 0.6 * 25 * 0.65 - 2 * 0.1 / 4 - min(vega * 0.3 * 0.22 * 0.65 / 4, 0.5) - 1.3 / 400
    assert math.isclose(got[1]["roi_net"], roi, abs_tol=2e-5) and got[1]["min_roi"] == 0.102 and math.isclose(got[1]["edge"], 0.2 - 0.06, abs_tol=1e-5)


def test_spreads_and_single_contracts(spark):
    """103: legs in [108.15, 123.6] nearest to 113.3 is 114, ahead of 112."""
    wide = candidate(1, iv_rank=80.0, dte_floor=150)
    spread = search(spark, [wide], ROWS)[1]
    assert (spread["strategy"], spread["k2"], spread["net_debit"]) == ("BULL_CALL_SPREAD", 114.0, 4.0)
    bare = [r for r in ROWS if r[3] not in (112, 114)]
    kept, single = search(spark, [wide], bare)[1], search(spark, [wide], bare, leg_required=True)[1]
    assert (kept["strategy"], kept["k2"], kept["net_debit"]) == ("BULL_CALL_SPREAD", None, None)
    assert (single["strategy"], single["net_debit"]) == ("LONG_CALL", None) and single["roi_net"] > kept["roi_net"]
    dead = bare + [("A", 200, "call", 113, 0.0, 1.0, 10, 0.3)]  # a leg without a bid is none
    assert search(spark, [wide], dead, leg_required=True)[1]["strategy"] == "LONG_CALL"
    puts = search(spark, [candidate(1, direction="BEARISH", iv_rank=80.0, dte_floor=150)], ROWS)[1]
    assert (puts["tier"], puts["tried"], puts["best_tier"]) == ("no tier", "below_floor,below_floor,roi", "Long-Term")  # a put's delta is negative
    assert search(spark, [candidate(1, iv_rank=50.0, gamma="positive", dte_floor=150)], ROWS)[1]["strategy"] == "BULL_CALL_SPREAD"


def test_filters_of_contracts(spark):
    rows = [
        ("A", 90, "call", 100, 3.9, 4.0, 99, 0.6), ("A", 90, "call", 100.5, 3.5, 4.0, 900, 0.6), ("A", 90, "call", 116, 3.9, 4.0, 900, 0.6), ("A", 90, "call", 84, 3.9, 4.0, 900, 0.6),
        ("A", 90, "call", 103, 3.9, 4.0, 800, 0.3), ("A", 90, "call", 104, 3.9, 4.0, 110, 0.7), ("A", 120, "call", 101, 3.9, 4.0, 900, 0.6),
    ]
    got = search(spark, [candidate(1, dte_floor=61)], rows)[1]
    assert got["strike"] == 104.0  # too little interest, too wide, too far off, too low, no delta in the range; the first expiry counts
    assert search(spark, [candidate(1, dte_floor=61)], rows[:5])[1]["strike"] == 103.0  # no delta in the range at all: any


def test_expected_profit_gate(spark):
    pnl = spark.createDataFrame([(1, 2, 0.5, 0.2), (2, 2, 0.1, 0.2), (3, 2, 0.9, 0.05), (3, 3, 0.9, 0.2)], "candidate_id long, tier_no int, pnl_mean double, pnl_median double")
    got = search(spark, [candidate(k, dte_floor=61) for k in (1, 2, 3, 4)], ROWS, pnl=pnl)
    assert [(got[k]["tier"], got[k]["tried"]) for k in (1, 2, 3, 4)] == [("Mid-Term", "below_floor,pass"), ("Long-Term", "below_floor,pnl,pass"), ("Long-Term", "below_floor,pnl,pass"), ("Mid-Term", "below_floor,pass")]


def test_prices_expiries_and_precheck(spark):
    bars = spark.createDataFrame([("A", later(-3), 90.0), ("A", later(0), 100.0), ("A", later(1), 110.0), ("B", later(2), 5.0)], "ticker string, d date, close double")
    needs = spark.createDataFrame([("A", later(-9)), ("A", later(-1)), ("A", DAY), ("A", DAY), ("B", DAY), ("C", DAY)], "ticker string, run_date date")
    got = {(r["ticker"], r["run_date"]): r["price"] for r in tiers.last_close(needs, bars).collect()}
    assert got == {("A", later(-9)): None, ("A", later(-1)): 90.0, ("A", DAY): 100.0, ("B", DAY): None, ("C", DAY): None}
    rows = [("A", 13, "call", 1, 1.0, 1.0, 1, None), ("A", 14, "call", 1, 1.0, 1.0, 1, None), ("A", 60, "call", 1, 1.0, 1.0, 1, None), ("A", 366, "call", 1, 1.0, 1.0, 1, None)]
    ask = spark.createDataFrame([("A", DAY), ("A", later(1))], "ticker string, run_date date")
    found = {(r["run_date"], r["tier_no"]): r["dte"] for r in tiers.first_expiries(ask, chain(spark, rows), tiers.RANGES).collect()}
    assert found == {(DAY, 1): 14, (later(1), 1): 59, (later(1), 3): 365}
    quick = [("A", 30, "call", 101, 0.45, 0.5, 500, 0.6), ("B", 30, "call", 101, 0.9, 1.0, 500, 0.05)]  # B: .26 of delta less .2 of market, .49 of vega and .01 of fees
    df = spark.createDataFrame([tuple(candidate(k, t, direction="BEARISH").values()) for k, t in ((1, "A"), (2, "B"), (3, "C"))], KINDS)
    got = {r["candidate_id"]: (r["strike"], r["roi_net"] > 0, r["stays"]) for r in tiers.precheck(df, chain(spark, quick)).collect() if r["strike"]}
    assert got == {1: (101.0, True, True), 2: (101.0, False, False)}
    assert [r["stays"] for r in tiers.precheck(df, chain(spark, quick)).where("candidate_id = 3").collect()] == [True]


@pytest.mark.parametrize("pnl", [False, True])
def test_empty(spark, pnl):
    df = spark.createDataFrame([], KINDS)
    table = spark.createDataFrame([], "candidate_id long, tier_no int, pnl_mean double, pnl_median double") if pnl else None
    assert tiers.tier_search(df, chain(spark, ROWS), table).collect() == []
