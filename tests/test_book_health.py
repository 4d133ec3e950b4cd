"""Slots and checks by hand, and with one input broken."""

import datetime

import pytest

from tidemark.operators import book_health as bh

DAY = datetime.date(2026, 6, 1)


def ago(n):
    return DAY - datetime.timedelta(n)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


TRAILING, CLOSED, BOOK = "tp_outcome string, trailing_outcome string", "strategy string, outcome string", "sector string, outcome string, source string, reject_reason string"


def slots(spark, trailing, closed, book):
    given = lambda rows, schema: rows if callable(rows) else lambda: frame(spark, rows, schema)
    got = bh.slot_summary(spark, given(trailing, TRAILING), given(closed, CLOSED), given(book, BOOK)).collect()
    return {r["name"]: (r["n"], r["recommendation"], r["ready"], r["finding"]) for r in got}


def test_slots(spark):
    trailing = [("0.5", "0.6")] * 5 + [("0.5", None), ("x", "0.1"), (None, None)]
    closed = [("BULL_CALL_SPREAD", "-0.2")] * 10 + [("LONG_CALL", "0.2")] * 10 + [("LONG_PUT", "n/a"), (None, "9"), ("other", "9"), ("LONG_CALL", "NaN")]
    book = [("XLK", "0.8", "closed", None)] * 15 + [("XLE", "-0.3", "closed", None)] * 5 + [("XLV", "-0.2", "shadow", "final_mc_survivor")] * 3 + [("XLU", "9", "shadow", "score_44"), ("", "9", "closed", None), (None, "9", "closed", None)]
    got = slots(spark, trailing, closed, book)
    assert got["trailing_stop"] == (5, "trail profits", True, "take profit 5000, trailing 6000, delta 1000")
    assert got["spreads_vs_single"] == (20, "raise the gate of spreads", True, "spreads 10 at -2000, single 10 at 2000")
    assert got["sectors"] == (23, "only XLK", True, "3 sectors, best XLK, worst XLE")
    few = slots(spark, trailing[:3], [("LONG_CALL", "0.12")] * 6 + [("A_SPREAD", "0.1")] * 6, book[:12])
    assert [(v[0], v[1], v[2]) for v in few.values()] == [(3, bh.WAIT, False), (12, bh.WAIT, False), (12, bh.WAIT, False)]
    near = slots(spark, [], [("A_SPREAD", "0.10")] * 10 + [("LONG_CALL", "0.12")] * 10, [("XLK", None, "closed", None)] * 25)
    assert near["spreads_vs_single"][1:3] == (None, True) and near["sectors"] == (25, None, True, "no sector has enough") and near["trailing_stop"][:3] == (0, bh.WAIT, False)


@pytest.mark.parametrize("broken", range(3))
def test_a_broken_slot_leaves_the_others_alone(spark, broken):
    good = [lambda: frame(spark, [("0.5", "0.6")] * 5, TRAILING), lambda: frame(spark, [("A_SPREAD", "0.1"), ("LONG", "0.1")] * 10, CLOSED), lambda: frame(spark, [("XLK", "0.1", "closed", None)] * 20, BOOK)]
    bad = [lambda: spark.read.parquet("/nowhere/at/all"), lambda: spark.range(3), lambda: spark.range(30).selectExpr("cast(cast(concat('x', id) as int) as string) as sector", "'1' as outcome", "'closed' as source", "'' as reject_reason")][broken]
    got = slots(spark, *[bad if k == broken else g for k, g in enumerate(good)])
    assert [v[2] for v in got.values()] == [k != broken for k in range(3)]
    assert list(got.values())[broken][3].startswith("failed: ")


def test_checks(spark):
    w = lambda *rows: tuple(bh.weights_check(frame(spark, list(rows), "feature string, weight string")).first())
    assert w(("impact", "0.3"), ("eps", "0")) == (False, None) and w(("b", "NaN"), ("a", "NaN"), ("c", "1")) == (True, "NaN: a,b") and w(("a", "0"), ("b", "0.0"), ("c", "x")) == (True, "all 0") and w() == (False, None)
    active = frame(spark, [("A", str(ago(76))), ("B", str(ago(75))), ("C", str(ago(200))), (None, str(ago(80))), ("D", "soon"), ("E", None)], "ticker string, entry_date string")
    assert tuple(bh.overdue_check(active, str(DAY)).first()) == (True, "3 overdue: C 200, ? 80, A 76")
    assert tuple(bh.overdue_check(active.limit(0), str(DAY)).first()) == (False, None)
    r = lambda *rows: tuple(bh.reports_check(frame(spark, list(rows), "run_date date, universe long, vix string"), str(DAY)).first())
    assert r((ago(1), 500, "18.2"), (ago(9), 0, None)) == (False, None) and r() == (True, "no reports")
    assert r((ago(6), 0, None)) == (True, "last report 6 days old, universe 0, no volatility") and r((ago(1), None, "n/a")) == (True, "universe 0, no volatility")


def test_health_of_a_book(spark):
    fine = lambda: bh.weights_check(frame(spark, [("a", "1")], "feature string, weight string"))
    got = {r["check"]: (r["warned"], r["message"]) for r in bh.book_health(spark, {"weights": fine, "reports": lambda: spark.table("no_such_table")}).collect()}
    assert got == {"weights": (False, None), "reports": (True, "failed: AnalysisException"), "status": (True, "WARN")}
    assert {r["check"]: r["message"] for r in bh.book_health(spark, {"weights": fine}).collect()} == {"weights": None, "status": "OK"}
