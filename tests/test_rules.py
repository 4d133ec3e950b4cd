"""Formulas against hand-worked cases: gates, exits, sizes, short interest, slots, reports, ledger, feeds, sinks."""

import datetime
import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.sheets import add
from tidemark.operators import ledger, lifecycle, market, options, prices, proposals
from tidemark.sources import adapters, reports

DIR = "/root/testdata/sf0.001"


def frame(spark, rows, **kinds):
    return spark.createDataFrame([tuple(r.get(c) for c in kinds) for r in rows], ", ".join(f"{c} {k}" for c, k in kinds.items()))


def test_mismatch(spark):
    rows = [(9, 0.01, 0.02), (3, 0.08, 0.02), (5, 0.02, 0.02), (8, 0.002, 0.02), (9, 0.01, 0.0)]
    df = spark.createDataFrame([(k, *r, None if k else 0.07) for k, r in enumerate(rows)], "k int, impact_capped int, move_48h double, sigma_30 double, eps_drift double")
    got = [(r["mismatch"], r["bin_mismatch"], r["bin_impact"], r["bin_eps"]) for r in add(df, *proposals.MISMATCH).orderBy("k").collect()]
    assert got == [(6.5, "strong", "high", "relevant"), (-17.0, "weak", "low", "noise"), (0.0, "weak", "mid", "noise"), (7.5, "strong", "high", "noise"), (None, None, "high", "noise")]


def test_exit_rules(spark):
    rows = [("LONG_CALL", None, 1.0, 9, 0.55), ("LONG_CALL", None, 1.0, 9, -0.50), ("LONG_CALL", None, 1.0, 75, 0.05), ("LONG_CALL", None, 1.0, 19, 0.10), ("LONG_CALL", None, 1.0, 75, 0.30), ("LONG_CALL", None, 1.0, 9, None)]
    rows += [("BULL_CALL_SPREAD", 110.0, 4.0, 9, 1.04), ("BULL_CALL_SPREAD", 110.0, 4.0, 9, 1.06), ("BULL_CALL_SPREAD", None, 4.0, 9, 0.50), ("BULL_CALL_SPREAD", 110.0, 4.0, 9, -0.48), ("BULL_CALL_SPREAD", 110.0, 4.0, 9, -0.50)]
    df = spark.createDataFrame([(k, s, 100.0, short, debit, 92, age, o) for k, (s, short, debit, age, o) in enumerate(rows)], "k int, strategy string, strike double, short_strike double, entry_debit double, term_days int, age int, outcome double")
    got = [r["reason"] for r in add(df, *lifecycle.rules(90)).orderBy("k").collect()]
    assert got == ["take_profit", "stop_loss", "time_exit", None, None, None, None, "take_profit", "take_profit", None, "stop_loss"]
    assert add(df.where("k = 4").withColumn("age", F.lit(90)), *lifecycle.rules(90)).first()["reason"] == "max_holding_period"


def test_size_and_commission(spark):
    df = frame(spark, [dict(k=0, strategy="LONG_CALL", hit_rate=0.70, roi_net=0.80, ask=2.0), dict(k=1, strategy="LONG_CALL", hit_rate=0.45, roi_net=0.05, ask=2.0), dict(k=2, strategy="BULL_CALL_SPREAD", hit_rate=0.75, roi_net=0.9, ask=9.0, net_debit=1.5), dict(k=3, strategy="LONG_CALL", roi_net=2.0, ask=40.0)], k="int", strategy="string", hit_rate="double", roi_net="double", ask="double", net_debit="double")
    a, b, c, d = add(df, *proposals.SIZE).orderBy("k").collect()
    assert math.isclose(a["kelly"], 0.7 - 0.3 / (0.8 / 0.80)) and math.isclose(a["position_pct"], 0.1) and (a["position_usd"], a["contracts"]) == (500.0, 2)
    assert b["kelly"] < 0 and (b["contracts"], b["note"]) == (0, "no edge") and c["unit_cost"] == 150.0 and c["contracts"] == 3
    assert d["p_win"] == 0.5 and (d["contracts"], d["note"]) == (0, "too dear")
    base = dict(price=100.0, target=110.0, strike=100.0, bid=1.4, ask=1.5, iv=0.3, dte=150, iv_rank=50.0, hit_rate=0.65, catalyst_type="FDA", vix=20.0)
    df = frame(spark, [base | dict(k=0, strategy="LONG_CALL"), base | dict(k=1, strategy="BULL_CALL_SPREAD", net_debit=1.5), base | dict(k=2, strategy="LONG_CALL", ask=0.0), base | dict(k=3, strategy="LONG_CALL", delta=0.6, vix=30.0, vix_structure="backwardation")],
               k="int", strategy="string", price="double", target="double", strike="double", bid="double", ask="double", net_debit="double", delta="double", iv="double", dte="int", iv_rank="double", hit_rate="double", catalyst_type="string", vix="double", vix_structure="string", straddle_move="double")
    a, b, c, d = add(df, *proposals.ROI).orderBy("k").collect()
    assert math.isclose(a["commission_pct"], 0.65 * 2 / 150) and math.isclose(b["commission_pct"], 0.65 * 4 / 150)
    t = 150 / 365
    d1 = 0.5 * 0.09 * t / (0.3 * math.sqrt(t))
    delta, vega = 0.5 * (1 + math.erf(d1 / math.sqrt(2))), 100 * math.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) * math.sqrt(t)
    assert math.isclose(a["delta_used"], delta, abs_tol=1e-6) and math.isclose(b["delta_used"], 0.8 * delta, abs_tol=1e-6)
    gross, loss = 0.1 * delta * (100 / 1.5) * 0.65, min(vega * 0.3 * 0.08 * 0.75 / 1.5, 0.5)
    assert math.isclose(a["roi_net"], gross - 2 * (0.1 / 1.5) - loss - 0.65 * 2 / 150, abs_tol=1e-5) and a["min_roi"] == 0.085 and a["passes_roi"]
    assert c["roi_net"] == 0 and not c["passes_roi"] and d["delta_used"] == 0.6 and d["min_roi"] == 0.12 and math.isclose(d["iv_drop"], 0.08 * 0.75 * 1.2)
    assert math.isclose(a["break_even"], 0.015) and a["has_edge"] and c["break_even"] is None and c["has_edge"]


def test_score(spark):
    base = dict(impact_capped=8, surprise=8, roi_net=0.2, dte=150, spread_pct=0.04, open_interest=1200, edge=0.06, severity=5, iv_rank=30.0, move_48h=0.01, macro_regime="expansive", sector="Technology", sector_strength=0.05, conflict=False)
    cases = [base, base | dict(roi_net=1.35, dte=16), base | dict(severity=7, iv_rank=96.0, move_48h=0.12, conflict=True), base | dict(impact_capped=0, roi_net=-0.5, spread_pct=None, open_interest=None, edge=None, macro_regime="recessionary", sector="Other", sector_strength=None), base | dict(sector="Real Estate", macro_regime="unknown")]
    kinds = dict(k="int", impact_capped="int", surprise="int", roi_net="double", dte="int", spread_pct="double", open_interest="bigint", edge="double", severity="int", iv_rank="double", move_48h="double", macro_regime="string", sector="string", sector_strength="double", conflict="boolean")
    got = add(frame(spark, [c | dict(k=k) for k, c in enumerate(cases)], **kinds), *proposals.SCORE).orderBy("k").collect()
    assert [(r["signal_pts"], r["options_pts"], r["risk_pts"], r["context_pts"], r["total"], r["grade"]) for r in got] == [
        (32.0, 26.5, 0.0, 21.0, 80, "STRONG BUY"), (32.0, 20.5, 0.0, 21.0, 74, "BUY"), (32.0, 26.5, -20.0, 11.0, 50, "WATCH"), (0.0, 1.5, 0.0, 10.0, 12, "AVOID"), (32.0, 26.5, 0.0, 19.2, 78, "STRONG BUY"),
    ]


def test_judgement(spark):
    base = dict(fda=False, eps_drift=None, catalyst_text="nothing", insider_cluster=False, verdict="PASS", argument="", direction="BULLISH", reason_text="", category="catalyst", horizon=None, decision="[YES]", n_expiries=2, concern="low", impact=8)
    cases = [base | dict(fda=True, catalyst_text="Earnings"), base | dict(eps_drift=-0.06), base | dict(catalyst_text="A Takeover"), base | dict(catalyst_text="Insider"), base | dict(verdict=None, argument="Das TRIFFT NICHT ZU"), base | dict(direction="BEARISH", reason_text="Wachstum"), base | dict(reason_text="Warnung", impact=5), base | dict(category="bearish_reversal"), base | dict(concern="high", horizon="ca. 6 Monate"), base | dict(category="routine_news"), base | dict(n_expiries=1)]
    kinds = dict(k="int", fda="boolean", eps_drift="double", catalyst_text="string", insider_cluster="boolean", verdict="string", argument="string", direction="string", reason_text="string", category="string", horizon="string", decision="string", n_expiries="int", concern="string", impact="int")
    got = add(frame(spark, [c | dict(k=k) for k, c in enumerate(cases)], **kinds), *proposals.JUDGEMENT).orderBy("k").collect()
    assert [r["catalyst_type"] for r in got][:5] == ["FDA", "EARNINGS", "MA", "INSIDER", "OTHER"] and [r["veto"] for r in got] == [k == 4 for k in range(11)]
    assert [r["conflict"] for r in got] == [k in (5, 6, 7) for k in range(11)] and [r["impact_capped"] for r in got] == [8, 8, 8, 8, 8, 6, 5, 6, 6, 8, 8]
    assert [r["shortlisted"] for r in got][8:] == [True, False, False] and got[8]["dte_floor"] == 140 and got[0]["dte_floor"] == 120


def test_short_interest(spark):
    rows = [("0.15", None, None, None), ("15.0", None, None, None), (None, "2.28", None, None), (None, None, "110", "100"), (None, None, "110", "0"), ("n/a", "x", "", "-"), ("0.10", None, None, None), ("0.03", None, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ticker int, short_percent string, short_ratio string, shares_short string, shares_short_prior string")
    got = [tuple(r)[1:] for r in market.short_interest(df).orderBy("ticker").collect()]
    assert got == [(0.15, 0.15, None, None, "high"), (0.15, 0.15, None, None, "high"), (0.0, None, 2.28, None, "normal"), (0.0, None, None, 0.1, "normal"), (0.0, None, None, None, "normal"), (0.0, None, None, None, "normal"), (0.1, 0.1, None, None, "elevated"), (0.03, 0.03, None, None, "normal")]


def test_slots(spark):
    rows = [("XLK", 0.8, "closed", None)] * 15 + [("XLE", -0.3, "closed", None)] * 5 + [("XLV", -0.2, "shadow", "final_mc_survivor")] * 3 + [(None, 0.5, "closed", None)]
    rows += [("XLU", 0.9, "shadow", "score_44")] * 9 + [("XLU", 0.9, "open", None)] * 9  # neither closed nor a survivor
    t = spark.createDataFrame(rows, "sector string, outcome double, source string, reject_reason string")
    r = ledger.sector_verdict(t).first()
    assert (r["n"], r["ready"], r["best"], r["worst"], r["dominant"], r["recommended"]) == (23, True, "XLK", "XLE", "XLK", "XLK")
    assert not ledger.sector_verdict(t.limit(12)).first()["ready"]
    t = spark.createDataFrame([(0.5, 0.7, None)] * 3 + [(0.5, None, None)], "tp_outcome double, trailing_outcome double, x int")
    r = lifecycle.trailing_verdict(t).first()
    assert (r["open"], r["closed"], r["mean_delta"], r["ready"], r["recommended"]) == (1, 3, 0.2, False, False)
    r = lifecycle.trailing_verdict(t.union(t)).first()
    assert (r["ready"], r["recommended"], r["share_better"]) == (True, True, 1.0)
    for spread, n, want in ((-0.20, 10, "long"), (0.12, 10, "none"), (-0.20, 6, "none")):
        t = spark.createDataFrame([("BULL_CALL_SPREAD", spread, "closed")] * n + [("LONG_CALL", 0.20, "closed")] * n, "strategy string, outcome double, source string")
        assert ledger.spread_vs_long(t).first()["recommend"] == want


def test_reports(spark, tmp_path):
    day = lambda k: f"2026-07-{10 + k:02d}"
    for k in range(8):
        stats = {"universe": 23, "prescreened": 5, "analyzed": 0 if k == 3 else 3, "mismatch_ok": 0, "trades": 0 if k > 1 else 2, "vix": None, "stop_reason": "dry" if k > 4 else None}
        (tmp_path / f"{day(k)}.json").write_text(json.dumps({"date": day(k), "stats": stats, "rejects": {"roi_gate": {"count": k, "tickers": ["A"]}, f"r{k}": {"count": 1, "tickers": []}}}, indent=1))
    (tmp_path / "2026-07-30.json").write_text(json.dumps({"date": "2026-07-30", "stats": {"trades": 1}}))
    (tmp_path / "2026-07-09.json").write_text("{broken")
    (tmp_path / "notes.json").write_text(json.dumps({"date": "2026-07-15", "stats": {"trades": 7}}))
    (tmp_path / "2026-06-30.json").write_text(json.dumps({"date": "2026-06-30", "proposals": [{"ticker": "X"}]}))
    got = reports.read_reports(spark, str(tmp_path), today="2026-07-20")
    assert sorted(str(r["day"]) for r in got.collect()) == ["2026-06-30", *map(day, range(8))]
    assert tuple(reports.drought(got).first()) == (6, "mismatch_ok") and reports.newest_reports(got, 3).count() == 3
    june, july = reports.month_funnel(got).orderBy("month").collect()
    assert (june["days"], june["zero_days"]) == (1, 0) and (july["days"], july["zero_days"]) == (8, 6)
    assert july["top_rejects"] == ["roi_gate:28", "r0:1", "r1:1", "r2:1", "r3:1"] and july["top_stops"] == ["dry:3"]
    assert reports.read_reports(spark, str(tmp_path), month="2026-06").count() == 1
    empty = reports.read_reports(spark, str(tmp_path), today="2020-01-01")
    assert tuple(reports.drought(empty).first()) == (0, None)


def test_report_sink(spark, tmp_path):
    judged = proposals.judged(adapters.proposals(spark, DIR).where("run_date < date'1995-02-01'"))
    documents = reports.report_document(judged)
    reports.write_reports(documents, str(tmp_path / "out"))
    first = documents.agg(F.min("run_date")).first()[0]
    reports.write_reports(documents.where(F.col("run_date") == first).withColumn("date", F.lit("again")), str(tmp_path / "out"))
    got = spark.read.schema(reports.REPORT).json(str(tmp_path / "out"))
    assert got.count() == documents.count() and got.where("date = 'again'").count() == 1
    want = {(str(r[0]), r[1]): r[2] for r in judged.where("reject_reason is not null").groupBy("run_date", "reject_reason").count().collect()}
    counts = {(r["date"], k): v["count"] for r in got.where("date <> 'again'").collect() for k, v in (r["rejects"] or {}).items()}
    assert counts == {k: v for k, v in want.items() if k[0] != str(first)}


def test_ledger_document(spark, tmp_path):
    trade = {"ticker": "A", "entry_date": "2026-05-01T10:00", "strategy": "LONG_CALL", "outcome": 0.5, "features": {"mismatch": 3}, "option": {"dte": 120}}
    (tmp_path / "h.json").write_text(json.dumps({"closed_trades": [trade, None, trade | {"outcome": None}], "shadow_trades": [trade | {"ticker": "B", "reject_reason": "roi_gate"}], "model_weights": {"impact": 0.4, "mismatch": None}}))
    book = reports.read_ledger(spark, str(tmp_path / "h.json"))
    assert book.first()["model_weights"] == {"impact": 0.4, "mismatch": 0.45, "eps_drift": 0.2} and book.first()["active_trades"] == []
    rows = reports.ledger_rows(book).orderBy("ticker").collect()
    assert [(r["ticker"], r["source"], r["outcome"], r["mismatch"], r["dte"], str(r["entry_date"])) for r in rows] == [("A", "real", 0.5, 3.0, 120, "2026-05-01"), ("B", "shadow", 0.5, 3.0, 120, "2026-05-01")]
    (tmp_path / "bad.json").write_text("[1, 2]")
    assert reports.ledger_rows(reports.read_ledger(spark, str(tmp_path / "bad.json"))).count() == 0


def test_feeds(spark, tmp_path):
    (tmp_path / "news").mkdir()
    items = [{"ticker": "A", "headline": f"h{k}", "datetime": 1_700_000_000 + k, "source": "s", "url": "u", "summary": "x" * 300} for k in range(7)]
    (tmp_path / "news/a.json").write_text(json.dumps({"data": [*items, {"ticker": "A", "headline": ""}]}))
    (tmp_path / "news/b.json").write_text("{")
    got = reports.news_feed(spark, str(tmp_path / "news")).orderBy("k").collect()
    assert [r["headline"] for r in got] == ["h6", "h5", "h4", "h3", "h2"] and len(got[0]["summary"]) == 200
    one = {"symbol": "A1", "option_type": "call", "strike": 100, "expiration_date": "2026-01-16", "greeks": {"mid_iv": 0, "smv_vol": 0.4, "delta": "bad"}}
    (tmp_path / "c1.json").write_text(json.dumps({"options": {"option": one}}))
    (tmp_path / "c2.json").write_text(json.dumps({"options": {"option": [one | {"greeks": None}, one | {"greeks": {"mid_iv": 0.005, "delta": "0.6"}}]}}))
    got = [(r["iv"], r["delta"], r["bid"], r["oi"]) for f in ("c1", "c2") for r in reports.chain_feed(spark, str(tmp_path / f"{f}.json")).collect()]
    assert got == [(0.4, 0.0, 0.0, 0), (0.3, 0.0, 0.0, 0), (0.3, 0.6, 0.0, 0)]
    (tmp_path / "s.csv").write_text("date,value\n2026-01-01,1.5\n2026-01-02,.\n2026-01-03,\n")
    assert [tuple(r) for r in reports.series_feed(spark, str(tmp_path / "s.csv")).collect()] == [(datetime.date(2026, 1, 1), 1.5)]
    (tmp_path / "k.json").write_text(json.dumps({"0": {"cik_str": 320193, "ticker": "aapl", "title": "x"}, "1": {"cik_str": 7, "ticker": "B", "title": None}, "2": {"cik_str": 8, "ticker": "b", "title": "later"}, "3": {"ticker": "C"}, "4": {"cik_str": 9}}))
    assert sorted(map(tuple, reports.cik_feed(spark, str(tmp_path / "k.json")).collect())) == [("AAPL", "0000320193", "x"), ("B", "0000000007", None)]
    (tmp_path / "i.csv").write_text("symbol\n BRK.B \n")
    (tmp_path / "e.csv").write_text("symbol\n")
    spare = spark.createDataFrame([("Z",)], "symbol string")
    assert [[r[0] for r in reports.constituents(spark, str(tmp_path / f), spare).collect()] for f in ("i.csv", "e.csv")] == [["BRK-B"], ["Z"]]


def test_snapshot_sink(spark, tmp_path):
    write = lambda rows: reports.write_snapshot(spark.createDataFrame(rows, "run_date string, n int"), str(tmp_path / "s"))
    write([("2026-01-01", 1), ("2026-01-02", 2)])
    write([("2026-01-02", 3)])
    assert sorted((str(r["run_date"]), r["n"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("2026-01-01", 1), ("2026-01-02", 3)]


def test_correlated_proposals_are_pruned(spark):
    """Also where the first of a pair is the weaker: it goes, but ends its turn."""
    names = "ABCDEFGH"
    high = {("A", "C"), ("B", "D"), ("C", "D"), ("E", "F"), ("E", "G"), ("E", "H"), ("F", "H")}
    runs = {1: dict(zip(names, [80, 70, 75, 60, 50, 55, 40, 30], strict=True)), 2: dict(zip(names, [9, 8, 7, 6, 5, 4, 3, 2], strict=True)), 3: {"A": 1}, 4: dict(zip(names, [1, 2, 3, 4, 5, 6, 7, 8], strict=True))}
    pairs = [(r, i, j, a, b, 0.9 if (a, b) in high else 0.2) for r, own in runs.items() for (i, a), (j, b) in itertools.combinations(enumerate(own), 2)]
    corr = spark.createDataFrame(pairs, "run int, i int, j int, a string, b string, corr double")
    got = prices.prune_correlated(spark.createDataFrame([(r, t, k, s) for r, own in runs.items() for k, (t, s) in enumerate(own.items())], "run int, ticker string, rank int, score int"), corr)
    want = {}
    for run, own in runs.items():
        order, gone = list(own), set()
        for i, a in enumerate(order):
            if a in gone:
                continue
            for b in order[i + 1 :]:
                if b not in gone and (a, b) in high:
                    gone.add(b if own[a] >= own[b] else a)
        want |= {(run, t): t not in gone for t in order}
    assert {(r["run"], r["ticker"]): r["kept"] for r in got.collect()} == want and not want[1, "E"] and not want[1, "G"]
    assert {(r["entry_date"], r["ticker"], r["reason"]) for r in prices.correlation_losers(got).collect()} == {(*k, "correlation") for k, kept in want.items() if not kept}


def test_correlation_in_a_runs_frame(spark):
    """35 days, list-wise: a day counts if all tickers of the run have a return there."""
    rng, day = random.Random(3), lambda n: datetime.date(2026, 1, 1) + datetime.timedelta(n)
    bars = [(t, day(n), round(100 * rng.uniform(0.9, 1.1), 3)) for t in "ABC" for n in range(0, 120) if not (t == "C" and n % 7 == 0)] + [("D", day(n), 5.0) for n in range(120)]
    ranked = [(day(50), "B", 1, 9.0), (day(50), "A", 2, 8.0), (day(50), "D", 3, 7.0), (day(100), "A", 1, 9.0), (day(100), "C", 2, 8.0), (day(110), "A", 1, 1.0), (day(110), "Z", 2, 1.0)]
    got = prices.run_correlations(spark.createDataFrame(ranked, "run date, ticker string, rank int, score double"), spark.createDataFrame(bars, "ticker string, d date, close double")).collect()
    close = {(t, d): c for t, d, c in bars}
    want = {}
    for run, tickers in ((day(50), "BAD"), (day(100), "AC")):
        rets = {}
        for t in tickers:
            own = [d for d in sorted(d for u, d in close if u == t) if run - datetime.timedelta(35) < d <= run]
            rets[t] = {b: close[t, b] / close[t, a] - 1 for a, b in zip(own, own[1:], strict=False)}
        days = set.intersection(*(set(r) for r in rets.values()))
        for a, b in itertools.combinations(tickers, 2):
            x, y = ([rets[t][d] for d in sorted(days)] for t in (a, b))
            mx, my = sum(x) / len(x), sum(y) / len(y)
            top, low = sum((u - mx) * (v - my) for u, v in zip(x, y, strict=True)), math.sqrt(sum((u - mx) ** 2 for u in x) * sum((v - my) ** 2 for v in y))
            want[run, a, b] = (len(days), round(top / low if low else 0.0, 6))
    assert {(r["run"], r["a"], r["b"]): (r["n"], round(r["corr"], 6)) for r in got} == want and want[day(100), "A", "C"][0] < 34


def test_streamed_exits_equal_batch(spark):
    from tidemark.streaming.monitors import exit_monitor

    batch = lifecycle.first_exit(adapters.marks(spark, DIR), 14).drop("peak")
    assert sorted(exit_monitor(spark, DIR).collect()) == sorted(batch.collect())


def test_universe_and_news(spark):
    raw = [" aapl ", "BRK.B", "hes", "TOOLONGX", "A1", "", None, "AAPL", "Ä-B"]
    got = market.universe(spark.createDataFrame(list(zip(raw, range(len(raw)), strict=True)), "raw string, position int")).collect()
    assert {(r["symbol"], r["first"], r["listings"]) for r in got} == {("AAPL", 0, 2), ("BRK-B", 1, 1), ("Ä-B", 8, 1)}
    news = spark.createDataFrame([(1, "Why Aapl's up"), (2, "AAPLX falls"), (3, "go to it"), (4, None)], "id int, title string")
    assert [tuple(r) for r in market.headline_tickers(news, spark.createDataFrame([("AAPL",), ("IT",), ("aapl",)], "ticker string")).collect()] == [("AAPL", 1)]


@pytest.mark.parametrize("s, want", [(310.0, (0.9516, 1.0484)), (900.0, (0.97, 1.03)), (210.0, (0.9286, 1.0714))])
def test_strike_window(spark, s, want):
    assert tuple(spark.createDataFrame([(s,)], "s double").select(*options.strike_window(14, 60)).first()) == want


def test_missing_data_fails_the_gates_that_need_it(spark):
    good = dict(vix=20.0, symbol="A", days_to_earnings=30, shortlisted=True, roi_net=0.5, dte=150, hit_rate=0.6, veto=False, direction="BULLISH", impact_capped=8, surprise=8, mismatch=5.5, intraday_move=0.0, severity=4, sector_strength=0.0,
                dte_floor=120, skip_tier=False, passes_roi=True, has_edge=True, quick_days=30, final_hit_rate=0.6)
    kinds = dict(vix="double", symbol="string", days_to_earnings="int", shortlisted="boolean", roi_net="double", dte="int", hit_rate="double", veto="boolean", direction="string", impact_capped="int", surprise="int", mismatch="double", intraday_move="double",
                 severity="int", sector_strength="double", dte_floor="int", skip_tier="boolean", passes_roi="boolean", has_edge="boolean", quick_days="int", final_hit_rate="double")
    nan = float("nan")
    cases = [
        ({}, None), ({"symbol": None}, "invalid_ticker"), ({"shortlisted": False}, "not_shortlisted"), ({"surprise": None}, "impact_x_surprise_below_floor"), ({"impact_capped": None}, "impact_x_surprise_below_floor"), ({"dte": None}, "dte_floor"),
        ({"mismatch": None}, "no_mismatch"), ({"mismatch": nan}, "invalid_mismatch"), ({"hit_rate": None}, "mc_invalid_hit_rate"), ({"hit_rate": 1.2}, "mc_invalid_hit_rate"), ({"hit_rate": 0.47, "vix": 15.0}, "mc_below_threshold"), ({"hit_rate": 0.47}, None),
        ({"hit_rate": 0.44, "vix": 31.0}, None), ({"hit_rate": 0.44, "vix": -1.0}, "mc_below_threshold"), ({"hit_rate": 0.46, "vix": nan}, None), ({"vix": 35.0}, "vix_gate"), ({"vix": None}, None), ({"severity": None}, None), ({"passes_roi": None}, "roi_gate"),
        ({"final_hit_rate": None}, "final_mc_invalid"), ({"final_hit_rate": 0.005}, "final_mc_zero_prob"), ({"final_hit_rate": 0.47}, None), ({"final_hit_rate": 0.47, "quick_days": 60}, "final_mc_below_threshold"), ({"final_hit_rate": 0.44}, "final_mc_below_threshold"),
    ]
    df = frame(spark, [dict(k=k) | good | c for k, (c, _) in enumerate(cases)], k="int", **kinds)
    assert [r["reject_reason"] for r in add(df, *proposals.GATES).orderBy("k").collect()] == [want for _, want in cases]
    raw = frame(spark, [dict(k=0, decision=None), dict(k=1, category=None), dict(k=2, category="routine_news"), dict(k=3, n_expiries=None), dict(k=4)], k="int", decision="string", category="string", n_expiries="int")
    raw = raw.selectExpr("k", "if(k = 0, null, '[YES]') as decision", "if(k = 1, null, coalesce(category, 'catalyst')) as category", "if(k = 3, null, 4) as n_expiries")
    assert [r[0] for r in add(raw, {"shortlisted": proposals.JUDGEMENT[0]["shortlisted"]}).orderBy("k").select("shortlisted").collect()] == [False, True, False, False, True]


def test_size_takes_the_assumed_loss(spark):
    row = [dict(k=0, strategy="LONG_CALL", hit_rate=0.60, roi_net=0.50, ask=1.0)]
    df = frame(spark, row, k="int", strategy="string", hit_rate="double", roi_net="double", ask="double", net_debit="double")
    r = add(df, *proposals.SIZE).first()  # 0.6 - 0.4 * 0.8 / 0.5 < 0: no position; at a loss of .45 there was one
    assert math.isclose(r["kelly"], -0.04) and (r["contracts"], r["max_risk"], r["note"]) == (0, 0.0, "no edge")
    r = add(df, *proposals.size(loss=0.45)).first()
    assert math.isclose(r["kelly"], 0.24) and (r["position_usd"], r["contracts"]) == (300.0, 3) and math.isclose(r["max_risk"], 135.0)


def test_bins_of_missing_features(spark):
    t = frame(spark, [dict(outcome=0.1), dict(outcome=0.2, impact=9, mismatch=7.0, eps_drift=-0.2), dict(outcome=0.3, impact=4, mismatch=2.9, eps_drift=0.06), dict(outcome=0.5, impact=7, mismatch=6.0, eps_drift=0.05)], outcome="double", impact="int", mismatch="double", eps_drift="double").withColumn("source", F.lit("closed"))
    got = {(r["feature"], r["bin"]): (r["count"], r["avg_return"]) for r in ledger.bin_stats(t).collect()}
    assert got == {("impact", "mid"): (2, 0.3), ("impact", "high"): (1, 0.2), ("impact", "low"): (1, 0.3), ("mismatch", "good"): (2, 0.3), ("mismatch", "strong"): (1, 0.2), ("mismatch", "weak"): (1, 0.3), ("eps", "noise"): (2, 0.3), ("eps", "massive"): (1, 0.2), ("eps", "relevant"): (1, 0.3)}
    few = ledger.pearson_weights(t).first()
    assert (few["n"], few["impact"], few["mismatch"], few["eps"]) == (4, 0.35, 0.45, 0.2)
    rising = frame(spark, [dict(outcome=o, impact=i, mismatch=1.0) for o, i in ((-0.5, 1), (-0.4, 2), (0.0, None), (0.1, 6), (0.5, 9), (0.6, 10))], outcome="double", impact="int", mismatch="double", eps_drift="double").withColumn("source", F.lit("closed"))
    assert tuple(ledger.pearson_weights(rising).first()) == (6, round(0.35 + 0.05 * 0.65, 4), round(0.45 - 0.05 * 0.45, 4), 0.19)


def test_posts_below_zero(spark):
    from tidemark.operators import text

    df = spark.createDataFrame([(1, "s", "buy calls", -1, 5), (2, "s", "sell", -7, -3), (3, "s", "x", None, None), (4, "s", "buy", 99, 300), (5, "s", None, 1, 1)], "id long, source string, text string, score long, comments long")
    got = {r["id"]: r["credibility"] for r in text.credibility(df).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: round(math.log(100) * 3, 3), 5: round(math.log(2) * 1.5, 3)}
    r = text.weighted_sentiment(df).first()
    assert r["mentions"] == 5 and -1 <= r["sentiment"] <= 1


def test_stored_answers(spark):
    long = "x" * 120
    rows = [
        '{"k": 7, "catalyst_confidence": 9}', 'Sure: {"k": 2}', '```json\n{"k": 4, "a": "b, c"}\n```\nmore', f'{{"k": 6, "reason": "{long}, and", "tail": "cut off, in pro', f'{{"k": 6, "reason": "{long}, and then it en', '{"k": 6, "note": "short", "tail',
        f'{{"k": 6, broken "reason": "{long}", "tail": "x', "no answer", None, "{\"k\": \"many\"}",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, raw string")
    got = [tuple(r)[1:] for r in market.parsed_answers(df).orderBy("id").collect()]
    assert got == [("direct", 7, 9), ("direct", 2, 5), ("direct", 4, 5), ("repaired", 6, 5), ("lost", None, None), ("lost", None, None), ("neutral", 3, 5), ("lost", None, None), ("lost", None, None), ("direct", None, 5)]


def test_macro_without_a_curve(spark):
    df = spark.createDataFrame([("v9", datetime.date(2026, 1, 2), "20"), ("v90", datetime.date(2026, 1, 2), "22"), ("y10", datetime.date(2026, 2, 2), "4.1"), ("y2", datetime.date(2026, 2, 2), "4.2"), ("y10", datetime.date(2026, 2, 3), ".")], "name string, d date, value string")
    got = [(r["curve"], r["regime"], r["structure"]) for r in market.macro_regime(df).orderBy("month").collect()]
    assert got == [(None, "recessionary", "contango"), (-0.1, "neutral", "unknown")]


def test_exit_table_and_its_sink(spark, tmp_path):
    at = lambda d, h=0: datetime.datetime(2026, 1, 1 + d, 9 + h)
    marks = spark.createDataFrame([(1, at(0), 1, 10.0), (1, at(2), 2, 16.0), (1, at(3), 3, 1.0), (3, at(0), 4, 10.0), (3, at(2, 1), 5, 5.0), (5, at(1), 6, 10.0)], "trade_id long, ts timestamp, event_id long, value double")
    rows = lifecycle.exit_table(marks, 14)
    got = {r["trade_id"]: (str(r["day"]), r["strategy"], r["reason"], r["outcome"], r["age"], r["pnl_per_contract"]) for r in rows.collect()}
    assert got == {1: ("2026-01-03", "LONG_CALL", "take_profit", 0.6, 2, 120.0), 3: ("2026-01-03", "LONG_CALL", "stop_loss", -0.5, 2, -50.0)}
    for _ in range(2):  # a day that is written again is replaced
        reports.write_snapshot(rows, str(tmp_path / "alerts"), "day")
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 2
