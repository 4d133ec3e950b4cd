"""Company facts read by path, and substring joins against brute force."""

import json
import random

from tidemark.operators import market, mentions
from tidemark.sources import facts


def doc(cik, tags, taxonomy="us-gaap"):
    return json.dumps({"cik": cik, "entityName": "x", "facts": {taxonomy: tags, "dei": {"Shares": {"units": {"shares": [{"end": "2025-01-01", "val": 1, "form": "10-K"}]}}}}})


def figure(end, val, form="10-Q", **more):
    return {"end": end, "val": val, "form": form} | more


DOCS = {
    "a.json": doc(7, {"EarningsPerShareBasic": {"units": {"USD/shares": [figure(f"2025-0{m}-01", m / 10) for m in (3, 1, 5, 2, 4)] + [figure("2025-09-01", 9.0, "8-K"), figure("2025-08-01", None), figure("2025-07-01", "n/a")], "EUR/shares": [figure("2026-01-01", 99.0)]}}, "Other": {"units": {}}}),
    "b.json": doc(8, {"EarningsPerShareDiluted": {"units": {"USD/shares": [figure("2025-01-01", 2.5, "10-K", fp="FY")]}}, "EarningsPerShareBasic": {"units": {"EUR/shares": [figure("2025-01-01", 1.0)]}}}),
    "c.json": doc(9, {"EarningsPerShareBasic": {"units": {"USD/shares": [figure("2025-01-01", 1.0)]}}}, "ifrs-full"),
    "d.json": doc(10, {"EarningsPerShareBasic": "not an object", "EarningsPerShareDiluted": {"units": ["not", "an", "object"]}}),
    "e.json": doc(7, {})[:-9], "f.json": "[]", "g.json": "", "h.json": json.dumps({"cik": 11}), "i.json": json.dumps({"cik": 12, "facts": None}),
}


def test_company_facts(spark, tmp_path):
    for name, body in DOCS.items():
        (tmp_path / name).write_text(body)
    documents = facts.fact_documents(spark, str(tmp_path))
    rows = facts.facts(documents).collect()
    assert {(r["cik"], r["tag"], r["unit"]) for r in rows} == {(7, "EarningsPerShareBasic", "USD/shares"), (7, "EarningsPerShareBasic", "EUR/shares"), (8, "EarningsPerShareDiluted", "USD/shares"), (8, "EarningsPerShareBasic", "EUR/shares")}
    assert len([r for r in rows if r["cik"] == 7]) == 9 and [r["value"] for r in rows if str(r["end_date"]) == "2025-07-01"] == [None]
    assert {r["tag"] for r in facts.facts(documents, "dei").collect()} == {"Shares"} and facts.facts(documents, tags=("Other",)).count() == 0
    registered = spark.createDataFrame([("A", "0000000007"), ("B", "0000000008"), ("C", "0000000009"), ("D", "0000000010")], "ticker string, cik string")
    got = {r["ticker"]: (r["tag"], r["eps"], r["filings"]) for r in market.trailing_eps(facts.eps_filings(documents, registered)).collect()}
    assert got == {"A": ("basic", 1.4, 4), "B": ("diluted", 2.5, 1)}
    assert tuple(facts.unsound(documents).first()) == (8, 1, 3)  # an empty file holds no document
    none = documents.where("false")
    assert facts.facts(none).count() == 0 and tuple(facts.unsound(none).first()) == (0, 0, 0)


def test_substrings_equal_brute_force(spark):
    rng = random.Random(2)
    letters = "abAB é1"
    texts = [(i % 190, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 25)))) for i in range(200)] + [(900, None), (901, "")]
    needles = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 6))) for _ in range(60)] + [None, "zzz", "a", "B", "ab"]
    t = spark.createDataFrame(texts, "id long, text string").repartition(3)
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = {(r["id"], r["needle"]) for r in mentions.containing(t, n).collect()}
    assert got == {(i, x.lower()) for i, s in texts if s for x in needles if x and x.lower() in s.lower()} and len(got) > 500
    assert mentions.containing(t.limit(0), n).count() == mentions.containing(t, n.limit(0)).count() == 0


def test_only_texts_with_the_rarest_gram_are_searched(spark):
    """All texts share grams with each needle; few have the rare one."""
    texts = spark.range(2000).selectExpr("id", "concat('common words in every text ', if(id % 100 = 7, 'xylo', 'wood'), ' phone') as text")
    needles = spark.createDataFrame([("xylo phone",), ("text wood",), ("common xyz",)], "needle string")
    between = mentions.candidates(texts, needles)
    counts = {r["needle"]: r["count"] for r in between.groupBy("needle").count().collect()}
    assert counts == {"xylo phone": 20, "text wood": 1980}
    assert {r["needle"]: r["count"] for r in mentions.containing(texts, needles).groupBy("needle").count().collect()} == counts
    plan = mentions.containing(texts, needles)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sponsors_and_mentions(spark):
    approvals = spark.createDataFrame([(1, "PFIZER INC"), (2, "Merck Sharp"), (3, "ab labs"), (4, None)], "id long, sponsor string")
    companies = spark.createDataFrame([(10, "Pfizer Incorporated"), (11, " pfizer"), (12, "AB Science"), (13, None), (14, ""), (15, "sharp corp")], "company long, name string")
    assert sorted(map(tuple, mentions.sponsor_matches(approvals, companies).collect())) == [(1, 10, "PFIZER"), (1, 11, "PFIZER"), (2, 15, "SHARP")]
    posts = spark.createDataFrame([(1, "Gme to the moon", ""), (2, "nothing", "x" * 199 + "GME"), (3, "nothing", "a game: GM"), (4, None, "gme"), (5, "gme", None)], "id long, title string, body string")
    tickers = spark.createDataFrame([("GME",), ("GM",), ("",), (None,)], "ticker string")
    got = sorted(map(tuple, mentions.ticker_mentions(posts, tickers).collect()))
    assert got == [(1, "GM", True), (1, "GME", True), (3, "GM", False), (4, "GM", False), (4, "GME", False), (5, "GM", True), (5, "GME", True)]
