"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import datetime

import duckdb
import pytest

from tidemark.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.date | datetime.datetime):
        return str(v)[:10]
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, duck, name):
    df, rel = Q[name](spark, DIR), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_stream(spark):
    assert registry.queries()["stream_news_window"](spark, DIR).count() > 0


@pytest.mark.parametrize("form", ["file", "folder", "partitions"])
def test_stream_counts_every_window(spark, tmp_path, form):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    where = DIR if form == "file" else str(tmp_path)
    if form != "file":
        writer = events.repartition(3).write
        (writer.partitionBy("event_type") if form == "partitions" else writer).parquet(f"{where}/events.parquet")
    got = registry.queries()["stream_news_window"](spark, where).collect()
    want = events.selectExpr("event_type", "explode(array(0, 1)) as back", "cast(ts as timestamp) as ts")
    want = want.selectExpr("event_type", "cast(date_sub(to_date(ts), back) as timestamp) as start").groupBy("event_type", "start").count()
    assert sorted((r["event_type"], r["start"], r["end"] - r["start"], r["n"]) for r in got) == sorted((r[0], r[1], datetime.timedelta(days=2), r[2]) for r in want.collect())


def test_cooldown_holds_only_entered_trades_against_a_ticker(spark):
    from tidemark.operators.ledger import cooldown_entered
    from tidemark.sources import adapters

    day = lambda n: datetime.date(2026, 1, 1) + datetime.timedelta(n)
    rows = [(i, 1, day(20 * i)) for i in range(4)] + [(10 + i, 2, day(30 * i)) for i in range(5)] + [(20, 3, day(0)), (21, 3, day(0)), (22, 3, day(31)), (30, 4, None), (31, 4, day(5)), (32, 4, None)]
    small = spark.createDataFrame(rows, "trade_id long, ticker long, entry_date date")
    assert {r["trade_id"] for r in cooldown_entered(small).collect()} == {0, 2, 10, 12, 14, 20, 22, 30, 31, 32}
    want, last = set(), {}
    for r in sorted(adapters.trades(spark, DIR).collect(), key=lambda r: (r["entry_date"], r["trade_id"])):
        if r["ticker"] not in last or (r["entry_date"] - last[r["ticker"]]).days > 30:
            last[r["ticker"]] = r["entry_date"]
            want.add((r["trade_id"], r["ticker"], r["entry_date"]))
    got = registry.queries()["cooldown_antijoin"](spark, DIR).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_suggestion_of_a_better_threshold(spark):
    from tidemark.operators.ledger import threshold_suggest

    rows = [(3.0, 0.5)] * 25 + [(8.0, -0.8)] * 10  # all losers at the current limit
    t = spark.createDataFrame(rows, "mismatch double, outcome double").selectExpr("*", "200L as dte", "5L as impact", "5L as surprise", "60L as score")
    got = threshold_suggest(t, {"mismatch": 8}).collect()
    assert [(r["field"], r["current"], r["suggested"], r["n"]) for r in got] == [("mismatch", 8.0, 4.0, 25)]
    assert threshold_suggest(t.limit(10), {"mismatch": 8}).count() == 0  # too few
    assert threshold_suggest(t, {"mismatch": 7.5}).count() == 0  # no gain over a limit that isn't offered
