"""Findings of round 3: rows that tell the engines apart, against each query's SQL."""

import datetime
import math

import duckdb
import pytest

from tidemark.plans import registry

AT = datetime.datetime(2024, 1, 1, 9)


def plain(v):
    return str(v)[:10] if isinstance(v, datetime.date | datetime.datetime) else "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def assert_as_sql(spark, path, name):
    """The query's rows over the tables in path are those of its SQL there."""
    con = duckdb.connect()
    for table in path.glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from '{table}/*.parquet'")
    df, cursor = registry.queries()[name](spark, str(path)), con.execute(registry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(df.columns) == sorted(at)
    got = sorted((tuple(plain(r[c]) for c in df.columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[at[c]]) for c in df.columns) for r in cursor.fetchall()), key=repr) and got


@pytest.mark.parametrize("name", ["running_peak", "exit_first_fire", "exit_alerts", "trailing_stop", "trailing_vs_tp", "shadow_outcome", "stream_exits", "exit_table"])
def test_a_first_value_of_zero(spark, tmp_path, name):
    values = {1: [0.0, 0.0, 5.0, 3.0, -2.0], 2: [0.0, 7.0, 8.0, 1.0, 0.0], 3: [10.0, 12.0, 16.0, 9.0, 0.0], 4: [0.0, -1.0, 4.0, None, 2.0], 5: [None, 3.0, 4.0, 5.0, 6.0]}
    rows = [(10 * u + k, AT + datetime.timedelta(days=5 * k), u, "view", v, "{}") for u, vs in values.items() for k, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert_as_sql(spark, tmp_path, name)


#: Letters beside words, capitals that are several letters, spaces of other kinds.
TEXTS = ["übull bull\néput and put", "BULLİ İput bull_ish naïvecall", " \n buy sell\ncafé$5c x$5c 3p\x0b5 3c 7", "STRASSE Straße GROẞ ΟΔΟΣ ΟΔΟΣ.", "", None, "　\nlong…short", "ﬁne ǆ İstanbul"]
NAMES = ["straße 7", " große Werke", "ΟΔΟΣ holding", "ﬁne arts", "naïve\x0bx y", "İst x", None, "", "ǆx", "\tput z"]


@pytest.mark.parametrize("name", ["headline_sentiment", "headline_model", "post_credibility", "weighted_sentiment", "sponsor_match", "ticker_mentions"])
def test_letters_beyond_ascii(spark, tmp_path, name):
    docs = [(i, t, "en", f"src{i % 2}", 10 * i) for i, t in enumerate(TEXTS)] + [(20 + i, f"the {n} of {n}", "de", "src3", i) for i, n in enumerate(NAMES) if n]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(NAMES)), "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert_as_sql(spark, tmp_path, name)


def test_joins_of_equal_sides_copy_neither(spark):
    from tidemark.operators import tiers, valuation
    from tidemark.sources import adapters

    sf = "/root/testdata/sf0.001"
    chain, bars, needs = adapters.chain(spark, sf), adapters.supplier_bars(spark, sf), adapters.candidates(spark, sf)
    found = tiers.contracts(tiers.last_close(needs, bars), chain)
    values = valuation.position_value(adapters.book(spark, sf), chain, adapters.stock_quotes(spark, sf), bars)
    for df in (found, values):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if "Generate" in line and "_salt" in line]
