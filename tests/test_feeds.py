"""Each feed with sound, partial, broken and empty files."""

import datetime
import json

from pyspark.sql import functions as F

from tidemark.operators import market
from tidemark.sources import feeds

NOW = datetime.datetime(2026, 5, 4, 12)


def landed(spark, tmp_path, bodies):
    for key, body in bodies.items():
        (tmp_path / f"{key}.json").write_text(body if isinstance(body, str) else json.dumps(body))
    return feeds.documents(spark, str(tmp_path))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


BAD = {"BROKEN": '{"articles": [', "EMPTY": "", "OTHER": {"articles": {"title": "no list"}}, "NULL": "null"}


def test_articles_and_quarantine(spark, tmp_path):
    docs = landed(spark, tmp_path, BAD | {"A": {"articles": [{"title": "one"}, {"title": None}, {}, "text", {"title": 5}, {"title": "sixth"}]}, "B": {"articles": []}})
    feed = feeds.FEEDS["article_search"]
    assert rows(feeds.items(docs, feed)) == [("A", 0, "one"), ("A", 4, "5")]
    assert {(r["key"], r["reason"]) for r in feeds.quarantine(docs, feed).collect()} == {("BROKEN", "broken"), ("OTHER", "no items"), ("NULL", "no items")}
    assert tuple(feeds.feed_counts(docs, feed).first()) == (5, 2, 1, 2)
    assert tuple(feeds.feed_counts(docs.limit(0), feed).first()) == (0, 0, 0, 0) and feeds.items(docs.limit(0), feed).count() == 0


def test_provider_news(spark, tmp_path):
    ago = lambda h: int((NOW - datetime.timedelta(hours=h)).replace(tzinfo=datetime.UTC).timestamp())
    items = [{"title": "new", "providerPublishTime": ago(3)}, {"title": "old", "providerPublishTime": ago(49)}, {"title": "", "providerPublishTime": ago(1)}, {"title": "no time"}, {"title": "edge", "providerPublishTime": ago(48)}, {"title": "sixth", "providerPublishTime": ago(1)}]
    docs = landed(spark, tmp_path, BAD | {"A": items})
    assert rows(feeds.provider_news(docs, str(NOW))) == [("A", 0, "new"), ("A", 4, "edge")]


def test_filings_events_and_approvals(spark, tmp_path):
    hits = [{"_source": {"period_of_report": "2026-01-02", "display_names": ["Doe J", "X"], "file_date": "2026-01-03"}}, {"_source": {"display_names": []}}, {}]
    docs = landed(spark, tmp_path, BAD | {"A": {"hits": {"hits": hits * 4}}})
    got = rows(feeds.items(docs, feeds.FEEDS["insider_filings"]))
    assert len(got) == 10 and got[:3] == [("A", 0, "2026-01-02", "Doe J", "2026-01-03"), ("A", 1, "", "Unknown", ""), ("A", 2, "", "Unknown", "")]
    clusters = market.insider_clusters(feeds.items(docs, feeds.FEEDS["insider_filings"]).select(F.col("key").alias("ticker"), "insider", F.lit("m").alias("month"))).first()
    assert (clusters["insiders"], clusters["cluster"]) == (2, True)
    more = tmp_path / "more"
    more.mkdir()
    docs = landed(spark, more, {"x": {"results": [{"receivedate": "20260101", "primarysource": {"reportercountry": "US"}}, {"primarysource": None}]}})
    assert rows(feeds.items(docs, feeds.FEEDS["adverse_events"])) == [("x", 0, "20260101", "US"), ("x", 1, "", "")]
    docs = landed(spark, more, {"x": {"results": [{"sponsor_name": "Pfizer", "products": [{"brand_name": "A"}, {"brand_name": "B"}, {"brand_name": "C"}]}, {"products": [{}]}]}})
    assert rows(feeds.approvals(docs)) == [("x", 0, "PFIZER", ["A", "B"], "FDA Approval: A, B"), ("x", 1, "", [], "FDA Approval: ")]


def test_earnings(spark, tmp_path):
    docs = landed(spark, tmp_path, BAD | {"A": {"earningsCalendar": [{"date": "2026-05-20"}, {"date": "2026-05-10"}, {"date": None}, {"date": "soon"}]}, "B": {"earningsCalendar": []}, "C": {"earningsCalendar": [{"date": "2026-09-01"}]}})
    seconds = int(datetime.datetime(2026, 5, 6, tzinfo=datetime.UTC).timestamp())
    told = spark.createDataFrame([("A", seconds), ("B", seconds), ("D", 0), ("D", None)], "ticker string, earnings_timestamp long")
    got = {r["ticker"]: (str(r["earnings"]), r["days_until"]) for r in feeds.next_earnings(docs, told, "2026-05-04").collect()}
    assert got == {"A": ("2026-05-10", 6), "B": ("2026-05-06", 2), "D": ("None", None)}
    df = spark.createDataFrame([(1, [datetime.date(2026, 5, 30), datetime.date(2026, 5, 18)]), (2, [datetime.date(2026, 5, 3), None]), (3, None), (4, [])], "id int, dates array<date>")
    assert [r[0] for r in df.orderBy("id").select(feeds.earnings_soon(F.col("dates"), F.lit(datetime.date(2026, 5, 4)))).collect()] == [True, False, False, False]


def test_posts_positions_and_ages(spark, tmp_path):
    docs = landed(spark, tmp_path, BAD | {"A": {"data": {"children": [{"data": {"title": "t", "score": -4, "num_comments": 2, "selftext": "s", "subreddit": "f"}}, {"data": {}}, {}]}}})
    assert rows(feeds.items(docs, feeds.FEEDS["forum_posts"])) == [("A", 0, "t", -4, 2, "s", "f"), ("A", 1, "", 0, 0, "", ""), ("A", 2, "", 0, 0, "", "")]
    more = tmp_path / "more"
    more.mkdir()
    docs = landed(spark, more, {"A": {"gex": 1e9, "put_wall": 90, "net_positioning": "bullish"}, "B": {"gex": "much"}, "C": [], "D": "{"})
    assert rows(feeds.items(docs, feeds.FEEDS["dealer_positioning"])) == [("A", 0, 1e9, None, 90.0, None, "bullish"), ("B", 0, 0.0, None, None, None, "neutral")]
    assert rows(feeds.items(docs, feeds.FEEDS["vol_surface"]))[1] == ("B", 0, 0.0, 50.0, "flat", 0.0, 0.0, 0.0)
    assert {(r["key"], r["reason"]) for r in feeds.quarantine(docs, feeds.FEEDS["vol_surface"]).collect()} == {("C", "no items"), ("D", "broken")}
    at = int(NOW.replace(tzinfo=datetime.UTC).timestamp())
    df = spark.createDataFrame([(1, [at - 5400, 0, at - 90000]), (2, [0]), (3, None)], "id int, times array<long>")
    assert [r[0] for r in df.orderBy("id").select(feeds.news_age_hours(F.col("times"), F.lit(NOW))).collect()] == [1.5, None, None]


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><title>feed</title><item><title> GME soars </title><link>u</link></item><item><link>no title</link></item><item><title>ON the way &amp; back</title></item><item><title>they are here</title></item></channel></rss>")
    (tmp_path / "b.xml").write_text("<rss><channel><item><title>Cut off")
    (tmp_path / "c.xml").write_text("")
    got = feeds.rss(spark, str(tmp_path))
    assert rows(got) == [("GME soars", "u"), ("ON the way & back", ""), ("they are here", "")]
    found = market.headline_tickers(got.select(F.col("link").alias("id"), "title"), spark.createDataFrame([("GME",), ("ON",), ("WAY",), ("THE",), ("ARE",)], "ticker string"))
    assert rows(found) == [("GME", "u"), ("THE", ""), ("WAY", "")]
