"""Sessions, late signals and a user's classifier by hand."""

import datetime

import pandas as pd

from tidemark.operators import intraday, market

DAY = datetime.datetime(2026, 1, 5)


def at(hour, minute=0, second=0, day=0):
    return DAY + datetime.timedelta(days=day, hours=hour, minutes=minute, seconds=second)


def test_sessions_and_late_signals(spark):
    ticks = [
        ("A", at(9, 30, 1), 2, 100.0), ("A", at(9, 30, 1), 1, 99.0), ("A", at(9, 34, 59), 3, 101.0), ("A", at(9, 35), 4, 102.0), ("A", at(11, 30), 5, None), ("A", at(11, 20), 6, 107.91), ("A", at(13, 25), 7, 50.0),
        ("B", at(9), 8, 10.0), ("B", at(9, 4), 9, 20.0), ("C", at(9), 10, 0.0), ("C", at(9, 10), 11, 5.0), ("D", at(9), 12, 100.0), ("D", at(10), 13, 92.0), ("A", at(9, 0, 0, 1), 14, 100.0), ("A", at(9, 10, 0, 1), 15, 110.0),
    ]
    bars = intraday.minute_bars(spark.createDataFrame(ticks, "ticker string, ts timestamp, seq long, price double"))
    first = bars.where("ticker = 'A'").orderBy("bar").first()
    assert (first["bar"], first["open"], first["close"]) == (at(9, 30), 99.0, 101.0)
    moves = intraday.session_moves(bars)
    got = {(r["ticker"], r["start"]): (r["bars"], r["move"], r["available"]) for r in moves.collect()}
    assert got == {("A", at(9, 30)): (3, 0.09, True), ("A", at(13, 25)): (1, 0.0, False), ("B", at(9)): (1, 0.0, False), ("C", at(9)): (2, 0.0, False), ("D", at(9)): (2, -0.08, True), ("A", at(9, 0, 0, 1)): (2, 0.1, True)}
    rows = [(1, "A", 0, "BULLISH", 6.0), (2, "A", 1, "BULLISH", 7.0), (3, "A", 1, "BULLISH", 5.0), (4, "A", 1, "BEARISH", None), (5, "D", 0, "BEARISH", 9.0), (6, "D", 0, "BULLISH", 1.0), (7, "B", 0, "BULLISH", 1.0), (8, "Z", 0, "BEARISH", 1.0)]
    signals = spark.createDataFrame([(i, t, (DAY + datetime.timedelta(d)).date(), s, m) for i, t, d, s, m in rows], "id long, ticker string, day date, direction string, mismatch double")
    late = {r["id"]: (r["move"], r["limit"], r["too_late"], r["moved_already"]) for r in intraday.late_signals(signals, moves).collect()}
    assert late == {1: (0.0, 0.09, False, False), 2: (0.1, 0.12, False, True), 3: (0.1, 0.09, True, True), 4: (0.1, 0.07, True, False), 5: (-0.08, 0.12, False, True), 6: (-0.08, 0.07, True, False), 7: (0.0, 0.07, False, False), 8: (0.0, 0.07, False, False)}


def test_a_users_classifier_is_loaded_once_a_task(spark, tmp_path):
    loads = tmp_path / "loads"
    loads.mkdir()

    def make():
        import uuid

        (loads / uuid.uuid4().hex).touch()
        return lambda s: pd.DataFrame({"neu": 0.1, "pos": [0.9 if "up" in t else 0.0 for t in s], "neg": [0.0 if "up" in t else 0.9 for t in s], "more": 1})

    posts = spark.createDataFrame([(i, f"goes up {i}\n\nother\nup" if i % 2 else "falls") for i in range(500)] + [(900, ""), (901, None)], "id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    got = {r["id"]: (r["n"], r["sentiment"], r["label"], r["confidence"]) for r in market.headline_sentiment(posts, probs=market.headline_probs(make)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[1] == (3, 0.3, "positive", 0.6) and got[2] == (1, -0.9, "negative", 0.9) and got[900] == got[901] == (0, 0.0, "neutral", 0.0)
    assert len(list(loads.iterdir())) == 1
