"""Substring joins over long texts, and needles at the edges of pieces."""

from tidemark.operators import mentions


def test_needles_lie_whole_in_a_piece_and_no_text_is_shuffled(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(40_000))
    at = [0, 60, 62, 63, 64, 65, 127, 16_380, 16_383, 16_384, 32_767, 39_990]
    needles = sorted({long[a : a + n] for a in at for n in (1, 2, 3, 4, 9)} | {"zzzzqq", "q z", "é😀", "no such thing", long[100:180]})
    texts = [(1, long), (2, "x" + long[:63] + "é😀"), (3, ""), (4, None), (5, "ab"), (5, long[60:72])]
    found = mentions.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    want = {(i, n) for i, t in texts for n in needles if t and n in t}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_start_that_the_title_covers_is_found_in_the_title(spark):
    posts = spark.createDataFrame([(1, "gme up", "gme up\ngm xyz"), (2, "gme " * 80, "gme " * 80), (3, None, "xyz"), (4, "xyz", None)], "id long, title string, body string")
    got = sorted(map(tuple, mentions.ticker_mentions(posts, spark.createDataFrame([("GME",), ("XYZ",)], "ticker string")).collect()))
    assert got == [(1, "GME", True), (1, "XYZ", False), (2, "GME", True), (3, "XYZ", False), (4, "XYZ", True)]
