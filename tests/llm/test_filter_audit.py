"""The audit of filters against counting every document in every order."""

import itertools
import re

import duckdb
import numpy as np
import pytest

from tidemark.llm import filter_audit as fa

DIR = "/root/testdata/sf0.001"


def brute(masks, n):
    """order -> steps of (filter, kept, removed), mask by mask."""
    out = {}
    for order in itertools.permutations(range(n)):
        left, steps = dict(masks), []
        for f in order:
            gone = {m: c for m, c in left.items() if m >> f & 1}
            left = {m: c for m, c in left.items() if m not in gone}
            total = lambda d: tuple(sum(c[k] for c in d.values()) for k in range(3))
            steps.append((f, total(left), total(gone)))
        out[order] = steps
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_swaps_visit_every_order_once_and_keep_the_counts(n):
    rng = np.random.default_rng(n)
    for share in (0.2, 0.6, 1.0, 0.0):
        masks = {m: tuple(int(v) for v in rng.integers(0, 4, 3)) for m in range(1 << n) if rng.random() < share}
        d, want, seen = fa.Diagram(masks, n), brute(masks, n), []
        for swap in (None, *fa.adjacent_swaps(n)):
            if swap is not None:
                d.swap(swap)
            seen.append(tuple(d.order))
            assert list(d.steps()) == want[seen[-1]]
            assert sum(map(len, d.known)) < 1 << n  # reduced: never more nodes than the whole tree
        assert sorted(seen) == sorted(want)


def test_equal_parts_of_a_diagram_are_kept_once():
    d = fa.Diagram({m: (1, 0, 0) for m in range(32)}, 5)
    assert sum(map(len, d.known)) == 5 and d.counts[d.root] == (32, 0, 0)
    assert fa.Diagram({0: (7, 1, 2)}, 5).steps and sum(map(len, fa.Diagram({0: (7, 1, 2)}, 5).known)) == 0


def report_of(docs, labels):
    """The contract, document by document."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in docs]
    fails = []
    for (i, t, _), w in zip(docs, words, strict=True):
        t = t or ""
        twin = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": twin})
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    rows, shapley = {}, {}
    for part in {p or "" for *_, p in docs}:
        own = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, bad = [k for k in left if fails[k][f]], [k for k in own if fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                rows[part, "".join(order), step] = (len(left), len(gone), len(bad) - len(gone), sum(sum(fails[k].values()) == 1 for k in bad), sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def test_every_document_in_every_order(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, long, "a"), (2, long, "a"), (2, long, "a"), (3, long, "b"), (1, long, "b"), (4, None, "a"), (5, "", None), (6, "  \n\t ", "a"), (7, "ABC def", "b"), (8, "x # y", "b"),
        (9, "same " * 300, "a"), (10, "same " * 300, "b"), (None, long, "a"), (None, None, None), (None, "x # y", "b"), (11, "É è | \x0b\x0c w", "a"), (12, long + " Q" * 60 + " $", "c"), (13, "a b　c", "c"), (0, "x # y", "d"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (9, None, 1), (9, 1, None), (9, 0, 0), (None, 1, 1), (77, 1, 1), (12, 1, 0), (10, None, None)]
    d = spark.createDataFrame([(i, t, s, 1, "x", 5) for i, t, s in docs], "doc_id long, text string, source string, mask int, Part string, n_words int").drop("Part")
    x = spark.createDataFrame([(*r, 3) for r in labels], "doc_id long, quality int, toxic int, text int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in fa.filter_audit(d, x).collect()}
    assert got == report_of(docs, labels)


def test_other_filters_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b", "s"), (2, "a", "s"), (3, None, "s")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in fa.filter_audit(d, none, {"short": "n_words < 2"}, None, "lang").collect()]
    assert got == [("s", "short", 1, 1, 2, 0, 2, 0, 0, 2)]
    two = fa.filter_audit(d, none, {"q": "n_words < 2", "p": "cast(null as boolean)"}, None, "lang").collect()
    assert sorted((r["filter_order"], r["step"], r["removed"]) for r in two) == [("pq", 1, 0), ("pq", 2, 2), ("qp", 1, 2), ("qp", 2, 0)]
    assert fa.filter_audit(d.limit(0), none, part="lang").collect() == []
    with pytest.raises(ValueError):
        fa.filter_audit(d, none, {str(k): "true" for k in range(8)}, None, "lang")


def test_the_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    rel = con.sql(fa.OP11_SQL)
    df = fa.op11_filter_audit(spark, DIR).select(*rel.columns)
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(rel.fetchall()) and len(got) % 600 == 0 and len(got) > 600
