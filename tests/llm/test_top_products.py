"""Exact inner products against all pairs."""

import math

import duckdb
import numpy as np
import pytest

from tidemark.llm import top_products as tp

DIR = "/root/testdata/sf0.001"


def brute(rows, every, k, scale=1024.0):
    """One list of (score, id) a distinct query row."""
    whole = {(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in whole:
        if i % every == 0:
            got = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in whole if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(got, 1)]
    return sorted(out)


def result(spark, rows, every, k, **more):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, Norm double")
    return sorted(map(tuple, tp.top_products(df, every, k, **more).collect()))


@pytest.mark.parametrize("sizes", [{}, {"atom": 16, "block": 48, "queries": 7}, {"atom": 8, "block": 8, "queries": 100}])
def test_equals_all_pairs(spark, sizes):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)) * rng.lognormal(0, 1, (300, 1)) * (0.7 ** np.arange(12))
    rows = [(i, v) for i, v in enumerate(x.round(2).tolist())]
    rows += [(400 + i, [0.25, -0.5]) for i in range(40)]  # ties, shorter vectors
    rows += [(500, None), (501, [1.0, None]), (502, [1.0, float("nan")]), (503, [float("inf")]), (None, [9.0] * 12), (600, []), (605, [0.0] * 12), (10, x[11].tolist()), (10, x[10].tolist())]
    rows += [(700, [0.1] * 12)] * 50  # a repeated row counts once
    assert result(spark, rows, 5, 4, **sizes) == brute(rows, 5, 4)


def test_few_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (100, [0.0, 0.0])]
    assert result(spark, rows, 100, 10) == brute(rows, 100, 10)
    assert result(spark, [], 100, 10) == [] and result(spark, [(7, [1.0])], 100, 10) == [] and result(spark, [(0, [1.0])], 100, 10) == []


def test_atoms_larger_than_a_block_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(tp, "ATOMS", 2)
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(200, 5)).round(3).tolist())]
    assert result(spark, rows, 10, 3, atom=16, block=16, queries=6) == brute(rows, 10, 3)


def test_large_components_are_exact_or_refused():
    search = tp.Search(np.eye(2), 1)
    big = np.array([[2.0**29, 2.0**29 - 1]])
    _, _, score = search.best(big, np.array([0]), np.array([-np.inf]), np.array([[2.0**29 + 1, 3.0]]), np.array([1]))
    assert score.tolist() == [2**29 * (2**29 + 1) + 3 * (2**29 - 1)]
    with pytest.raises(ValueError):
        search.best(big * 4, np.array([0]), np.array([-np.inf]), big * 4, np.array([1]))


def test_bounds_spare_most_pairs():
    """Skewed lengths and a falling spectrum: few pairs need their exact score."""
    rng = np.random.default_rng(7)
    x = np.floor(1024 * rng.normal(size=(20_000, 32)) * 0.8 ** np.arange(32) @ np.linalg.qr(rng.normal(size=(32, 32)))[0] * rng.lognormal(0, 0.5, (20_000, 1)))
    q, ids = x[::200], np.arange(20_000)
    search = tp.Search(tp.rotation_of(x), 10)
    who, found, score = search.best(q, ids[::200], np.full(len(q), -np.inf), x, ids)
    every = q @ x.T
    every[np.arange(len(q)), ids[::200]] = -np.inf
    want = {(i, j): int(every[i, j]) for i in range(len(q)) for j in np.lexsort((ids, -every[i]))[:10]}
    assert {(i, j): s for i, j, s in zip(who, found, score, strict=True)} == want
    assert search.scored < 0.15 * every.size


def test_waves_grow():
    assert tp.waves(1, 16) == [(0, 1)] and tp.waves(300, 16) == [(0, 1), (1, 16), (16, 256), (256, 300)]


def test_the_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    rel = con.sql(tp.OP12_SQL)
    got = sorted(map(tuple, tp.op12_top_products(spark, DIR).select(*rel.columns).collect()))
    assert got == sorted(rel.fetchall()) and len(got) == 50
