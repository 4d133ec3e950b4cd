"""Exact top-k search by inner product over integer vectors: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are dealt out in ranges of descending length ("atoms"), the queries being some of their rows. Waves take the longest atom
first, then sixteen times as many at each step, so that a query meets a wave with the k-th best score of all longer vectors:
a block whose longest vector times the query's length doesn't reach it isn't sent to the query at all. A tile is a block of
candidates and a group of queries, both of bounded size; a query's best k of each tile go on, and the best k of all are kept
as a Parquet table between waves.

Within a tile, vectors are rotated by the right singular vectors of a sample, which moves most of their length to the front.
Candidates go by in chunks of descending length; a partial sum over the first coordinates plus the product of the two lengths
that are left bounds a score from above (Cauchy-Schwarz), and only pairs whose bound reaches the k-th best score so far go on to
more coordinates and, in the end, to their exact score in the original integers. A rotation keeps inner products whatever it
was fitted on, and bounds are widened by more than doubles are rounded by, so the sample decides speed alone.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; shorter vectors
count as filled up with zeros; rows that repeat an id with an equal vector count once; an id with several vectors is a query
or candidate with each, and never its own candidate; equal scores go to the smaller id; with fewer than k candidates all are
returned; an empty table gives an empty result. Components beyond 32 bits once scaled are refused, and so are scores beyond 64."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import by_runs, stored, table

K, SCALE = 10, 1024.0
#: Vectors of an atom, most atoms (beyond, atoms grow), the factor from wave to wave.
ATOM, ATOMS, GROW = 4_096, 4_096, 16
#: Most candidates and queries of a tile.
BLOCK, QUERIES = 65_536, 65_536
#: Vectors that the rotation is fitted on.
SAMPLE = 20_000
#: Queries and candidates whose products are taken at once, and the share of pairs from which whole matrices are multiplied.
ROWS, CHUNK, DENSE = 256, 2_048, 1 / 8
#: Doubles hold integers up to this exactly.
EXACT = 2.0**53


def packed(df: DataFrame, vec_id: str, embedding: str, scale: float = SCALE) -> DataFrame:
    """id, v (floor(scale * x) as little-endian 32-bit integers), norm; each pair of id and vector once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("id"), batch.column("x")
            keep = pc.and_(pc.is_valid(ids), pc.is_valid(lists))
            ids, lists = ids.filter(keep), lists.filter(keep)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
            row = np.repeat(np.arange(len(size)), size)
            whole = np.ones(len(size), bool)
            whole[row[~np.isfinite(x)]] = False
            x = np.floor(scale * np.where(whole[row], x, 0))
            if (np.abs(x) >= 2**31).any():
                raise ValueError("a scaled component doesn't fit in 32 bits")
            norm = np.sqrt(np.bincount(row, x * x, len(size)))
            end = np.cumsum(size) * 4
            data = x.astype("<i4").tobytes()
            v = [data[e - 4 * n : e] for e, n in zip(end.tolist(), size.tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays([ids, pa.array(v, pa.binary()), pa.array(norm)], names=["id", "v", "norm"])
            yield out.filter(pa.array(whole))

    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x"))
    return rows.mapInArrow(pack, "id long, v binary, norm double").groupBy("id", "v").agg(F.first("norm").alias("norm"))


def matrix(v: np.ndarray, dim: int) -> np.ndarray:
    """Packed vectors as rows of doubles, filled up with zeros."""
    data = b"".join([x.ljust(4 * dim, b"\0") for x in v])
    return np.frombuffer(data, "<i4").reshape(len(v), dim).astype(np.float64)


def rotation_of(sample: np.ndarray) -> np.ndarray:
    """Columns: the right singular vectors, those with the most length first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()


class Search:
    """The best k candidates of each query of a tile that aren't below the query's threshold."""

    def __init__(self, rotation: np.ndarray, k: int):
        self.rotation, self.k, self.dim = rotation, k, len(rotation)
        self.levels = sorted({max(1, self.dim // 8), max(1, self.dim // 4), max(1, self.dim // 2)})
        self.scored = 0  # pairs whose exact score was taken

    def _turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Rotated rows, their lengths, and the lengths of what is left of them from each level on."""
        turned = x @ self.rotation
        return turned, np.sqrt((x * x).sum(1)), [np.sqrt((turned[:, m:] ** 2).sum(1)) for m in self.levels]

    def _scores(self, q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, largest: float) -> np.ndarray:
        """Exact products of the pairs (i, j) as 64-bit integers."""
        self.scored += len(i)
        if largest >= 2.0**62:
            raise ValueError("a score may not fit in 64 bits")
        if largest >= EXACT:
            return np.concatenate([np.empty(0, np.int64), *((q[i[a : a + CHUNK]].astype(np.int64) * x[j[a : a + CHUNK]].astype(np.int64)).sum(1) for a in range(0, len(i), CHUNK))])
        if len(i) > DENSE * len(q) * len(x):
            return (q @ x.T)[i, j].astype(np.int64)  # sums of integers below 2 ** 53 are exact in any order
        return np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", q[i[a : a + CHUNK]], x[j[a : a + CHUNK]]) for a in range(0, len(i), CHUNK))]).astype(np.int64)

    def best(self, q: np.ndarray, own: np.ndarray, least: np.ndarray, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query's row in q, candidate's id, score. own: the queries' ids; least: their thresholds."""
        order = np.lexsort((ids, -(x * x).sum(1)))
        x, ids = x[order], ids[order]
        xr, xn, xrest = self._turned(x)
        out = []
        for a in range(0, len(q), ROWS):
            i, j, s = self._of_some(q[a : a + ROWS], own[a : a + ROWS], least[a : a + ROWS].copy(), x, ids, xr, xn, xrest)
            out.append((i + a, j, s))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3

    def _of_some(self, q, own, least, x, ids, xr, xn, xrest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        qr, qn, qrest = self._turned(q)
        who, found, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for c in range(0, len(x), CHUNK):
            part = slice(c, c + CHUNK)
            largest = qn * xn[c]
            slack = largest * 1e-9 + 1e-3
            act = np.flatnonzero(largest + slack >= least)
            if not len(act):
                break  # the chunks that follow hold shorter vectors
            floor = (least - slack)[act, None]
            sums, done = np.zeros((len(act), len(xn[part]))), 0
            alive = np.ones(sums.shape, bool)
            for m, qz, xz in zip(self.levels, qrest, xrest, strict=True):
                sums += qr[act, done:m] @ xr[part, done:m].T
                done = m
                alive = sums + qz[act, None] * xz[None, part] >= floor
                if alive.mean() <= DENSE:
                    break
            i, j = np.nonzero(alive & (own[act, None] != ids[None, part]))
            s = self._scores(q[act], x[part], i, j, float(largest[act].max(initial=0)))
            i = act[i]
            good = s >= least[i]
            who, found, score = np.concatenate([who, i[good]]), np.concatenate([found, ids[part][j[good]]]), np.concatenate([score, s[good]])
            order = np.lexsort((found, -score, who))
            who, found, score = who[order], found[order], score[order]
            start = np.searchsorted(who, who)  # of the query's rows
            top = np.arange(len(who)) - start < self.k
            who, found, score = who[top], found[top], score[top]
            full = np.flatnonzero(np.bincount(who, minlength=len(q)) == self.k)
            least[full] = np.maximum(least[full], score[np.searchsorted(who, full, "right") - 1])
        return who, found, score


def waves(atoms: int, grow: int) -> list[tuple[int, int]]:
    """Ranges of atoms: the first, then up to `grow` times as many as so far."""
    out, at = [], 0
    while at < atoms:
        upto = min(atoms, max(1, at * grow))
        out.append((at, upto))
        at = upto
    return out


def top_products(df: DataFrame, every: int, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = SCALE, atom: int = ATOM, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row whose id is divisible by `every`, among all others."""
    spark = df.sparkSession
    atoms = min(ATOMS, max(1, -(-df.count() // atom)))
    by_length = packed(df, vec_id, embedding, scale).repartitionByRange(atoms, F.desc("norm"), "id", "v").sortWithinPartitions(F.desc("norm"), "id")
    rows = stored(by_length.withColumn("atom", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "by-length")
    size = rows.agg(F.count("*"), F.max(F.length("v")), F.count_if(F.col("id") % every == 0)).first()
    if not size[2]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, dim, asked = size[0], max(1, size[1] // 4), size[2]
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n // SAMPLE))) == 0).select("v").limit(2 * SAMPLE).collect()
    rotation = rotation_of(matrix(np.array([bytes(r[0]) for r in sample] or [b""], object), dim))
    longest = dict(rows.groupBy("atom").agg(F.max("norm")).collect())  # at most ATOMS rows
    groups, cells = -(-asked // queries), max(1, -(-n // atoms // block))  # an atom larger than a block is cut into cells
    taken = max(1, block // -(-n // atoms))  # atoms of a block

    def make() -> Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None]:
        search = Search(rotation, k)

        def f(tile: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
            q, c = np.flatnonzero(tile["asks"] == 1), np.flatnonzero(tile["asks"] == 0)
            if not len(q) or not len(c):
                return None
            i, found, score = search.best(matrix(tile["v"][q], dim), tile["id"][q], tile["least"][q], matrix(tile["v"][c], dim), tile["id"][c])
            return {"row": tile["row"][q][i], "query_id": tile["id"][q][i], "id": found, "score": score}

        return f

    hits = "row long, query_id long, id long, score long"
    best = spark.createDataFrame([], hits)
    of_query = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    wanted = rows.where(F.col("id") % every == 0).select("row", "id", "v", "norm")
    for first, upto in waves(atoms, GROW):
        per = min(taken, max(1, first))  # small blocks in early waves, so that many tasks share them
        bounds = [(b, max(longest.get(a, 0.0) for a in range(first + b * per, min(upto, first + (b + 1) * per)))) for b in range(-(-(upto - first) // per))]
        edge = best.groupBy("row").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("least"))
        asks = wanted.join(edge, "row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(len(bounds) - 1)))).join(F.broadcast(spark.createDataFrame(bounds, "block int, longest double")), "block")
        reach = F.col("norm") * F.col("longest")
        asks = asks.where(reach * (1 + 1e-9) + 1 >= F.col("least")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
        gives = rows.where(F.col("atom").between(first, upto - 1)).withColumn("block", F.floor((F.col("atom") - first) / per).cast("int")).withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int"))
        gives = gives.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("least", F.lit(0.0))
        tile = ((F.col("block") * cells + F.col("cell")).cast("long") * groups + F.col("group")).alias("tile")
        shown = lambda d, asks: d.select(tile, F.lit(asks).alias("asks"), "row", "id", "v", "least")
        found = by_runs(shown(gives, 0).unionByName(shown(asks, 1)), ["tile"], make, hits)
        best = stored(best.unionByName(found).withColumn("rank", F.row_number().over(of_query)).where(F.col("rank") <= k).drop("rank"), "best")
    return best.select("query_id", F.row_number().over(of_query).cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), 100)


OP12_SQL = f"""
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
