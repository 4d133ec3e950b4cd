"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

The index is fitted on at most SAMPLE vectors (those with the smallest hashes of their ids) and holds every vector: its
list (nearest coarse centroid), the codes of its residual and the length of the error that the codes leave. A query
probes its nearest lists; distances to codes come from per-query tables (asymmetric). A true distance differs from that to
the code by the code's error at most, so within a block every vector whose distance to the code less its error doesn't
exceed the (K + 1)-th exact distance so far is ranked again by its exact distance, in double precision, and the K + 1
nearest are sent on. In the lists that a query probes no neighbour is lost, however many vectors share their codes.

Skew: equal vectors form one class, searched once, with its K + 1 smallest ids (more can't be among K nearest), so a
vector that a third of the rows share costs no more than another; equal queries are searched once. Lists are searched in
groups, whose codes and queries are cut into blocks of bounded size, whatever a list's size.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries or candidates; so
do vectors whose length isn't the sample's most frequent one; ties go to the smaller id; rows that repeat an id with an
equal vector count once; with fewer than K candidates all are returned; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

K, SAMPLE, SALTS = 10, 20_000, 64
#: A query probes so many lists that they hold this share of the K nearest neighbours that TRIED vectors of the sample have in it.
#: Vectors without cluster structure need most lists, clustered ones few. In the sample neighbours lie farther away than
#: among all vectors, so the share errs on the safe side.
RECALL, TRIED = 0.97, 256
#: Codes of a group, and most queries that meet a block of codes in one task: a block is copied once for each so many queries.
CODES, QUERIES = 16_384, 16_384
#: Vectors whose distances to the centroids are taken at once.
STEP = 1_024
#: Bounds are widened by this share of the vectors' lengths, far more than doubles are rounded by.
ROUNDING = 1e-12
#: Most lists; the sample has some five vectors for each.
LISTS = 4_096


@dataclass(frozen=True)
class Index:
    coarse: np.ndarray  # lists x dim
    books: np.ndarray  # parts x 256 x dim / parts
    probes: int

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, less what is the same for all of them."""
        return (self.coarse**2).sum(1)[None] - 2 * vectors @ self.coarse.T

    def list_of(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([self.distances(vectors[i : i + STEP]).argmin(1) for i in range(0, len(vectors), STEP)])

    def probed(self, vectors: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each vector its nearest lists: `probes` of them, and more until they hold `least` vectors."""
        for i in range(0, len(vectors), STEP):
            near = np.argsort(self.distances(vectors[i : i + STEP]), axis=1, kind="stable")
            enough = (np.cumsum(sizes[near], axis=1) < least).sum(1) + 1
            for row, n in zip(near, enough.tolist(), strict=True):
                yield row[: max(self.probes, n)]

    def encoded(self, residuals: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        out = np.empty((len(residuals), parts), np.uint8)
        for j in range(parts):
            own = residuals[:, j * width : (j + 1) * width]
            out[:, j] = ((self.books[j] ** 2).sum(1)[None] - 2 * own @ self.books[j].T).argmin(1)
        return out

    def errors(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Lengths of what the codes leave of the residuals."""
        parts, _, width = self.books.shape
        told = self.books[np.arange(parts)[None], codes].reshape(len(codes), parts * width)
        return np.sqrt(((residuals - told) ** 2).sum(1))

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """parts x 256: squared distance of the residual's parts to the codebooks."""
        parts, _, width = self.books.shape
        return ((self.books - residual.reshape(parts, 1, width)) ** 2).sum(2)


NONE = np.empty((1, 1, 1))


def _spread(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most k rows, each drawn with odds of its squared distance to those drawn before: a group of near-equal rows is
    drawn from once, so that it falls into one list."""
    length = (rows**2).sum(1)
    far, out = np.full(len(rows), np.inf), [int(rng.integers(len(rows)))]
    while len(out) < k:
        c = rows[out[-1]]
        np.minimum(far, np.maximum(length - 2 * rows @ c + c @ c, 0), out=far)
        far[far < ROUNDING * length] = 0
        total = np.cumsum(far)
        if total[-1] == 0:
            break
        out.append(int(np.searchsorted(total, rng.random() * total[-1], side="right")))
    return rows[out].copy()


def _means(rows: np.ndarray, centers: np.ndarray, steps: int) -> np.ndarray:
    k = len(centers)
    for _ in range(steps):
        at = Index(centers, NONE, 1).list_of(rows)
        count = np.bincount(at, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, rows)
        used = count > 0
        centers[used] = sums[used] / count[used, None]
    return centers


def fitted(sample: np.ndarray, total: int, recall: float = RECALL) -> Index:
    """An index for `total` vectors from a sample of them. A recall of 1 probes all lists."""
    rng = np.random.default_rng(7)
    lists = min(LISTS, 1 << round(np.log2(np.sqrt(total))), len(sample))
    coarse = _means(sample, _spread(sample, lists, rng), 12)
    lists = len(coarse)
    at = Index(coarse, NONE, 1).list_of(sample)
    residuals = sample - coarse[at]
    dim = sample.shape[1]
    parts = next(p for p in (32, 24, 16, 12, 8, 6, 4, 3, 2, 1) if dim % p == 0 and dim // p >= min(2, dim))
    drawn = lambda own: own[rng.choice(len(own), 256, replace=len(own) < 256)].copy()
    books = np.stack([_means(own, drawn(own), 8) for own in np.split(residuals, parts, axis=1)])
    return Index(coarse, books, _probes(sample, Index(coarse, NONE, 1), at, rng, recall) if recall < 1 else lists)


def _probes(sample: np.ndarray, index: Index, at: np.ndarray, rng: np.random.Generator, recall: float) -> int:
    """The number of lists that holds this share of the neighbours within the sample. at: each vector's list."""
    tried = rng.choice(len(sample), min(TRIED, len(sample)), replace=False)
    n = min(K + 1, len(sample))  # with the vector itself, which only errs by a list that's probed anyway
    near = np.argpartition((sample**2).sum(1)[None] - 2 * sample[tried] @ sample.T, n - 1, axis=1)[:, :n]
    place = np.argsort(np.argsort(index.distances(sample[tried]), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, at[near], axis=1), axis=1)[:, 1:] if n > 1 else np.zeros((1, 1))
    return int(np.quantile(ranks, recall, method="higher")) + 1


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    return rows.where(whole & F.exists("v", lambda x: x != 0))


def nearest(df: DataFrame, every: int, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by `every`, among all other rows."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors(df, vec_id, embedding)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    if not len(some):
        return empty
    dim = int(pd.Series([len(v) for v in some]).mode()[0])
    rows = rows.where(F.size("v") == dim)

    # classes of equal vectors: the smallest ids, first within a task's batch, then within salts, then all
    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first: dict[int, list] = {}
            for i, v, same in sorted(zip(pdf["id"], pdf["v"], pdf["same"], strict=True), key=lambda r: r[0]):
                own = first.setdefault(same, [v, []])[1]
                if len(own) <= k and own[-1:] != [i]:
                    own.append(i)
            rows = [(same, v, ids, ids[0] % SALTS) for same, (v, ids) in first.items()]
            yield pd.DataFrame(rows, columns=["same", "v", "ids", "salt"])

    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    part = rows.withColumn("same", F.xxhash64("v")).mapInPandas(combine, "same long, v array<double>, ids array<long>, salt long")
    for keys in (("same", "salt"), ("same",)):
        part = part.groupBy(*keys).agg(F.first("v").alias("v"), smallest)
    classes = stored(part.select(F.col("ids")[0].alias("key"), "same", "v", "ids"), "classes")
    index_size = classes.count()
    index = fitted(_matrix(pd.Series([v for v in some if len(v) == dim])), index_size, recall)
    model = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v, x = _matrix(pdf["v"]), model.value
                at = x.list_of(v)
                rest = v - x.coarse[at]
                code = x.encoded(rest)
                yield pd.DataFrame({"list": at, "key": pdf["key"], "code": [c.tobytes() for c in code], "error": x.errors(rest, code), "whole": [w.tobytes() for w in v]})

    # lists are searched in groups; a query goes to each group once, with its lists there
    groups = max(1, min(len(index.coarse), index_size // CODES))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                out = []
                for key, v, at in zip(pdf["key"], pdf["v"], model.value.probed(_matrix(pdf["v"]), sizes, k + 1), strict=True):
                    by = np.argsort(at % groups, kind="stable")
                    g = (at % groups)[by]
                    edges = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
                    out += [(int(g[a]), key, v, at[by[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
                yield pd.DataFrame(out, columns=["g", "query", "v", "lists"])

    asked = rows.where(F.col("id") % every == 0).select("id", F.xxhash64("v").alias("same")).distinct()
    asked = stored(asked.join(classes.select("same", "key"), "same").select(F.col("id").alias("query_id"), F.col("key").alias("query")), "queries")
    queries = classes.select("key", "v").join(asked.select(F.col("query").alias("key")).distinct(), "key").select("key", "v")
    codes = stored(classes.select("key", "v").mapInPandas(encode, "list int, key long, code binary, error double, whole binary"), "codes")
    sizes = np.zeros(len(index.coarse), np.int64)
    for at, n in codes.groupBy("list").count().collect():  # at most LISTS rows
        sizes[at] = n
    probed = stored(queries.mapInPandas(probe, "g int, query long, v array<double>, lists array<int>"), "probes")

    # groups are cut into blocks by their counts: one row a group is gathered, at most LISTS
    codes = codes.withColumn("g", F.col("list") % groups)
    count = lambda side: {r[0]: r[1] for r in side.groupBy("g").count().collect()}
    of = lambda sizes: F.element_at(F.from_json(F.lit(_json(sizes)), "map<string,int>"), F.col("g").cast("string"))
    nc, nq = count(codes), count(probed)
    cb, qb = ({g: max(1, -(-n.get(g, 0) // size)) for g in {*nc, *nq}} for n, size in ((nc, 2 * CODES), (nq, QUERIES)))
    spread = lambda sizes: F.explode(F.sequence(F.lit(0), of(sizes) - 1))
    left = codes.withColumn("c", F.pmod(F.xxhash64("key"), of(cb)).cast("int")).withColumn("q", spread(qb))
    right = probed.withColumn("q", F.pmod(F.xxhash64("query"), of(qb)).cast("int")).withColumn("c", spread(cb))

    def search(code: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "key": [], "score": []}).astype({"query": "int64", "key": "int64"})]
        if len(code) and len(query):
            x = model.value
            code = code.sort_values(["list", "key"])
            c = np.frombuffer(b"".join(code["code"]), np.uint8).reshape(len(code), -1).astype(np.intp)
            c += np.arange(c.shape[1]) * 256
            whole = np.frombuffer(b"".join(code["whole"])).reshape(len(code), -1)
            keys, lists = code["key"].to_numpy(), code["list"].to_numpy()
            error = code["error"].to_numpy() + ROUNDING * np.sqrt((whole**2).sum(1))
            for q, v, probes in zip(query["query"], query["v"], query["lists"], strict=True):
                v = np.asarray(v, float)
                spans = list(zip(np.searchsorted(lists, probes), np.searchsorted(lists, probes, "right"), probes, strict=True))
                at = np.concatenate([np.arange(a, b) for a, b, _ in spans])
                if not len(at):
                    continue
                d = np.sqrt(np.concatenate([x.tables(v - x.coarse[p]).ravel()[c[a:b]].sum(1) for a, b, p in spans]))
                limit = _distances(whole[at[_smallest(d, k + 1)]], v).max() if len(at) > k + 1 else np.inf
                least = d - error[at] - ROUNDING * np.sqrt((v**2).sum())
                at = at[~(least > limit)]
                score, key = _distances(whole[at], v), keys[at]
                best = np.lexsort((key, score))[: k + 1]
                out.append(pd.DataFrame({"query": q, "key": key[best], "score": score[best]}))
        return pd.concat(out)

    # dealt out by number, so that a few rows with much work aren't merged into a few tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, right = (x.repartition(tasks, "g", "c", "q") for x in (left, right))
    found = left.groupBy("g", "c", "q").cogroup(right.groupBy("g", "c", "q")).applyInPandas(search, "query long, key long, score double")
    order = Window.partitionBy("query").orderBy("score", "key")
    found = stored(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("query", "key", "score"), "found")
    near = found.join(classes.select("key", "ids"), "key")
    near = stored(near.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near")), "near")
    # every query row of a class takes the class's list, without itself
    flat = asked.join(near, "query").select("query_id", F.explode("near").alias("x")).select("query_id", "x.score", F.explode("x.ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _distances(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = rows - v
    return np.sqrt((d * d).sum(1))


def _smallest(d: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest, ties to the front ones."""
    limit = np.partition(d, n - 1)[n - 1] if n < len(d) else np.inf
    at = np.flatnonzero(d <= limit)
    return at[np.argsort(d[at], kind="stable")][:n]


def _json(sizes: dict[int, int]) -> str:
    return "{" + ",".join(f'"{a}":{b}' for a, b in sorted(sizes.items())) + "}"


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), 100)
