"""Toxicity: a counterfactual-regularised classifier.

A logistic model over hashed words is fitted so that it (1) predicts the label of a text and (2) gives the same score
to the text with its identity terms swapped for others: the loss has a term PENALTY * (z(text) - z(swapped))^2 on the
logits. Weight that a group name would pick up from biased examples costs twice, so a neutral mention of a group does
not raise the score. Swaps are made sentence by sentence: each sentence with an identity term takes the next term of
the same kind.

Learning looks at no more than SAMPLE labelled rows (the bound is a parameter), those with the smallest hashes of their
doc_id, and at the whole text of each; rows whose crc32(doc_id as text) mod 5 is 0 are held out of learning. Words are counted and
chosen in Spark, and only chosen ones are gathered. Every document is scored on its whole text, from the text alone.

Edge cases: null and empty texts get the score of a text without words; with no labelled rows, or labels of one class
only, the score is the (smoothed) share of that class; a sampled doc_id that several texts share is learned from one of them; repeated rows get equal scores; a null doc_id is never learned
from and counts as not held out; an empty table gives an empty result."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import per_text, stored, table, without

BITS = 18
SAMPLE = 12_000
#: Longest word (bytes) that a task keeps.
LONG = 64
PENALTY, RIDGE, STEPS, RATE = 0.5, 1e-4, 300, 0.1
#: A bucket is used if at least SEEN rows have it and its shares among the two labels differ by CLEAR standard errors.
SEEN, CLEAR = 4, 4.0

# Identity terms by kind; a term is swapped for the next one of its kind.
IDENTITY = (
    ("men", "women"),
    ("man", "woman"),
    ("boys", "girls"),
    ("he", "she"),
    ("his", "her"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous", "arab"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("disabled", "blind", "deaf"),
    ("old", "young"),
    ("immigrant", "native"),
    ("immigrants", "natives"),
    ("american", "mexican", "chinese", "german", "french", "spanish", "african"),
    ("hommes", "femmes"),
    ("männer", "frauen"),
    ("hombres", "mujeres"),
)

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_SENTENCE = re.compile(r"[.!?\n]+")
SWAPS = {a.encode(): b.encode() for kind in IDENTITY for a, b in zip(kind, kind[1:] + kind[:1], strict=True)}


class Buckets(dict):
    """Word -> bucket, kept for at most `most` short words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word) >> (64 - BITS)
        if len(word) <= LONG:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def swapped(text: str | None) -> list[bytes]:
    """The words of the text, sentence by sentence, with identity terms replaced."""
    return [SWAPS.get(w, w) for sentence in _SENTENCE.split(text or "") for w in words_of(sentence)]


def features(words: list[bytes], memo: Buckets) -> np.ndarray:
    """The distinct buckets of the words."""
    return np.unique(np.fromiter(map(memo.__getitem__, set(words)), np.int64))


def fit(y: np.ndarray, plain: list[np.ndarray], other: list[np.ndarray], size: int, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights of `size` features and bias from labels, each row's features and those after the swap, by Adam on all rows."""
    bias = prior(y.sum(), len(y))

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)

    (r1, c1), (r2, c2) = matrix(plain), matrix(other)
    differs = np.array([len(a) != len(b) or bool((a != b).any()) for a, b in zip(plain, other, strict=True)])
    keep1, keep2 = differs[r1], differs[r2]
    rx, cx = np.concatenate([r1[keep1], r2[keep2]]), np.concatenate([c1[keep1], c2[keep2]])
    sign = np.concatenate([np.ones(keep1.sum()), -np.ones(keep2.sum())])
    w, m, v, b, mb, vb = np.zeros(size), np.zeros(size), np.zeros(size), bias, 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = b + np.bincount(r1, w[c1], len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gap = np.bincount(rx, sign * w[cx], len(y))
        g = np.bincount(c1, ((p - y) / len(y))[r1], size) + RIDGE * w
        g += np.bincount(cx, sign * (2 * penalty / len(y) * gap)[rx], size)
        gb = float((p - y).mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = RATE / (1 + t / 100)
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (vb / (1 - 0.999**t)) ** 0.5 if vb else 0.0
    return w, b


def prior(ones: float, rows: int) -> float:
    """The bias that gives the smoothed share of label 1."""
    share = (ones + 1) / (rows + 2)
    return float(np.log(share / (1 - share)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """The model from at most `sample` rows that labels(doc_id, toxic) label and that aren't held out."""
    some = labels.where("doc_id is not null and toxic is not null").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    # at most `sample` short rows: small enough to broadcast whatever the input's size. Documents may repeat a doc_id: one text of each
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def make() -> Callable[[list[str | None]], dict[str, object]]:
        memo = Buckets()
        return lambda texts: {"a": [features(words_of(t), memo) for t in texts], "b": [features(swapped(t), memo) for t in texts]}

    rows = stored(per_text(rows.select((F.col("toxic") == 1).cast("int").alias("y"), "text"), make, "a array<int>, b array<int>", drop_text=True), "learned")
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    full, bias = np.zeros(1 << BITS), prior(n1, n)
    if not 0 < n1 < n:
        return full, bias
    # the buckets that tell the labels apart; what is gathered is a row a bucket, and then each row's buckets among them
    seen = rows.select("y", F.explode("a").alias("bucket")).groupBy("bucket").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).where(F.col("n") >= SEEN).toPandas()
    ones, all_ = seen["ones"].to_numpy(float), seen["n"].to_numpy(float)
    both = all_ / n
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n1 + 1 / (n - n1)))
    used = np.sort(seen["bucket"].to_numpy(np.int64)[np.abs(ones / n1 - (all_ - ones) / (n - n1)) >= CLEAR * error])

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column("y")]
            for c in ("a", "b"):
                col = batch.column(c)
                flat, lengths = col.flatten().to_numpy(), np.diff(col.offsets.to_numpy())
                at = np.searchsorted(used, flat)
                ok = used[np.minimum(at, len(used) - 1)] == flat
                row = np.repeat(np.arange(len(lengths)), lengths)[ok]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lengths)))])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[ok], pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["y", "a", "b"])

    if len(used):
        got = rows.mapInArrow(narrow, rows.schema).toPandas().sort_values("y", kind="stable")
        lists = [[np.asarray(x, np.int64) for x in got[c]] for c in ("a", "b")]
        full[used], bias = fit(got["y"].to_numpy(float), *lists, len(used), penalty)
    return full, bias


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, drop_text: bool = False) -> DataFrame:
    """The columns of docs(doc_id, text, ...), then held_out, score, predicted; a column named like one of these is replaced.
    drop_text leaves the texts where they are."""
    weights, bias = learn(docs, labels, sample)
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))
    left = without(docs, ["held_out"]).withColumn("held_out", held_out())

    def make() -> Callable[[list[str | None]], dict[str, object]]:
        memo, (w, b) = Buckets(), model.value

        def f(texts: list[str | None]) -> dict[str, object]:
            z = np.array([b + float(w[features(words_of(t), memo)].sum()) for t in texts])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

        return f

    return per_text(left, make, "score double, predicted int", drop_text=drop_text)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels"), drop_text=True)
