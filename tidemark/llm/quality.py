"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Unigrams and bigrams of words are hashed into BUCKETS buckets. One pass over all documents counts the buckets of the
raw corpus (every document) and of the target (every document that a label calls good). The raw multinomial gets add-one
smoothing; the target's gets BUCKETS counts spread like the raw one, so that without evidence the ratio is 0. A document's score is the mean over its n-grams of log p_target - log p_raw, with PRIOR n-grams of score 0
added so that very short texts don't hang on a word or two. Every document is kept or rejected by a fixed threshold.

Rules that need no model come first: too few words, or too large a share of words in repeated 5-word windows.

Counts cover all rows; what is gathered is one row for each bucket, whatever the input's size. Counts meet as sums of each
task's buckets; only labelled documents are joined.

Edge cases: null and empty texts have no words and fail the base rules, score 0; with no trusted documents all ratios
are 0 and only the base rules reject; repeated rows count each time in the raw corpus, and in the target if their doc_id is
trusted; a null doc_id is never trusted; an empty table gives an empty result; other columns are left alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WordHashes, per_text, table, windows

BITS = 16
BUCKETS = 1 << BITS
PRIOR = 16
THRESHOLD = -0.15
WINDOW = 5
#: Most trusted ids that are broadcast (8 MB).
SMALL = 1_000_000
# The characters that count as symbols, and as white space.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _hashes(text: str | None, memo: WordHashes) -> np.ndarray:
    return memo.of((text or "").encode("utf-8", "surrogatepass").split())


def _buckets(hashes: np.ndarray) -> np.ndarray:
    both = np.concatenate([windows(hashes, 1), windows(hashes, 2)])
    return (both >> np.uint64(64 - BITS)).astype(np.int64)


def repeat_words(hashes: np.ndarray) -> int:
    """Words in windows of WINDOW words that stand twice or more in the text."""
    w = windows(hashes, WINDOW)
    if len(w) < 2:
        return 0
    _, inverse, count = np.unique(w, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[inverse] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def base_counts(text: str | None, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """The columns of BASE."""
    text = text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return (len(hashes), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup, repeat_words(hashes))


def _counts(texts: DataFrame, name: str) -> DataFrame:
    """bucket and, as `name`, the n-grams of texts(text) in it: sums of each task's buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = WordHashes(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                total += np.bincount(_buckets(_hashes(text, memo)), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", name])

    return texts.select("text").mapInArrow(run, f"bucket long, {name} long").groupBy("bucket").agg(F.sum(name).alias(name))


def ratios(docs: DataFrame, trusted: DataFrame, small: int = SMALL) -> np.ndarray:
    """log p_target - log p_raw of each bucket. trusted(doc_id): documents of the target.

    The raw counts need no join. For the target's, at most `small` ids are broadcast; more of them meet the texts by a merge join."""
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    few = ids.limit(small + 1).count() <= small
    target_ = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id")
    raw, target = np.ones(BUCKETS), np.zeros(BUCKETS)
    # one row a bucket, whatever the input's size
    for counts, into in ((_counts(docs, "n"), raw), (_counts(target_, "n"), target)):
        got = counts.toPandas()
        into[got["bucket"].to_numpy(np.int64)] += got["n"].to_numpy(float)
    raw /= raw.sum()
    return np.log((target + BUCKETS * raw) / (target.sum() + BUCKETS)) - np.log(raw)


NEW = f"{BASE}, llr double, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, drop_text: bool = False) -> DataFrame:
    """The columns of docs(doc_id, text, ...), then BASE, llr, base_failed, kept. A column of docs that is named like one
    of these is replaced; drop_text leaves the texts where they are."""
    table_ = docs.sparkSession.sparkContext.broadcast(ratios(docs, trusted))

    def make() -> Callable[[list[str | None]], dict[str, object]]:
        memo, ratio = WordHashes(), table_.value

        def one(text: str | None) -> tuple:
            h = _hashes(text, memo)
            at = _buckets(h)
            n, chars, symbols, dup, again = base_counts(text, h)
            llr = float(ratio[at].sum() / (len(at) + PRIOR))
            failed = n < 10 or 100 * again > 20 * n
            return n, chars, symbols, dup, again, round(llr, 9), failed, not failed and llr >= threshold

        names = [f.split()[0] for f in NEW.split(", ")]
        return lambda texts: dict(zip(names, zip(*map(one, texts), strict=True) if texts else [()] * len(names), strict=True))

    return per_text(docs, make, NEW, drop_text=drop_text)


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, trusted_documents(spark, sf_dir), drop_text=True)
