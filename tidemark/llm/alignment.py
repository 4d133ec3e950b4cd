"""Cross-tokenizer alignment: two tokenizers' ids over the same bytes, cut into groups wherever both end a token.

A stretch of text is a fragment: an open prefix (ids up to the first place where both tokenizers end a token, whose group may
have begun before the stretch), closed groups, an open suffix (ids after the last such place). Fragments compose: a suffix and
the prefix after it close a group. That is associative, so fragments of a document can be composed in any bracketing. Closed
groups need nothing more from their neighbours: they leave as rows of their own, and only prefixes and suffixes go up the tree.

Documents of up to LONG bytes are aligned whole, a batch at a time as one sequence (every text's end is an end of both).
Longer ones are cut into ranges of CHUNK bytes and more, each up to the next single blank between letters or digits, across
which neither tokenizer has a token; ranges are dealt to tasks, and FAN fragments at a time composed, level by level.

A pair of ids is counted once a document. Whole documents come in blocks: a block's distinct pairs are sent to the counts and
come back with them, so that a pair of nearly all documents is one row a block, and no table of all pairs is broadcast. The
pairs of long documents are rows, joined by pair. The highest counts of the first vocabulary's ids are broadcast: no more rows
than it has ids.

Edge cases: texts that are null or empty, or whose tokens' bytes aren't those of a blank and the text (such as texts that hold
U+2581), have no tokens: zeros, and '' for the digest; rows that repeat a doc_id or a text, or have no doc_id, are documents of
their own; texts without such a blank are one range, however long; other columns are ignored; an empty table gives an empty
result."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ROWS, by_runs, stored, table
from tidemark.llm.pieces import piece_bytes, piece_encoder
from tidemark.llm.tokens import byte_level_bytes, byte_level_encoder, public_path

LONG, CHUNK = 65_536, 32_768
#: Fragments composed at once.
FAN = 8
#: Pairs of documents that a block holds before the next one begins.
ENTRIES = 4_000_000
#: Bytes of texts or ids that are aligned at once, and a single text or range at least.
STEP = 4_000_000


class Side:
    """One tokenizer's ids: their bytes and lengths."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.size = raw, np.array([len(b) for b in raw], np.int64)

    def spells(self, ids: np.ndarray, data: bytes) -> bool:
        return b"".join(map(self.raw.__getitem__, ids.tolist())) == data


@dataclass
class Closed:
    """Sequences of both sides that begin and end together, with their groups and links; of several texts at once."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray  # of each token
    group_b: np.ndarray
    link_a: np.ndarray  # positions of the tokens of each link, by a, then b
    link_b: np.ndarray


NONE = np.empty(0, np.int64)


def ends(ids: np.ndarray, side: Side, start: int = 0) -> np.ndarray:
    return start + np.cumsum(side.size[ids])


def common(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens of either side that end where one of the other does."""
    if not len(end_a) or not len(end_b):
        return NONE, NONE
    at = np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)
    cut = np.flatnonzero(end_b[at] == end_a)
    return cut, at[cut]


def closed(a: np.ndarray, b: np.ndarray, x: Side, y: Side) -> Closed:
    end_a, end_b = ends(a, x), ends(b, y)
    cut_a, cut_b = common(end_a, end_b)
    group_a, group_b = np.searchsorted(cut_a, np.arange(len(a))), np.searchsorted(cut_b, np.arange(len(b)))
    if not len(a):
        return Closed(a, b, group_a, group_b, NONE, NONE)
    first = np.searchsorted(end_b, end_a - x.size[a], "right")  # the tokens of b that overlap each of a: first, last
    n = np.searchsorted(end_b, end_a, "left") - first + 1
    link_a = np.repeat(np.arange(len(a)), n)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(n) - n, n) + first[link_a]
    return Closed(a, b, group_a, group_b, link_a, link_b)


@dataclass
class Fragment:
    """cut: whether both sides end a token somewhere in it; without, all ids are in the prefix."""

    cut: bool
    prefix: tuple[np.ndarray, np.ndarray]
    suffix: tuple[np.ndarray, np.ndarray] = (NONE, NONE)


Ids = tuple[np.ndarray, np.ndarray]


def fragment(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> tuple[Fragment, Ids]:
    """The fragment of the tokens that end in a range of bytes, and the ids of its closed groups."""
    cut_a, cut_b = common(end_a, end_b)
    if not len(cut_a):
        return Fragment(False, (a, b)), (NONE, NONE)
    i, j, k, m = cut_a[0] + 1, cut_b[0] + 1, cut_a[-1] + 1, cut_b[-1] + 1
    return Fragment(True, (a[:i], b[:j]), (a[k:], b[m:])), (a[i:k], b[j:m])


def joined(x: Ids, y: Ids) -> Ids:
    return np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])


def composed(f: Fragment, g: Fragment) -> tuple[Fragment, Ids | None]:
    """Both in a row, and the ids of the group that they close between them, if they do."""
    if not g.cut:
        return (Fragment(True, f.prefix, joined(f.suffix, g.prefix)) if f.cut else Fragment(False, joined(f.prefix, g.prefix))), None
    if not f.cut:
        return Fragment(True, joined(f.prefix, g.prefix), g.suffix), None
    return Fragment(True, f.prefix, g.suffix), joined(f.suffix, g.prefix)


class Aligner:
    """Both tokenizers, with what is written for their ids."""

    def __init__(self, x: Side, y: Side, encode_a: Callable[[str], np.ndarray], encode_b: Callable[[str], np.ndarray]):
        self.x, self.y, self.encode_a, self.encode_b = x, y, encode_a, encode_b
        self.width = len(y.raw)
        after = lambda n, *marks: [f"{i}{m}" for m in marks for i in range(n)]
        self.shown = after(len(x.raw), ",", "|") + after(len(y.raw), ",", ";")

    def ids(self, text: str | None) -> Ids | None:
        """Of a blank and the text; None if either side's bytes differ from that."""
        if not text:
            return NONE, NONE
        data = f" {text}".encode()
        a, b = self.encode_a(f" {text}").astype(np.int64), self.encode_b(text).astype(np.int64)
        return (a, b) if self.x.spells(a, data) and self.y.spells(b, data) else None

    def written(self, c: Closed, upto_a: np.ndarray) -> list[str]:
        """The groups of each text as text; upto_a: where each text ends among the ids of a."""
        n_a, n_b = len(c.a), len(c.b)
        if not n_a:
            return [""] * len(upto_a)
        last_a, last_b = np.append(c.group_a[1:] != c.group_a[:-1], True), np.append(c.group_b[1:] != c.group_b[:-1], True)
        groups = c.group_a[-1] + 1
        size_a, size_b = np.bincount(c.group_a, minlength=groups), np.bincount(c.group_b, minlength=groups)
        before_b, upto = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        place = np.empty(n_a + n_b, np.int64)
        place[np.arange(n_a) + before_b[c.group_a]] = c.a + last_a * len(self.x.raw)
        place[np.arange(n_b) + upto[c.group_b]] = 2 * len(self.x.raw) + c.b + last_b * self.width
        words = list(map(self.shown.__getitem__, place.tolist()))
        group_ends = np.append(0, np.cumsum(size_a + size_b))
        done = np.append(0, c.group_a + 1)[upto_a]  # groups up to each text's end
        stops = group_ends[done].tolist()
        return ["".join(words[a:b])[:-1] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def pairs(self, c: Closed, text_of_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, code and number of links of each text's distinct pairs, in order."""
        span = len(self.x.raw) * self.width
        keys, times = np.unique(text_of_a[c.link_a] * span + c.a[c.link_a] * self.width + c.b[c.link_b], return_counts=True)
        return keys // span, keys % span, times


@lru_cache(2)
def aligner(json_path: str, ranks_path: str, model: str) -> Aligner:
    pieces = piece_encoder(model)
    return Aligner(Side(byte_level_bytes(json_path)), Side(piece_bytes(model)), byte_level_encoder(json_path, ranks_path, False), lambda t: np.frombuffer(pieces.encode(t), "<u4"))


def ranges(text: str, chunk: int) -> Iterator[str]:
    """The text in parts of `chunk` bytes and more. A part ends before a single blank between letters or digits, which is
    left out: each part is encoded with a blank in front, like a text."""
    data, at = text.encode(), 0
    while at < len(data):
        cut = data.find(b" ", at + chunk)
        while cut >= 0:
            before, after = data[max(at, cut - 4) : cut].decode("utf-8", "ignore")[-1:], data[cut + 1 : cut + 5].decode("utf-8", "ignore")[:1]
            if before.isalnum() and after.isalnum():
                break
            cut = data.find(b" ", cut + 1)
        if cut < 0:
            cut = len(data)
        yield data[at:cut].decode()
        at = cut + 1


def bounded(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of up to ROWS rows that hold about STEP bytes of this column."""
    for batch in batches:
        if batch.num_rows:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(sizes) // STEP + np.arange(batch.num_rows) // ROWS * (int(sizes.sum()) // STEP + 1)
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield batch.slice(a, b - a)


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(flat, kind))


MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def measures(c: Closed, text_of_a: np.ndarray, text_of_b: np.ndarray, n: int) -> dict[str, np.ndarray]:
    last = np.append(c.group_a[1:] != c.group_a[:-1], True) if len(c.a) else np.empty(0, bool)
    count = lambda of: np.bincount(of, minlength=n)
    return {"n_a": count(text_of_a), "n_b": count(text_of_b), "n_groups": count(text_of_a[last]), "n_links": count(text_of_a[c.link_a])}


def align_batch(al: Aligner, parts: list[Ids]) -> tuple[dict[str, np.ndarray], list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Measures, groups as text and pairs of sequences that each begin and end on both sides."""
    n_a, n_b = [len(a) for a, _ in parts], [len(b) for _, b in parts]
    c = closed(np.concatenate([NONE, *(a for a, _ in parts)]), np.concatenate([NONE, *(b for _, b in parts)]), al.x, al.y)
    of_a, of_b = np.repeat(np.arange(len(parts)), n_a), np.repeat(np.arange(len(parts)), n_b)
    return measures(c, of_a, of_b, len(parts)), al.written(c, np.cumsum(n_a)), al.pairs(c, of_a)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def _whole(docs: DataFrame, make: Callable[[], Aligner], kind: str, groups: bool) -> DataFrame:
    """Rows of documents (docs null) and, after those of each block, one of its distinct pairs and in how many documents they are."""
    number = pa.int32() if kind == "int" else pa.int64()
    names = ["doc_id", "block", *MEASURES, "groups_sha256", "groups", "codes", "times", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, task = make(), TaskContext.get().partitionId()
        block, held, size = 0, [], 0

        def of_block() -> pa.RecordBatch:
            codes, docs = np.unique(np.concatenate(held), return_counts=True)
            null = lambda k: pa.nulls(1, k)
            return pa.RecordBatch.from_arrays(
                [null(pa.int64()), pa.array([task << 32 | block]), *[null(pa.int64())] * 4, null(pa.string()), null(pa.string()), _lists(codes, [len(codes)], number), null(pa.list_(pa.int32())), _lists(docs, [len(docs)], pa.int64())], names
            )

        for batch in bounded(batches, "text"):
            parts = [al.ids(t) or (NONE, NONE) for t in batch.column("text").to_pylist()]
            m, texts, (text, codes, times) = align_batch(al, parts)
            sizes = np.bincount(text, minlength=len(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(parts), task << 32 | block)), *[pa.array(m[c]) for c in MEASURES], pa.array([sha(t) for t in texts], pa.string()), pa.array(texts if groups else [None] * len(texts), pa.string()), _lists(codes, sizes, number), _lists(times, sizes, pa.int32()), pa.nulls(len(parts), pa.list_(pa.int64()))],
                names,
            )
            held.append(codes)
            size += len(codes)
            if size >= ENTRIES:
                yield of_block()
                block, held, size = block + 1, [], 0
        if size:
            yield of_block()

    fields = f"doc_id long, block long, {', '.join(f'{c} long' for c in MEASURES)}, groups_sha256 string, groups string, codes array<{kind}>, times array<int>, docs array<long>"
    return docs.mapInArrow(run, fields)


FRAGMENT = "row long, place long, closed int, cut int, ok int, pa binary, pb binary, sa binary, sb binary"


def _row(row: int, place: int, is_closed: int, cut: int, ok: int, prefix: Ids, suffix: Ids = (NONE, NONE)) -> tuple:
    return (row, place, is_closed, cut, ok, *(x.astype("<u4").tobytes() for x in (*prefix, *suffix)))


def _columns(rows: list[tuple]) -> dict[str, np.ndarray]:
    out = {}
    for name, values in zip((c.split()[0] for c in FRAGMENT.split(", ")), zip(*rows, strict=True), strict=True):
        out[name] = np.empty(len(values), object) if isinstance(values[0], bytes) else np.array(values, np.int64)
        out[name][:] = values
    return out


def _fragments(parts: DataFrame, make: Callable[[], Aligner]) -> DataFrame:
    """Of parts(row, idx, text): the fragment of each (place: idx) and its closed groups (place: 2 idx + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = make()
        for batch in batches:
            for row, idx, text in zip(*(batch.column(c).to_pylist() for c in ("row", "idx", "text")), strict=True):
                ids = al.ids(text)
                a, b = ids or (NONE, NONE)
                f, middle = fragment(a, b, ends(a, al.x), ends(b, al.y))
                rows = [_row(row, idx, 0, f.cut, ids is not None, f.prefix, f.suffix)]
                if len(middle[0]):
                    rows.append(_row(row, 2 * idx + 1, 1, 0, 1, middle))
                cols = _columns(rows)
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32) if c in ("closed", "cut", "ok") else v) for c, v in cols.items()], list(cols))

    return parts.mapInArrow(run, FRAGMENT)


def _compose(fragments: DataFrame, step: int) -> DataFrame:
    """Fragments whose place // step is equal, composed in order; the groups that they close are rows (place: 2 idx of what comes after)."""

    def make() -> Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]:
        ids = lambda x: np.frombuffer(x, "<u4").astype(np.int64)

        def f(group: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            order = np.argsort(group["place"])
            read = lambda k: Fragment(bool(group["cut"][k]), (ids(group["pa"][k]), ids(group["pb"][k])), (ids(group["sa"][k]), ids(group["sb"][k])))
            row, now, out = int(group["row"][0]), read(order[0]), []
            for k in order[1:]:
                now, made = composed(now, read(k))
                if made is not None:
                    out.append(_row(row, 2 * int(group["place"][k]), 1, 0, 1, made))
            return _columns([_row(row, int(group["place"][order[0]]), 0, now.cut, int(group["ok"].min()), now.prefix, now.suffix), *out])

        return f

    keyed = fragments.withColumn("key", F.floor(F.col("place") / step).cast("long"))
    return by_runs(keyed, ["row", "key"], make, FRAGMENT)


def _long(docs: DataFrame, make: Callable[[], Aligner], kind: str, groups: bool, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows of long documents (row, doc_id, measures, groups), and their distinct pairs (row, code, times)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                for idx, part in enumerate(ranges(text, chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([doc], pa.int64()), pa.array([idx]), pa.array([part])], ["row", "doc_id", "idx", "text"])

    rows = docs.withColumn("row", F.monotonically_increasing_id())
    parts = stored(rows.mapInArrow(cut, "row long, doc_id long, idx long, text string"), "ranges")  # stored, so that rows are numbered once
    level = stored(_fragments(parts.repartition("row", "idx"), make), "fragments")
    done, top, step = [level.where("closed = 1")], level.where("closed = 0"), 1
    most = parts.agg(F.max("idx")).first()[0] or 0
    while step <= most:
        step *= FAN
        level = stored(_compose(top, step), "composed")
        done.append(level.where("closed = 1"))
        top = level.where("closed = 0")
    all_closed = top.withColumn("place", F.lit(0).cast("long"))  # the root's prefix is the first group, and it has no suffix
    for rows in done:
        all_closed = all_closed.unionByName(rows)
    bad = top.where("ok = 0").select("row")
    summed = stored(_summaries(all_closed.join(bad, "row", "left_anti"), make, kind), "closed")
    pairs = summed.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).groupBy("row", F.col("x.codes").alias("code")).agg(F.sum("x.times").alias("times"))
    names = parts.where("idx = 0").select("row", "doc_id")
    return names.join(_digests(summed, groups), "row", "left"), pairs


def _summaries(rows: DataFrame, make: Callable[[], Aligner], kind: str) -> DataFrame:
    """Measures, text and pairs of closed groups."""
    number = pa.int32() if kind == "int" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = make()
        for batch in bounded(batches, "pa"):
            ids = [[np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(c).to_pylist()] for c in ("pa", "pb")]
            m, texts, (text, codes, times) = align_batch(al, list(zip(*ids, strict=True)))
            sizes = np.bincount(text, minlength=batch.num_rows)
            arrays = [batch.column("row"), batch.column("place"), *[pa.array(m[c]) for c in MEASURES], pa.array(texts, pa.string()), _lists(codes, sizes, number), _lists(times, sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "place", *MEASURES, "groups", "codes", "times"])

    return rows.select("row", "place", "pa", "pb").mapInArrow(run, f"row long, place long, {', '.join(f'{c} long' for c in MEASURES)}, groups string, codes array<{kind}>, times array<int>")


def _digests(summed: DataFrame, groups: bool) -> DataFrame:
    """Measures and digest of each long document. A digest takes its text in order: one task reads a document's closed rows one
    after the other, holding none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, digest, texts, sums = None, None, [], np.zeros(4, np.int64)

        def out() -> pa.RecordBatch:
            arrays = [pa.array([row]), *[pa.array([s]) for s in sums], pa.array([digest.hexdigest()]), pa.array([";".join(texts) if groups else None], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, ["row", *MEASURES, "groups_sha256", "groups"])

        for batch in batches:
            for r, text, *m in zip(*(batch.column(c).to_pylist() for c in ("row", "groups", *MEASURES)), strict=True):
                if r != row:
                    if row is not None:
                        yield out()
                    row, digest, texts, sums = r, hashlib.sha256(), [], np.zeros(4, np.int64)
                    digest.update(text.encode())
                else:
                    digest.update(b";" + text.encode())
                sums += m
                if groups:
                    texts.append(text)
        if row is not None:
            yield out()

    rows = summed.where("n_a > 0").select("row", "place", "groups", *MEASURES).repartition("row").sortWithinPartitions("row", "place")
    return rows.mapInArrow(run, f"row long, {', '.join(f'{c} long' for c in MEASURES)}, groups_sha256 string, groups string")


def _with_counts(rows: DataFrame, blocks: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """Documents of blocks with n_best and count_sum. A block's counts come first in their task, then its documents."""
    asked = blocks.select("block", F.explode("codes").alias("code")).join(counts, "code")
    shown = ["doc_id", *MEASURES, "groups_sha256", "groups", "codes", "times"]
    null = [F.lit(None).cast(t).alias(c) for c, t in zip(shown, ["long"] * 5 + ["string"] * 2 + [f"array<{kind}>", "array<int>"], strict=True)]
    both = asked.select("block", F.lit(0).alias("second"), "code", "n", "best", *null).unionByName(rows.select("block", F.lit(1).alias("second"), F.lit(0).cast(kind).alias("code"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("best"), *shown))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        code = n = best = NONE
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks_, second = batch.column("block").to_numpy(), batch.column("second").to_numpy()
            edges = [0, *(np.flatnonzero((blocks_[1:] != blocks_[:-1]) | (second[1:] != second[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if blocks_[a] != block:
                    block, held, code = blocks_[a], [], None
                if second[a] == 0:
                    held.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n", "best")])
                    continue
                if code is None:
                    code, n, best = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (NONE, NONE, NONE.astype(bool))
                    held = []
                codes, times = part.column("codes"), part.column("times").flatten().to_numpy()
                at = np.searchsorted(code, codes.flatten().to_numpy())
                doc = np.repeat(np.arange(len(part)), np.diff(codes.offsets.to_numpy()))
                total = lambda x: pa.array(np.bincount(doc, x, len(part)).astype(np.int64))  # noqa: B023, E731
                exact = np.zeros(len(part), np.int64)
                np.add.at(exact, doc, n[at] * times)
                out = [part.column(c) for c in shown[:-2]] + [total(times * best[at]), pa.array(exact)]
                yield pa.RecordBatch.from_arrays(out, [*shown[:-2], "n_best", "count_sum"])

    fields = f"doc_id long, {', '.join(f'{c} long' for c in MEASURES)}, groups_sha256 string, groups string, n_best long, count_sum long"
    return both.repartition("block").sortWithinPartitions("block", "second", "code").mapInArrow(run, fields)


def token_alignment(docs: DataFrame, json_path: str, ranks_path: str, model: str, groups: bool = False, long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of docs(doc_id, text), and the groups themselves if
    asked for, as `a1,a2|b1;a3|b2,b3`. a: a byte-level vocabulary as JSON and as ranks; b: a SentencePiece merge model."""
    make = lambda: aligner(json_path, ranks_path, model)
    al = make()
    kind = "int" if len(al.x.raw) * al.width < 2**31 else "long"
    docs, width = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), al.width
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long
    rows = stored(_whole(docs.where(~is_long), make, kind, groups), "aligned")
    blocks = rows.where("docs is not null")
    of_long, pairs = _long(docs.where(is_long), make, kind, groups, chunk)
    pairs = stored(pairs, "pairs")
    seen = blocks.select(F.explode(F.arrays_zip("codes", "docs")).alias("x")).select(F.col("x.codes").alias("code"), F.col("x.docs").alias("n")).unionByName(pairs.select("code", F.lit(1).cast("long").alias("n")))
    n = seen.groupBy("code").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("code") / width).cast("int"))
    n = stored(n, "pair-counts")
    top = n.groupBy("a").agg(F.max("n").alias("top"))  # no more rows than ids
    counts = n.join(F.broadcast(top), "a").select("code", "n", (F.col("n") == F.col("top")).alias("best"))
    whole = _with_counts(rows.where("docs is null"), blocks, counts, kind)
    sums = pairs.join(counts, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda *names: [F.coalesce(c, F.lit(0)).alias(c) for c in names]
    shown = ["doc_id", *MEASURES, "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else [])]
    out = of_long.join(sums, "row", "left").select("doc_id", *zero(*MEASURES, "n_best", "count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"), F.coalesce("groups", F.lit("")).alias("groups"))
    return whole.select(shown).unionByName(out.select(shown))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), public_path("byte_bpe_50k.tiktoken"), public_path("piece_bpe_32k.model"))
