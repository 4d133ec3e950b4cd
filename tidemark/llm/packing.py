"""Packing by order-preserving dynamic programming.

The documents, in the order of doc_id, are one stream of token ids; it is cut into sequences of at most `width` ids, each
of which may be padded. Cuts stand at document ends (free) or sentence ends (PENALTY ids: the document is cut). Only where
neither comes for more than LONG ids may a cut stand within a sentence, at every STRIDE-th id of it, at the price of HARD
ids. With f(j) the least padding plus penalties up to cut j,

    f(j) = min over cuts i with pos(j) - pos(i) <= width of  f(i) + width - (pos(j) - pos(i)) + penalty(j),

and g(i) = f(i) + pos(i) turns the minimum into one over a sliding window, which a monotone queue gives in constant time.

Each task packs its own range of doc_id, BLOCK ids at a time, and carries the last, unfinished sequence over to the next
block; memory doesn't grow with a task's input. Only each task's number of sequences is gathered, to number them all.

Edge cases: null and empty texts are the end id alone; documents with equal or null doc_id are packed one after another,
in the order of a hash of their texts; an empty table gives an empty result; other columns are ignored. A task's last
sequence may be short."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.ranges import in_order, with_base
from tidemark.llm.tokens import byte_level_encoder, json_tokenizer, public_path

WIDTH = 1024
#: On sf0.01 these leave 0.9 % padding and 20 % of the cuts within (long) sentences; HARD, LONG = 64, 64 leave 1.6 % and 7 %.
PENALTY, HARD, STRIDE = 1, 40, 8
#: A run of more ids without an end of a sentence or document may be cut.
LONG = 32
BLOCK = 1 << 20
END = 0
# Characters that end a sentence.
ENDS = ".!?。！？\n"


def cuts(pos: list[int], penalty: list[int], width: int) -> list[int]:
    """Indexes of the chosen cuts, the last included. pos[0] is 0; neighbours are at most width apart."""
    g, back, queue = [0] * len(pos), [0] * len(pos), deque([0])
    for j in range(1, len(pos)):
        low = pos[j] - width
        while pos[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        g[j] = v = g[i] + width + penalty[j]
        while queue and g[queue[-1]] > v:
            queue.pop()
        queue.append(j)
    out, j = [], len(pos) - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, width: int) -> tuple[list[int], list[int]]:
    """Places where the stream may be cut and what a cut costs there. ends: where documents end."""
    soft = np.flatnonzero(sentence_end[ids]) + 1
    pos = np.unique(np.concatenate([[0, len(ids)], soft, ends]))
    gaps = np.flatnonzero(np.diff(pos) > min(LONG, width))
    step = min(STRIDE, width)
    hard = np.concatenate([np.empty(0, np.int64), *(np.arange(pos[k] + step, pos[k + 1], step) for k in gaps)])
    cost = np.full(len(pos), PENALTY)
    cost[np.searchsorted(pos, ends)] = 0
    order = np.argsort(np.concatenate([pos, hard]), kind="stable")
    return np.concatenate([pos, hard])[order].tolist(), np.concatenate([cost, np.full(len(hard), HARD)])[order].tolist()


def packed(documents: Iterator[tuple[int | None, np.ndarray]], sentence_end: np.ndarray, width: int, block: int) -> Iterator[tuple]:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence, offset) of documents (doc_id, ids)."""
    held: list[tuple[int | None, np.ndarray, int, int]] = []  # doc_id, ids not yet emitted, ids before them, all ids
    size, sequence = 0, 0

    def flush(last: bool) -> Iterator[tuple]:
        nonlocal held, size, sequence
        ids = np.concatenate([x[1] for x in held])
        ends = np.cumsum([len(x[1]) for x in held])
        pos, penalty = candidates(ids, ends, sentence_end, width)
        chosen = [pos[k] for k in cuts(pos, penalty, width)]
        if not last:
            chosen.pop()
        k, at = 0, 0  # document and what of it is emitted
        begin = 0
        for stop in chosen:
            offset = 0
            while begin + offset < stop:
                doc, own, before, total = held[k]
                n = min(len(own) - at, stop - begin - offset)
                yield doc, before + at, n, zlib.crc32(own[at : at + n].astype("<u4").tobytes()), total, sequence, offset
                offset, at = offset + n, at + n
                if at == len(own):
                    k, at = k + 1, 0
            sequence, begin = sequence + 1, stop
        held = [(d, own[at:], before + at, total) if i == 0 else (d, own, before, total) for i, (d, own, before, total) in enumerate(held[k:])]
        size = sum(len(x[1]) for x in held)

    for doc, ids in documents:
        held.append((doc, ids, 0, len(ids)))
        size += len(ids)
        if size >= block:
            yield from flush(False)
    if held:
        yield from flush(True)


def sentence_ends(tokenizer: str) -> np.ndarray:
    """For each id, whether a sentence ends with it."""
    tok = json_tokenizer(tokenizer)
    out = np.zeros(tok.get_vocab_size(), bool)
    for i in range(len(out)):
        shown = tok.decode([i], skip_special_tokens=False)
        out[i] = shown != "" and shown[-1] in ENDS
    return out


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], tokenizer: str, width: int = WIDTH, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: the pieces of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, close = encoder(), TaskContext.get().partitionId(), np.array([end], np.uint32)

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    yield doc, np.concatenate([encode(text).astype(np.uint32), close]) if text else close

        rows: list[tuple] = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"]

        def batch_out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([part] * len(rows), pa.int32())], names=[*names, "part"])

        for row in packed(documents(), sentence_ends(tokenizer), width, BLOCK):
            rows.append(row)
            if len(rows) == 20_000:
                yield batch_out()
                rows.clear()
        yield batch_out()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long, part int"
    pieces = stored(in_order(docs).mapInArrow(run, schema), "pieces").withColumn("first", (F.col("offset") == 0).cast("long"))
    return with_base(pieces, "first", "base").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("sequence")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame) -> DataFrame:
    tokenizer, ranks = public_path("byte_bpe_50k.json"), public_path("byte_bpe_50k.tiktoken")
    return pack(docs, lambda: byte_level_encoder(tokenizer, ranks), tokenizer)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
