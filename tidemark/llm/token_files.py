"""Token-id files with fixed-width bit packing.

Each id takes the fewest bits that hold the vocabulary. A file has, little-endian:

    8 bytes   magic
    5 x u64   bits, ids in a block, ids, blocks, documents
    u64[blocks + 1]      byte offset of each block from the payload's start, and its end
    i64[documents]       doc_id           u8[documents]  1 if doc_id is null
    u64[documents + 1]   first id of each document in this file, and the number of ids
    payload              blocks; the k-th id of a block takes the bits from k * bits on, lowest bit first

Block offsets give random access; a block is unpacked with numpy in one go.

The documents, in ascending doc_id order, are cut over tasks by ranges of doc_id. A task writes files of about SHARD ids
under names that depend on its number only, each first under another name and then moved, so a repeated task replaces
its files by equal ones; an attempt that fails removes what it began. The manifest of finished files is a Spark table; files that it doesn't name are never read.

Edge cases: null and empty texts are the end id alone; rows with equal or null doc_id follow one another in the order of
a hash of their texts (nulls first); an empty table gives an empty manifest; an id that the bits can't hold is an error;
other columns are ignored."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, stored, table
from tidemark.llm.ranges import in_order, with_base
from tidemark.llm.tokens import json_tokenizer, public_path, word_encoder

MAGIC = b"TIDEIDS1"
HEAD = struct.Struct("<8s5Q")
BLOCK = 4096
SHARD = 1 << 22
END = 1


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} doesn't fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(np.pad(each, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    """A file's content."""
    stream = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    blocks = [pack_bits(stream[i : i + block], bits) for i in range(0, len(stream), block)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    starts = np.cumsum([0, *map(len, ids)], dtype="<u8")
    named = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = HEAD.pack(MAGIC, bits, block, len(stream), len(blocks), len(doc_ids))
    return b"".join([head, offsets.tobytes(), named.tobytes(), null.tobytes(), starts.tobytes(), *blocks])


class TokenFile:
    """Reads a file's content."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.n_ids, blocks, docs = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.offsets, self.doc_ids, self.null = take("<u8", blocks + 1), take("<i8", docs), take("u1", docs)
        self.starts = take("<u8", docs + 1)
        self.payload = memoryview(data)[at:]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from `start` on; only the blocks that hold them are unpacked."""
        if not n:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        parts = [unpack_bits(self.payload[int(self.offsets[k]) : int(self.offsets[k + 1])], min(self.block, self.n_ids - k * self.block), self.bits) for k in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block :][:n]


def _store(uri: str):
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], vocabulary: int, folder: str, end: int = END, shard: int = SHARD) -> DataFrame:
    """Write docs(doc_id, text) and return the manifest: part, file, name, n_ids, n_docs."""
    bits = bits_for(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, close = encoder(), TaskContext.get().partitionId(), np.array([end], np.uint32)
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size, k = 0, 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{k:05d}.bin"
            early = f"{root}/{name}.{uuid.uuid4().hex}"
            try:
                with store.open_output_stream(early) as f:
                    f.write(file_bytes(names, held, bits))
                store.move(early, f"{root}/{name}")
            except BaseException:
                if store.get_file_info(early).type != fs.FileType.NotFound:
                    store.delete_file(early)
                raise
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([k], pa.int32()), "name": [name], "n_ids": [size], "n_docs": [len(names)]})

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text), close) if text else close
                names.append(doc)
                held.append(ids)
                size += len(ids)
                if size >= shard:
                    yield flush()
                    names.clear()
                    held.clear()
                    size, k = 0, k + 1
        if names:
            yield flush()

    return stored(in_order(docs).mapInArrow(run, "part int, file int, name string, n_ids long, n_docs long"), "manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files that the manifest names."""
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = with_base(manifest, "n_ids", "base").withColumn("base", F.col("base") + F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    file = TokenFile(f.read())
                stream = file.ids(0, file.n_ids).astype("<u4")
                starts = file.starts.astype(np.int64)
                crc = [zlib.crc32(stream[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                doc_ids = pa.array(file.doc_ids, pa.int64(), mask=file.null.astype(bool))
                yield pa.RecordBatch.from_pydict({"doc_id": doc_ids, "start": base + starts[:-1], "n_tokens": np.diff(starts), "ids_crc32": crc})

    # a task for each file: the rows are tiny, the work isn't
    files = files.select("name", "base").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, folder = public_path("word_bpe_49k.json"), scratch(spark, "token-files")

    def encoder() -> Callable[[str], np.ndarray]:
        words = word_encoder(path)
        return lambda text: np.frombuffer(words.encode(text), words.dtype).astype(np.uint32)

    manifest = write_token_files(table(spark, sf_dir, "documents"), encoder, json_tokenizer(path).get_vocab_size(), folder)
    return read_token_files(manifest, folder)
