"""What the operators share: reading tables, the shared folder, cutting lineage, Arrow batches, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Texts that a task holds as Python strings at once.
ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only a session on one machine (tests)
    may do without: a new folder is made and set then. On a cluster a missing setting is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors and gives
    later joins a scan of their own, so that both sides have an exchange whose hot partitions AQE can split."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without its columns of these names, in any case of letters: Spark tells names apart by that only if asked to."""
    taken = {n.lower() for n in names}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def per_text(df: DataFrame, make: Callable[[], Callable[[list[str | None]], dict[str, object]]], new: str, text: str = "text", drop_text: bool = False) -> DataFrame:
    """df's columns, then the columns `new` (as DDL): make() is called once a task and gives the function from a batch's
    texts to the new columns. Columns of df stay Arrow arrays and never become pandas ones, so that a null beside them
    rounds no 64-bit id. A column of df named like a new one is replaced."""
    added = StructType.fromDDL(new)
    left = without(df, added.names)
    keep = [c for c in left.columns if not (drop_text and c == text)]
    schema = StructType([*(left.schema[c] for c in keep), *added])
    kinds = _arrow(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                got = f(batch.column(text).to_pylist())
                arrays = [batch.column(c) for c in keep] + [x if isinstance(x := got[n], pa.Array) else pa.array(x, kinds.field(n).type) for n in added.names]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *added.names])

    return left.mapInArrow(run, schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _plain(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return column.to_numpy(zero_copy_only=False)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def by_runs(rows: DataFrame, keys: list[str], make: Callable[[], Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None]], new: str) -> DataFrame:
    """Rows are dealt out by `keys` (integers without nulls) and sorted by them; make()'s function gets the columns of one
    group after the other. For many small groups that share a task; a group has to be of bounded size. The number of
    partitions is fixed, since small rows can carry much work and shouldn't be merged into a few tasks."""
    names, added = rows.columns, StructType.fromDDL(new)
    kinds = _arrow(added)
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, held, last = make(), [], None
        out: list[dict[str, np.ndarray]] = []

        def finish() -> None:
            if held:
                group = held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in names}
                held.clear()
                if (got := f(group)) is not None:
                    out.append(got)

        def batch_out() -> pa.RecordBatch:
            arrays = [pa.array(np.concatenate([o[n] for o in out]), kinds.field(n).type) for n in added.names]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=added.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: _plain(batch.column(c)) for c in names}
            k = np.stack([cols[c].astype(np.int64) for c in keys])
            edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                here = tuple(k[:, a].tolist())
                if here != last:
                    finish()
                    last = here
                held.append({c: v[a:b] for c, v in cols.items()})
            if out:
                yield batch_out()
        finish()
        if out:
            yield batch_out()

    return dealt.mapInArrow(run, added)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, kept for short words seen before, at most `most` of them."""

    LONG = 64

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONG:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_S32, _S29 = np.uint64(32), np.uint64(29)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every window of `width` words; empty if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, width):
        out *= _MUL
        out ^= out >> _S29
        out += hashes[i : i + n]
    out ^= out >> _S32
    out *= _MIX
    out ^= out >> _S29
    return out
