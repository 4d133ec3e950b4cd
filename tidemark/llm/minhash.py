"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation on full
shingle sets, connected components by alternating large-star and small-star.

Two documents are linked if the Jaccard similarity of their sets of k-word shingles is at least `similarity`
per cent. Words are runs of non-white-space bytes after lower-casing A-Z.

How a large group stays cheap without losing links
* Documents with equal shingle sets share one node (the 64-bit digest of the set), so exact copies never
  meet in pairs. Buckets with equal nodes are looked at once.
* First each node of a band bucket is compared with the bucket's smallest node only (a star). A group of n near copies
  costs n comparisons and is then, as a rule, one component and a few loose nodes.
* Then the buckets that still hold two or more components are looked at, and only pairs of nodes of different
  components: the nodes of a bucket's largest component meet the others in cells of bounded size. So a bucket of n nodes,
  l of them outside its largest component, sends about n + l * n / BLOCK rows, not n * n / BLOCK. Signatures are compared
  within a cell, and what a cell sends on are its nodes that may still be linked, each with the smallest component that it
  hangs together with there: no pairs, and the same rows from each bucket. Components that hang together by these
  form a family; every pair in question lies within one.
* Families are compared exactly on full sets, in cells likewise, each sending on a spanning forest of the components that
  it links. No bucket, partner or candidate is capped.
Where no component is large (n nodes share most bands, but no two are linked), cells do grow with n * n / BLOCK: all those
pairs have to be compared.

With 56 bands of 6 rows a pair at exactly 0.8 is missed with probability (1 - 0.8^6)^56 < 5e-8.

Edge cases: null or wordless text has an empty set, is linked with nothing and stays; a text with fewer than
k words has its whole sequence as its only shingle; rows with equal sets fall into one component; each row is judged by
its own text, whatever its doc_id, so rows that repeat a doc_id with other texts may lie in other components; a null
doc_id links like any other, gets the smallest id of its component (null if none has one) and is kept only in the latter
case; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WordHashes, by_runs, per_text, stored, table, windows

BANDS, ROWS = 56, 6
#: Shingles whose hashes are taken at once.
CHUNK = 8192
#: Nodes in a cell's side when signatures, and when full sets are compared; and shingles in the latter.
BLOCK, FAMILY, FULL = 1024, 256, 1 << 20
#: Shingles of full sets that a task keeps.
KEPT = 1 << 22
#: An estimate from 336 minima has a standard deviation of about 0.022 at 0.8; pairs more than five of them below go.
SLACK = 0.11


@lru_cache(1)
def _family() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and addends of the hashes, and of the fold of a band into a key."""
    rng = np.random.default_rng(20240229)
    draw = lambda: rng.integers(0, np.iinfo(np.uint64).max, BANDS * ROWS, dtype=np.uint64, endpoint=True)
    return draw() | np.uint64(1), draw(), draw(), draw() | np.uint64(1)


def shingles(text: str | None, width: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = memo.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    if 0 < len(words) < width:
        return windows(np.append(words, np.uint64(len(words))), len(words) + 1)
    return np.unique(windows(words, width))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The signatures, one row a set: for each hash of the family the smallest value over the set, as 32 bits.

    The hashes are multiply-add-shift: (a * x + b mod 2**64) >> 32 for 32-bit keys x, which is strongly universal. The
    smallest product has the smallest upper half, so the shift comes after the minimum. Hash by hash over many sets, so that
    the arrays are long; a set of any size goes through in parts."""
    a, b, _, _ = _family()
    low = np.full((len(sets), len(a)), np.iinfo(np.uint64).max, np.uint64)
    parts = [(k, s[i : i + CHUNK]) for k, s in enumerate(sets) for i in range(0, len(s), CHUNK)]
    at = 0
    while at < len(parts):
        end, size = at + 1, len(parts[at][1])
        while end < len(parts) and size + len(parts[end][1]) <= CHUNK:
            size += len(parts[end][1])
            end += 1
        own = parts[at:end]
        keys = np.concatenate([s for _, s in own]) >> np.uint64(32)
        starts = np.cumsum([0, *(len(s) for _, s in own[:-1])])
        room, found = np.empty(size, np.uint64), np.empty((len(a), len(own)), np.uint64)
        for j in range(len(a)):
            np.multiply(keys, a[j], out=room)
            np.add(room, b[j], out=room)
            np.minimum.reduceat(room, starts, out=found[j])
        of = [k for k, _ in own]  # parts of one set are full, so they never share a chunk
        low[of] = np.minimum(low[of], found.T)
        at = end
    return (low >> np.uint64(32)).astype(np.uint32)


def bands(signatures: np.ndarray) -> np.ndarray:
    """For each signature one 64-bit key a band, different between bands."""
    _, _, b, c = _family()
    rows = (signatures.astype(np.uint64) + b) * c
    rows ^= rows >> np.uint64(31)
    key = rows.reshape(-1, BANDS, ROWS).sum(axis=2, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def _digest(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def text_digest(text: str = "text") -> list[Column]:
    """t1, t2: together 128 bits that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), F.col(text), F.octet_length(text)).alias("t2")]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, t1, t2, n_shingles, node (digest of the set, null if empty), keys (of the bands), sig (a byte of each minimum)."""

    def make() -> Callable[[list[str | None]], dict[str, object]]:
        memo = WordHashes()

        def f(texts: list[str | None]) -> dict[str, object]:
            size, node, keys, sig = [], [], [], []
            for i in range(0, len(texts), 256):
                sets = [shingles(t, width, memo) for t in texts[i : i + 256]]
                low = minima(sets)
                size += map(len, sets)
                node += [_digest(s) if len(s) else None for s in sets]
                keys.append(bands(low))
                sig += [row.tobytes() for row in low.astype(np.uint8)]
            flat = np.concatenate(keys) if keys else np.empty((0, BANDS), np.int64)
            offsets = np.arange(len(flat) + 1, dtype=np.int32) * BANDS
            return {"n_shingles": size, "node": node, "keys": pa.ListArray.from_arrays(offsets, flat.ravel()), "sig": sig}

        return f

    return per_text(docs.select("doc_id", *text_digest(), "text"), make, "n_shingles long, node long, keys array<long>, sig binary", drop_text=True)


def _with_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows joined with groups, an aggregate by the long `key`. Joining on the complement of the key keeps Spark from
    reusing the aggregate's partitioning: both sides have an exchange of their own, whose hot partitions AQE splits."""
    other = groups.withColumn("_key", F.bitwise_not(key)).drop(key)
    return rows.withColumn("_key", F.bitwise_not(key)).join(other, "_key").drop("_key")


def _stars(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u > v, are stars: each u has one v and is the v of none."""
    ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))
    found = ends.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.max(F.col("v").isNull()).alias("below"))
    return found.where("a < b or a is not null and below").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for each node with an edge, root being the smallest node reachable; a table of (u, v) long in, u != v.

    Alternates large-star and small-star until the edges are stars. Hot nodes: minima are partial aggregates, and
    the joins back have an exchange on both sides, so AQE splits them."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stored(_with_groups(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_groups(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
    return now.select("u", F.col("v").alias("root")).distinct()


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima of each row of a with each row of b."""
    return (a[:, None] == b[None]).mean(axis=2, dtype=np.float32)


def _similar(a: np.ndarray, others: list[np.ndarray], similarity: int) -> np.ndarray:
    """Whether the sorted set a is as similar to each of the others."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.searchsorted(a, flat)
    at[at == len(a)] = 0
    same = np.add.reduceat((a[at] == flat).astype(np.int64), np.cumsum([0, *sizes[:-1]]))
    return 100 * same >= similarity * (len(a) + sizes - same)


class Sets(dict):
    """Full sets of nodes, kept while they hold few shingles in all."""

    def __init__(self, width: int):
        super().__init__()
        self.width, self.memo, self.held = width, WordHashes(), 0

    def of(self, node: int, text: str) -> np.ndarray:
        got = self.get(node)
        if got is None:
            got = shingles(text, self.width, self.memo)
            if self.held + len(got) > KEPT:
                self.clear()
                self.held = 0
            self[node] = got
            self.held += len(got)
        return got


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """Those of the pairs (u, v) whose signatures allow it and whose full sets reach the similarity."""
    limit = similarity / 100 - SLACK

    def run(batches):
        sets = Sets(width)
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("u", "v", "su", "sv", "tu", "tv")}
            keep = []
            for u, v, su, sv, tu, tv in zip(*c.values(), strict=True):
                ok = (np.frombuffer(su, np.uint8) == np.frombuffer(sv, np.uint8)).mean() >= limit
                keep.append(bool(ok and _similar(sets.of(v, tv), [sets.of(u, tu)], similarity)[0]))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: texts.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}"), F.col("text").alias(f"t{x}")).hint("merge")
    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(run, "u long, v long")


class Joined(dict):
    """Union-find over what it has seen."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        """False if they were together already."""
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _cells(rows: DataFrame, key: str, nodes: int, shingles_: int | None = None) -> DataFrame:
    """rows(key, node, root, size) of the groups that hold more than one root, with r, c, side: all nodes of different roots
    of a group meet in a cell (key, r, c), one as its row (side 0 or 2), the other as its column (side 1 or 2).

    The nodes of a group's most frequent root are columns in blocks of about `nodes` nodes and `shingles_` shingles; all
    others are rows in such blocks, and columns besides. A group that fits one block is one cell."""
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(F.col(n) / nodes), *([F.ceil(F.col(w) / shingles_)] if shingles_ else []))
    per_root = rows.groupBy(key, "root").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    per = per_root.groupBy(key).agg(F.max(F.struct("n", "root", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("roots"))
    per = per.where("roots > 1 and n > 2").select(key, F.col("top.root").alias("top"), F.col("top.n").alias("nb"), F.col("top.w").alias("wb"), (F.col("n") - F.col("top.n")).alias("nl"), (F.col("w") - F.col("top.w")).alias("wl"), "n", "w")
    per = per.select(key, "top", blocks("nb", "wb").alias("b"), blocks("nl", "wl").alias("l"), (blocks("n", "w") == 1).alias("one"))
    cell = "named_struct('r', cast({} as bigint), 'c', cast({} as bigint), 'side', {})"
    of_top = f"transform(sequence(0, l - 1), x -> {cell.format('x', 'i', 1)})"
    loose = ", ".join([
        f"transform(sequence(0, b - 1), x -> {cell.format('i', 'x', 0)})",
        f"transform(sequence(i, l - 1), x -> {cell.format('i', 'b + x', 'if(x = i, 2, 0)')})",
        f"transform(slice(sequence(0, l), 1, cast(i as int)), x -> {cell.format('x', 'b + i', 1)})",
    ])
    out = _with_groups(rows, per, key).withColumn("i", F.pmod(F.xxhash64("node"), F.when(F.col("root") == F.col("top"), F.col("b")).otherwise(F.col("l"))))
    out = out.withColumn("x", F.explode(F.expr(f"case when one then array({cell.format(0, 0, 2)}) when root = top then {of_top} else concat({loose}) end")))
    return out.select(key, "node", "root", "size", "x.r", "x.c", "x.side")


def _sides(g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a cell's rows and columns, and its signatures."""
    return np.flatnonzero(g["side"] != 1), np.flatnonzero(g["side"] != 0), np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(len(g["sig"]), -1)


def _may_link(rows: np.ndarray, cols: np.ndarray, sig: np.ndarray, root: np.ndarray, limit: float):
    """A few rows at a time: the places of rows and columns whose roots differ and whose signatures allow a link."""
    step = max(1, 12_000 // len(cols))
    b, rb = sig[cols], root[cols]
    for i in range(0, len(rows), step):
        own = rows[i : i + step]
        r, c = np.nonzero((_estimates(sig[own], b) >= limit) & (root[own][:, None] != rb[None]))
        yield own[r], cols[c]


def _loose(named: DataFrame, sigs: DataFrame, similarity: int) -> DataFrame:
    """(node, root, size, to): in each bucket of named(key, node, root, size), the nodes that may be linked with one of another
    root, and the smallest root that theirs hangs together with in a cell."""
    limit = similarity / 100 - SLACK

    def make():
        def f(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
            rows, cols, sig = _sides(g)
            root, seen, together = g["root"], np.zeros(len(g["node"]), bool), Joined()
            for r, c in _may_link(rows, cols, sig, root, limit):
                if len(r):
                    seen[r] = seen[c] = True
                    for a, b in np.unique(np.stack([root[r], root[c]]), axis=1).T.tolist():
                        together.join(a, b)
            if not seen.any():
                return None
            own = root[seen]
            return {"node": g["node"][seen], "root": own, "size": g["size"][seen], "to": np.array([together.find(x) for x in own.tolist()], np.int64)}

        return f

    cells = _cells(named, "key", BLOCK).join(sigs.hint("merge"), "node")
    return by_runs(cells, ["key", "r", "c"], make, "node long, root long, size long, to long")


def _links(families: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """(u, v): roots that links within families(family, node, root, size) join, a spanning forest of each cell."""
    limit = similarity / 100 - SLACK

    def make():
        sets = Sets(width)

        def f(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
            rows, cols, sig = _sides(g)
            root, node, text, together, out = g["root"], g["node"], g["text"], Joined(), []
            full = lambda k: sets.of(int(node[k]), text[k])
            for r, c in _may_link(rows, cols, sig, root, limit):
                edges = np.append(np.flatnonzero(np.diff(r, prepend=-1)), len(r)) if len(r) else [0]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    own, mine, others = full(r[a]), int(root[r[a]]), c[a:b]
                    for i in range(0, len(others), 64):
                        some = [k for k in others[i : i + 64] if together.find(mine) != together.find(int(root[k]))]
                        if some:
                            ok = _similar(own, [full(k) for k in some], similarity)
                            out += [(mine, int(root[k])) for k, linked in zip(some, ok, strict=True) if linked and together.join(mine, int(root[k]))]
            return {"u": np.array([x for x, _ in out], np.int64), "v": np.array([x for _, x in out], np.int64)} if out else None

        return f

    cells = _cells(families, "family", FAMILY, FULL).join(texts.hint("merge"), "node")
    return by_runs(cells, ["family", "r", "c"], make, "u long, v long")


def classified(docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """doc_id, t1, t2 (of the text), n_shingles, root for every row of docs(doc_id, text); root is null for empty sets."""
    sketched = stored(sketches(docs, width), "sketches")
    filled = sketched.where("node is not null")
    uniq = stored(filled.groupBy("node").agg(F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"), F.min(F.struct("t1", "t2")).alias("t")), "nodes")
    keyed = uniq.select("node", "size", F.explode("keys").alias("key"))
    same = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]  # of a bucket's nodes
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub"), *same).where("n > 1")
    buckets = stored(buckets.groupBy("n", "x", "y").agg(F.min(F.struct("key", "hub")).alias("b")).select("b.key", "b.hub"), "buckets")
    members = stored(keyed.join(buckets.hint("merge"), "key"), "members")

    # one text for each node that shares a bucket; by the text itself, as rows may repeat a doc_id or have none
    wanted = uniq.join(members.select("node").distinct(), "node").select("node", "sig", "t.t1", "t.t2")
    wanted = stored(wanted, "wanted")
    distinct = docs.select(*text_digest(), "text").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    texts = stored(distinct.join(wanted.hint("merge"), ["t1", "t2"]).select("node", "sig", "text"), "texts")

    pairs = members.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    roots = components(stored(_confirmed(pairs, texts, width, similarity), "edges"))
    named = members.select("key", "node", "size").join(roots.withColumnRenamed("u", "node").hint("merge"), "node", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "node")), "named")
    loose = stored(_loose(named, wanted.select("node", "sig"), similarity), "loose")
    family = components(stored(loose.where("root <> to").select(F.col("root").alias("u"), F.col("to").alias("v")).distinct(), "kin"))
    family = loose.select("node", "root", "size").distinct().join(family.select(F.col("u").alias("root"), F.col("root").alias("family")), "root", "left")
    family = stored(family.withColumn("family", F.coalesce("family", "root")), "families")
    joined = components(stored(_links(family, texts, width, similarity), "links"))
    further = joined.select(F.col("u").alias("root"), F.col("root").alias("top"))
    roots = stored(roots.join(further, "root", "left").select("u", F.coalesce("top", "root").alias("root")).unionByName(joined).distinct(), "roots")
    rows = sketched.select("doc_id", "t1", "t2", "n_shingles", "node").join(roots.withColumnRenamed("u", "node").hint("merge"), "node", "left")
    return stored(rows.withColumn("root", F.coalesce("root", "node")).drop("node"), "rooted")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    rooted = classified(docs, width, similarity)
    first = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = _with_groups(rooted, first, "root").select("doc_id", "n_shingles", "component_id")
    alone = rooted.where("root is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()))


def without_near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """docs with one row for each component: that of the smallest doc_id (nulls last), and of its texts the one with the
    smallest digest. Rows without words all stay. Rows that repeat doc_id and text are one document, with either row's other columns."""
    key = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null")]
    rooted = classified(docs, width, similarity).select(*key, "t1", "t2", "root")
    one = F.min(F.struct("_null", "_id", "t1", "t2")).alias("x")
    kept = rooted.where("root is not null").groupBy("root").agg(one).select("x._id", "x._null", "x.t1", "x.t2")
    kept = stored(kept.unionByName(rooted.where("root is null").drop("root").distinct()), "kept")
    names = ["_id", "_null", *(f"_{c}" for c in ("t1", "t2"))]
    t1, t2 = text_digest()
    own = docs.select("*", *key, t1.alias("_t1"), t2.alias("_t2")).dropDuplicates(names)
    return own.join(kept.toDF(*names).hint("merge"), names, "left_semi").select([own[f"`{c}`"] for c in docs.columns])


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
