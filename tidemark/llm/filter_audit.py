"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

Every document gets a mask of the filters that it fails; documents are counted by part and mask (at most 2 ** filters rows
a part). A part's counts become a zero-suppressed decision diagram: a level is a filter, a node's two branches are the masks
that pass and that fail it, a leaf is a mask's counts, and a node carries the counts of all masks under it, so that equal
subdiagrams are kept once and filters that nobody fails have no node. All orders are visited by swaps of two adjacent levels,
each of which only touches the nodes of these two; a node keeps its function and its counts through a swap. In an order, the
path that passes every filter gives the steps: what hangs at its fail branches is removed there, and no other mask is read.

Edge cases: a null text is empty; a null part is the empty string; a document without a doc_id has no smaller id, so it is no
duplicate, and makes none; rows that repeat doc_id and text are documents of their own, neither before the other; a doc_id
that labels hold several times is good or toxic if any of its rows says so, null flags being no; labels without a doc_id label
nothing; other columns are ignored; an empty table gives an empty result. Texts are compared by their SHA-256."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Most filters: all their orders are reported.
MOST = 7
_SPLIT = r"'[\\x20\\x09-\\x0D]+'"
#: Conditions under which a document fails, over text, n_words, n_distinct, n_upper, n_chars.
CONDITIONS = {"A": "n_words < 200", "B": "100 * n_distinct < 50 * n_words", "C": "100 * n_upper > 2 * n_chars", "D": "text rlike '[#$%&*|]'"}
#: The filter that removes copies of a text with a smaller doc_id.
COPIES = "E"
COUNTS = ("n", "good", "toxic")

Counts = tuple[int, int, int]


def _plus(a: Counts, b: Counts) -> Counts:
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2])


class Diagram:
    """Counts of failure masks; mask bit k is filter k. Node 0 is the empty set of documents."""

    def __init__(self, masks: dict[int, Counts], filters: int):
        self.order = list(range(filters))  # the filter of each level
        self.var, self.passes, self.fails, self.counts = [-1], [0], [0], [(0, 0, 0)]
        self.known: list[dict[tuple[int, int], int]] = [{} for _ in range(filters)]
        leaves: dict[Counts, int] = {}

        def below(level: int, rows: dict[int, Counts]) -> int:
            if not rows:
                return 0
            if level == filters:
                (counts,) = rows.values()
                if counts not in leaves:
                    leaves[counts] = self._new(-1, 0, 0, counts)
                return leaves[counts]
            ok = {m: c for m, c in rows.items() if not m >> level & 1}
            return self._node(level, below(level + 1, ok), below(level + 1, {m: c for m, c in rows.items() if m not in ok}))

        self.root = below(0, {m: c for m, c in masks.items() if any(c)})

    def _new(self, var: int, ok: int, bad: int, counts: Counts) -> int:
        for held, x in ((self.var, var), (self.passes, ok), (self.fails, bad), (self.counts, counts)):
            held.append(x)
        return len(self.var) - 1

    def _node(self, var: int, ok: int, bad: int) -> int:
        if not bad:  # nobody fails: no node
            return ok
        got = self.known[var].get((ok, bad))
        if got is None:
            got = self.known[var][ok, bad] = self._new(var, ok, bad, _plus(self.counts[ok], self.counts[bad]))
        return got

    def swap(self, level: int) -> None:
        """Exchange the filters of this level and the next. Nodes of the upper filter that have one of the lower beneath are
        rewritten in place, so that what points at them still points at the same documents."""
        x, y = self.order[level : level + 2]
        self.order[level : level + 2] = y, x
        parts = lambda n: (self.passes[n], self.fails[n]) if self.var[n] == y else (n, 0)
        touched = [(key, n) for key, n in self.known[x].items() if y in (self.var[key[0]], self.var[key[1]])]
        for key, _ in touched:
            del self.known[x][key]
        for (ok, bad), n in touched:
            (ok_ok, ok_bad), (bad_ok, bad_bad) = parts(ok), parts(bad)
            self.var[n], self.passes[n], self.fails[n] = y, self._node(x, ok_ok, bad_ok), self._node(x, ok_bad, bad_bad)
        for n in (n for _, n in touched):
            self.known[y][self.passes[n], self.fails[n]] = n
        self._sweep()

    def _sweep(self) -> None:
        """Forget nodes that nothing points at."""
        live, todo = set(), [self.root]
        while todo:
            n = todo.pop()
            if n not in live and self.var[n] >= 0:
                live.add(n)
                todo += (self.passes[n], self.fails[n])
        for held in self.known:
            for key in [k for k, n in held.items() if n not in live]:
                del held[key]

    def steps(self) -> Iterator[tuple[int, Counts, Counts]]:
        """Along the path that passes all: each level's filter, the counts of what is kept after it and of what it removes."""
        n = self.root
        for f in self.order:
            if self.var[n] == f:
                n, removed = self.passes[n], self.counts[self.fails[n]]
            else:
                removed = (0, 0, 0)
            yield f, self.counts[n], removed


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap with the next ones so that n filters go through all their orders: the last filter runs through the
    others from end to end, and at each end the others take their next step."""
    if n < 2:
        return
    others = list(adjacent_swaps(n - 1))
    for k, level in enumerate([*others, None]):
        down = k % 2 == 0  # the last filter starts at the bottom
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        if level is not None:
            yield level + down


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def steps_of_orders(masks: dict[int, Counts], names: list[str]) -> list[tuple]:
    """Rows of REPORT without the part."""
    diagram = Diagram(masks, len(names))
    seen = []
    for swap in (None, *adjacent_swaps(len(names))):
        if swap is not None:
            diagram.swap(swap)
        seen.append(("".join(names[f] for f in diagram.order), list(diagram.steps())))
    total, alone, shapley = [0] * len(names), [0] * len(names), [0] * len(names)
    for _, steps in seen:
        total[steps[0][0]], alone[steps[-1][0]] = steps[0][2][0], steps[-1][2][0]  # a filter meets all its documents first, and only its own last
        for f, _, removed in steps:
            shapley[f] += removed[0]
    return [(order, k, kept[0], gone[0], total[f] - gone[0], alone[f], gone[1], gone[2], shapley[f]) for order, steps in seen for k, (f, kept, gone) in enumerate(steps, 1)]


def measured(docs: DataFrame, part: Column) -> DataFrame:
    """doc_id, part, text and its measures, in Spark's own functions."""
    rows = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.expr(f"filter(split(text, {_SPLIT}), w -> w <> '')"))
    return rows.selectExpr("*", "size(words) as n_words", "size(array_distinct(words)) as n_distinct", "length(regexp_replace(text, '[^A-Z]+', '')) as n_upper", "length(text) as n_chars")


def failure_masks(docs: DataFrame, labels: DataFrame, conditions: dict[str, str], part: Column, copies: bool = True) -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters that they fail, bit k for the k-th; the last is that of copies.
    Copies shrink to one row for each text, part and pair of labels before they are shuffled by their text."""
    bits = [f"if({c}, {1 << k}, 0)" for k, c in enumerate(conditions.values())]
    rows = measured(docs, part).selectExpr("doc_id", "part", "unhex(sha2(text, 256)) as digest", f"{' + '.join(bits) or '0'} as mask")
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("rows"))
    flags = labels.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(flags, "doc_id", "left").select("doc_id", "part", "digest", "mask", "rows", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rows"))).alias("first")
    by_text = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("doc_id").isNull(), F.col("rows"))).alias("loose"), first)
    if copies:  # of a text there are at most four rows a part here
        earliest = F.min("first.doc_id").over(Window.partitionBy("digest"))
        originals = F.coalesce(F.when(F.col("first.doc_id") == earliest, F.col("first.rows")), F.lit(0)) + F.coalesce("loose", F.lit(0))
        by_text = by_text.withColumn("originals", originals)
        again = F.array(F.struct(F.col("mask"), F.col("originals").alias("rows")), F.struct((F.col("mask") + (1 << len(conditions))).alias("mask"), (F.col("rows") - F.col("originals")).alias("rows")))
        by_text = by_text.select("part", "good", "toxic", F.explode(again).alias("x")).select("part", "good", "toxic", "x.mask", "x.rows")
    of = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("rows"))), F.lit(0)).alias(flag)
    return by_text.groupBy("part", "mask").agg(F.sum("rows").alias("n"), of("good"), of("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, str] = CONDITIONS, copies: str | None = COPIES, part: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step. conditions: name -> SQL over the columns of `measured` that holds
    for documents that fail (null: they don't); copies: the name of the filter of duplicates, None for no such filter."""
    names = [*conditions, *([copies] if copies else [])]
    if not 1 <= len(names) <= MOST:
        raise ValueError(f"1 to {MOST} filters")
    masks = failure_masks(docs, labels, conditions, F.col(part), bool(copies))

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(pdf["mask"], pdf["n"], pdf["good"], pdf["toxic"], strict=True)}
        out = pd.DataFrame(steps_of_orders(rows, names), columns=[c.split()[0] for c in REPORT.split(", ")[1:]])
        out.insert(0, "part", pdf["part"].iloc[0])
        return out

    return masks.groupBy("part").applyInPandas(report, REPORT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_LETTERS = "".join([*CONDITIONS, COPIES])
_PREFIX = lambda upto: " + ".join(f"(CASE WHEN {upto} >= {k} THEN b{k} ELSE 0 END)" for k in range(1, 6))
#: Counted order by order from the masks, without diagrams.
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
      + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
      + (CASE WHEN coalesce(low < w.doc_id, false) THEN 16 ELSE 0 END) AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
v AS (SELECT substr('{_LETTERS}', k::INT, 1) AS c, (1 << (k - 1)::INT) AS b FROM range(1, 6) r(k)),
o AS (SELECT v1.c || v2.c || v3.c || v4.c || v5.c AS filter_order, v1.b AS b1, v2.b AS b2, v3.b AS b3, v4.b AS b4, v5.b AS b5 FROM v v1, v v2, v v3, v v4, v v5
      WHERE v1.b + v2.b + v3.b + v4.b + v5.b = 31 AND v1.b | v2.b | v3.b | v4.b | v5.b = 31),
s AS (SELECT filter_order, step::INT AS step, {_PREFIX("step - 1")} AS earlier, {_PREFIX("step")} AS upto FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, upto - earlier AS own, sum(CASE WHEN mask & upto = 0 THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN mask & upto = upto - earlier THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN mask & (upto - earlier) <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN mask = upto - earlier THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN mask & upto = upto - earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & upto = upto - earlier THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM x
"""
