"""Brute force, round trips and edge cases of the operators."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, common, license_scan, minhash, packing, pieces, quality, sharding, token_count, token_files, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, score double"
BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, BASE), (2, BASE + " tail"), (3, BASE), (3, BASE), (4, None), (5, ""), (6, "  \n "), (7, "One"), (8, "one"),
    (9, BASE.replace("w30", "x30").replace("w10", "x10")), (10, "a b a b a b a b a b a b a b a b a b a b"),
    (None, "no id at all"), (11, "Licensed under the Apache License, Version 2.0. All rights reserved. CC-BY cc by"), (12, "é ß 日本 🎉 ▁x  y\x00\t" * 3000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 0.5) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_links_what_brute_force_links(spark, docs, k):
    rng = np.random.default_rng(3)
    texts = dict(enumerate(t for _, t in ROWS))
    for i in range(60):  # near copies around the limit
        w = BASE.split()
        for j in rng.choice(60, rng.integers(0, 8), replace=False):
            w[j] = f"z{rng.integers(9)}"
        texts[100 + i] = " ".join(w)
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, k).collect()}
    assert {i: (r["component_id"], r["n_shingles"], r["kept"]) for i, r in got.items()} == {i: (root[i], len(sets[i]), root[i] == i) for i in texts}
    assert minhash.near_duplicates(docs, k).count() == len(ROWS)


def linked(texts, k):
    """Classes of (key, text) by brute force: key -> smallest key reachable."""
    sets = [(i, shingle_set(t, k)) for i, t in texts]
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    return [find(x) for x in range(len(sets))], sets


def test_minhash_judges_each_row_by_its_own_text(spark):
    """Rows that repeat a doc_id with other texts, rows without one, ids beyond 2**53."""
    other = " ".join(f"q{i}" for i in range(60))
    rows = [(5, BASE), (5, other), (3, other + " z"), (9, BASE), (None, BASE + " tail"), (None, "alone at last"), (None, other + " y"), (2**53 + 1, "big one"), (2**53, "big two"), (None, None)]
    got = Counter(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 2).collect())
    root, sets = linked(rows, 2)
    want = Counter()
    for k, (i, s) in enumerate(sets):
        ids = [rows[x][0] for x in range(len(rows)) if root[x] == root[k] and rows[x][0] is not None] if s else [i] * (i is not None)
        first = min(ids, default=None)
        want[i, len(s), first, i == first if i is not None else first is None] += 1
    assert got == want


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_in_large_groups(spark, monkeypatch, width):
    """A group of near copies, many of them loose, in cells of a few nodes; and words that all documents share."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "FAMILY", 8)
    rng = np.random.default_rng(width)
    base, rows = [f"w{i}" for i in range(90)], []
    for i in range(160):
        w = list(base)
        for j in rng.choice(90, rng.integers(0, 12 if width == 2 else 5), replace=False):
            w[j] = f"z{rng.integers(6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join([*base[:40], *(f"u{i}x{j}" for j in range(12))])) for i in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()}
    root, _ = linked(rows, width)
    assert got == {i: rows[root[k]][0] for k, (i, _) in enumerate(rows)}
    assert 20 < len(set(got.values())) < 190


def test_one_document_of_each_group_stays(spark):
    rows = [(5, BASE, 1), (5, "other " + BASE[:20], 2), (3, BASE + " z", 3), (None, BASE, 4), (None, "two words", 5), (None, "two words", 6), (7, None, 7), (8, "", 8), (3, BASE + " z", 9)]
    got = minhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, T1 int"), 5)
    assert got.columns == ["doc_id", "text", "T1"]
    assert Counter((r[0], r[1]) for r in got.collect()) == Counter([(3, BASE + " z"), (5, "other " + BASE[:20]), (None, "two words"), (7, None), (8, "")])


def test_sketches_keep_whole_digests_beside_empty_texts(spark):
    texts = ["", *(f"some text number {i}" for i in range(8))]
    got = {r["doc_id"]: r["node"] for r in minhash.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), 2).collect()}
    assert got == {i: minhash._digest(minhash.shingles(t, 2, minhash.WordHashes())) if t else None for i, t in enumerate(texts)}


def test_minima_of_sets_of_any_size():
    rng = np.random.default_rng(9)
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (1, 0, 7, 8191, 2, 20_000, 8192, 3)]
    a, b, _, _ = minhash._family()
    for got, s in zip(minhash.minima(sets), sets, strict=True):
        if len(s):
            keys = (s >> np.uint64(32))[:, None]
            assert (got == ((keys * a + b) >> np.uint64(32)).min(axis=0)).all()
    few = minhash.minima([np.arange(1 << 32, (1 << 40) + (1 << 32), 1 << 32, dtype=np.uint64)])  # keys in a row spread well
    assert len(np.unique(few)) > 0.99 * few.size


def test_components_of_a_path(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = dict(minhash.components(spark.createDataFrame(rows, "u long, v long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_license_templates(docs):
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    assert got[11]["labels"] == "apache-2.0,cc-by,reserved" and got[11]["n_base"] == 3 and got[11]["base_labels"] == "cc-by,reserved"
    assert got[4]["n_words"] == 0 and got[4]["first_word"] is None and got[4]["labels"] == "" and got[5]["score"] == 0
    a = license_scan.compiled("start <<optional>> maybe <<end>> <<any:2>> stop")
    ends = [a.end(license_scan.words_of(t), 0) for t in ("start stop", "start maybe stop", "start x y stop", "start x y z stop", "start maybe x stop z")]
    assert ends == [2, 3, 4, -1, 4]


def test_license_texts(spark):
    notice = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
    in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
    portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
    PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
    OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    texts = [notice.format("", 2), notice.format("", 3), notice.format("Lesser ", "2.1"), notice.format("Library ", 2), mit, mit.replace("EXPRESS OR IMPLIED", "EXPRESS"), "Licensed under the GNU General Public License version 2"]
    got = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["labels"] for r in sorted(got, key=lambda r: r["doc_id"])] == ["gpl,gpl-2.0", "gpl,gpl-3.0", "gpl,lgpl", "gpl,lgpl", "mit-permission", "", "gpl,gpl-2.0"]


def license_pattern(template):
    """A template as a pattern over words that each end in a blank; longest runs by trying all ends."""
    out = ""
    for i, piece in enumerate(re.split(r"<<(optional|end|any:\d+)>>", template)):
        out += "".join(re.escape(w.decode()) + " " for w in license_scan.words_of(piece)) if i % 2 == 0 else {"optional": "(?:", "end": ")?"}.get(piece) or rf"(?:\S+ ){{0,{piece[4:]}}}"
    return re.compile(out)


def test_license_scan_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    notices = [re.sub(r"<<any:\d+>>", lambda m: " ".join(["some", "one"][: rng.integers(0, 3)]), t) for own in license_scan.TEMPLATES.values() for t in ([own] if isinstance(own, str) else own)]
    texts = [None, "", "CC-BY cc by, cc by-sa", "all rights reserved " * 3, "x" * 200_000, "licensed under cc by " * 20_000]
    for t in notices:
        keep = lambda t: re.sub(r"<<(optional|end)>>", "", t)
        while (m := re.search(r"<<optional>>((?:(?!<<optional>>).)*?)<<end>>", t)):
            t = t[: m.start()] + (m[1] if rng.random() < 0.5 else "") + t[m.end() :]
        w = keep(t).split()
        texts += [f"Before, {keep(t).upper()}: after.", " ".join(w[:-1]), " ".join([*w[: len(w) // 2], "altered", *w[len(w) // 2 :]])]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    patterns = [(label, license_pattern(t)) for label, own in license_scan.TEMPLATES.items() for t in ([own] if isinstance(own, str) else own)]
    seen = set()
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        base, places, labels, covered = set(), [], set(), set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            for at in (k for k in range(len(words)) if words[k : k + len(p)] == p):
                places.append(at)
                base.add(label)
                covered.update(range(at, at + len(p)))
        if len(words) < 5_000:
            for at in range(len(words)):
                rest = "".join(w + " " for w in words[at:])
                for label, pattern in patterns:
                    ends = [m.end() for k in range(len(rest) + 1) if (k == 0 or rest[k - 1] == " ") and (m := pattern.fullmatch(rest, 0, k))] if pattern.match(rest) else []
                    if ends:
                        labels.add(label)
                        covered.update(range(at, at + rest[: max(ends)].count(" ")))
            assert got[i]["labels"] == ",".join(sorted(base | labels))
            assert got[i]["score"] == (round(len(covered) / len(words), 6) if words else 0)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)))
        seen |= labels
    assert seen == set(license_scan.TEMPLATES)


def test_token_counts_and_cache(spark, docs, tmp_path):
    path, cache = tokens.public_path("piece_bpe_32k.model"), str(tmp_path / "cache")
    sp = tokens.sentencepiece_model(path)
    want = Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in ROWS)
    for _ in range(2):
        got = token_count.token_counts(docs, path, cache)
        assert Counter(tuple(r)[:3] for r in got.collect()) == want and got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in ROWS})  # the second run encoded nothing


def test_token_counts_of_the_query_are_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_count, "shared_dir", lambda _: f"file://{tmp_path}", raising=False)
    runs = [sorted(map(tuple, token_count.op3_token_counts(spark, "/root/testdata/sf0.001").collect())) for _ in range(2)]
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("coalesce(text, '')").distinct().count()
    assert (tmp_path / "token-cache").exists()
    kept = spark.read.parquet(f"file://{tmp_path}/token-cache")
    assert runs[0] == runs[1] and kept.count() == texts  # the second run encoded nothing


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(400, 8))
    m[50:150] = m[50]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(400, None), (500, [0.0] * 8), (600, [float("nan")] * 8), (700, [1.0, None] + [0.0] * 6), (50, m[50].tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50, recall=1.0).collect()
    for q in range(0, 400, 50):
        d = np.sqrt(((m - m[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert {r["query_id"] for r in got} == set(range(0, 400, 50))


def test_few_vectors_are_all_found(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 9, 40):
        rows = [(i, rng.normal(size=3).tolist()) for i in range(n)]
        got = Counter(r["query_id"] for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1).collect())
        assert got == Counter({i: min(10, n - 1) for i in range(n) if n > 1})


@pytest.mark.parametrize("kind", ["diffuse", "clustered"])
def test_recall_over_many_lists(spark, kind):
    rng = np.random.default_rng(12)
    m = rng.normal(size=(20_000, 24)) if kind == "diffuse" else rng.normal(size=(50, 24))[rng.integers(0, 50, 20_000)] + 0.1 * rng.normal(size=(20_000, 24))
    index = ann.fitted(m[:8000], len(m))
    assert len(index.coarse) == 128 and (index.probes < 128 if kind == "diffuse" else index.probes < 32)
    got = defaultdict(set)
    for r in ann.nearest(spark.createDataFrame(list(enumerate(m.tolist())), "vec_id long, embedding array<double>"), 200).collect():
        got[r["query_id"]].add(r["vec_id"])
    recall = []
    for q in range(0, len(m), 200):
        d = ((m - m[q]) ** 2).sum(1)
        d[q] = np.inf
        recall.append(len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist())) / 10)
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize("size", [10, 500, 4000])
def test_nearest_neighbours_among_near_copies(spark, size):
    rng = np.random.default_rng(size)
    m = rng.normal(size=(6000, 16))
    m /= np.sqrt((m**2).sum(1))[:, None]
    group = np.sort(rng.choice(6000, size, replace=False))
    m[group] = m[group[0]] + 1e-6 * rng.normal(size=(size, 16))  # near-equal: their codes tie
    queries = np.concatenate([group[:: max(1, size // 20)], np.setdiff1d(np.arange(6000), group)[::100]])
    ids = np.arange(6000) * 2 + 1
    ids[queries] -= 1  # only even ids are queries
    got = {}
    for r in ann.nearest(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m)], "vec_id long, embedding array<double>"), 2).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = {}
    for q in queries:
        d = np.sqrt(((m - m[q]) ** 2).sum(1))
        d[q] = np.inf
        recall[q] = len(got[ids[q]] & set(ids[np.lexsort((ids, d))[:10]].tolist())) / 10
    inside = [recall[q] for q in queries if q in set(group.tolist())]
    assert len(got) == len(queries) and np.mean(list(recall.values())) > 0.9
    assert np.mean(inside) > 0.999 if size > 10 else np.mean(inside) > 0.9


def test_quality(spark, docs):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, spark.createDataFrame([(1,), (9,)], "doc_id long")).collect()}
    assert got[10]["n_repeat_words"] == 20 and got[10]["base_failed"] and not got[10]["kept"]
    assert got[4]["n_words"] == 0 and got[4]["base_failed"] and got[1]["kept"] and got[1]["lang"] == "en"
    h = quality._hashes("x\na b\na b\n\n", quality.WordHashes())
    assert quality.base_counts("x\na b\na b\n\n", h) == (5, 5, 0, 1, 0)


def test_quality_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(80)]
    rows = [(i, ("\n" if i % 3 else " ").join(rng.choice(vocabulary[40 * (i % 2) :][:40], rng.integers(0, 60)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "é ß # * word\u00a0word\n\nline\nline\n \n \n" * 4), (203, "a b c d e f g h " * 400), (7, rows[7][1]), (None, "no id " * 9)]
    trusted = [(i,) for i in range(0, 80, 4)] + [(7,), (7,), (None,)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(trusted, "doc_id long"), threshold=-0.00001).collect()
    merged = quality.ratios(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(trusted, "doc_id long"), small=2)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    bucket = lambda gram: int(quality._buckets(quality.WordHashes().of([w.encode() for w in gram]))[-1])
    grams = lambda t: [bucket(w[k : k + n]) for n in (1, 2) for w in [words(t)] for k in range(len(w) - n + 1)]
    raw, target, ids = Counter(), Counter(), {i for i, in trusted if i is not None}
    for i, t in rows:
        raw.update(grams(t))
        if i in ids:
            target.update(grams(t))
    total = sum(raw.values()) + quality.BUCKETS
    share = lambda b: (raw[b] + 1) / total
    ratio = lambda b: math.log((target[b] + quality.BUCKETS * share(b)) / (sum(target.values()) + quality.BUCKETS)) - math.log(share(b))
    assert all(abs(merged[b] - ratio(b)) < 1e-9 for b in list(raw)[:200])
    want = Counter()
    for i, t in rows:
        w, g = words(t), grams(t)
        starts = [k for k in range(len(w) - 4) if sum(w[k : k + 5] == w[j : j + 5] for j in range(len(w) - 4)) > 1] if len(w) < 1000 else range(len(w) - 4)
        again = len({k + d for k in starts for d in range(5)})
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 10 or 100 * again > 20 * len(w)
        llr = sum(map(ratio, g)) / (len(g) + quality.PRIOR)
        assert abs(llr + 0.00001) > 1e-6
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), again, round(llr, 6), failed, not failed and llr >= -0.00001] += 1
    assert Counter((r[0], *r[2:7], round(r[7], 6), *r[8:]) for r in got) == want
    assert {r["kept"] for r in got if not r["base_failed"]} == {True, False}


def sequences(rows):
    """sequence_id -> length; pieces stand in them gapless, and in the order of their documents."""
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append(r)
    assert sorted(seqs) == list(range(len(seqs)))
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return {k: sum(r["length"] for r in own) for k, own in seqs.items()}


def test_packing(spark, docs):
    tok = tokens.json_tokenizer(tokens.public_path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs).collect()
    sequences(rows)
    want, got = Counter(), defaultdict(list)
    for i, t in ROWS:
        want[i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()] += 1
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        got[r["doc_id"]].append(r)
    for (i, ids), n in want.items():
        if sum(c for (d, _), c in want.items() if d == i) == 1:  # others repeat an id
            ids = np.frombuffer(ids, "<u4")
            assert [r["start"] for r in got[i]] == np.cumsum([0, *(r["length"] for r in got[i][:-1])]).tolist() and sum(r["length"] for r in got[i]) == len(ids) == got[i][0]["doc_tokens"]
            assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in got[i])


def test_cuts_stand_at_ends_of_sentences_and_documents(spark):
    """Most cuts stand at ends; the others within runs of more than LONG ids that have none. Padding is little."""
    path = tokens.public_path("byte_bpe_50k.json")
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(table).collect()
    size = sequences(rows)
    texts, ends = dict(table.select("doc_id", "text").collect()), packing.sentence_ends(path)
    encode = tokens.byte_level_encoder(path, tokens.public_path("byte_bpe_50k.tiktoken"))
    last = {}
    for r in rows:
        if r["sequence_id"] not in last or r["offset"] > last[r["sequence_id"]]["offset"]:
            last[r["sequence_id"]] = r
    within = 0
    for r in last.values():
        end, ids = r["start"] + r["length"], encode(texts[r["doc_id"]] or "")
        if end < r["doc_tokens"] and not ends[ids[end - 1]]:
            within += 1
            at = np.concatenate([[0], np.flatnonzero(ends[ids]) + 1, [len(ids) + 1]])
            k = np.searchsorted(at, end, side="right")
            assert at[k] - at[k - 1] > packing.LONG
    padding = 1 - sum(size.values()) / (1024 * len(size))
    print(f"padding {padding:.4f}, cuts within a sentence {within} of {len(last)}")
    assert padding < 0.01 and within <= 0.25 * len(last)


def test_packing_of_very_long_blanks(spark):
    rows = packing.pack_documents(spark.createDataFrame([(1, " " * 1_600_000 + "end."), (2, "x")], "doc_id long, text string")).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == rows[0]["doc_tokens"] and max(sequences(rows).values()) == 1024


def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        pos = [0, *np.cumsum(rng.integers(1, 7, 20)).tolist()]
        cost = [0, *rng.integers(0, 5, 20).tolist()]
        best = [0.0] + [float("inf")] * 20
        for j in range(1, 21):
            best[j] = min(best[i] + 10 - (pos[j] - pos[i]) + cost[j] for i in range(j) if pos[j] - pos[i] <= 10)
        got = packing.cuts(pos, cost, 10)
        assert sum(10 - (pos[j] - pos[i]) + cost[j] for i, j in zip([0, *got], got, strict=False)) == best[-1]


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 31])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001, dtype=np.uint32)
    f = token_files.TokenFile(token_files.file_bytes([7, None], [ids[:300], ids[300:]], bits, 64))
    assert (f.ids(0, len(ids)) == ids).all() and (f.ids(130, 77) == ids[130:207]).all() and f.null.tolist() == [0, 1]


def test_token_files(docs, tmp_path):
    encoder = lambda: lambda t: np.frombuffer(tokens.word_encoder(tokens.public_path("word_bpe_49k.json")).encode(t), "<u2").astype(np.uint32)
    got = token_files.read_token_files(token_files.write_token_files(docs, encoder, 49408, f"file://{tmp_path}/ids", shard=100), f"file://{tmp_path}/ids").collect()
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    tok = tokens.json_tokenizer(tokens.public_path("word_bpe_49k.json"))
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((i, crc(t)) for i, t in ROWS)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted((i for i, _ in ROWS), key=lambda i: -1 if i is None else i)


def test_pieces_as_the_library(docs):
    e = pieces.PieceEncoder(tokens.public_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    texts = [t or "" for _, t in ROWS] + ["".join(rng.choice(list("abeéß .,\n\t▁xTH019🎉 "), 40)) for _ in range(300)]
    assert all(np.frombuffer(e.encode(t), "<u4").tolist() == e.sp.encode(t) for t in texts)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in ROWS:
        ids = e.sp.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(e.sp.decode(ids).encode())] += 1
    assert Counter(tuple(r) for r in pieces.piece_digests(docs, tokens.public_path("piece_bpe_32k.model")).collect()) == want
    got = {r["doc_id"]: r for r in pieces.encoded_pieces(docs, tokens.public_path("piece_bpe_32k.model")).collect()}
    assert got[12]["decoded"] == e.sp.decode(e.sp.encode(dict(ROWS)[12])) and got[4]["ids"] == np.array([1, 2], "<u4").tobytes()


def test_encoders_as_the_library():
    odd = ["", " ", "  a  b ", "x <|endoftext|> y", "É é  x", "it's  don't ' s", "ΣΑΣ", "日本語 🎉", "İstanbul K Å", "a\n\nb", "12 3.14"]
    byte = tokens.byte_level_encoder(tokens.public_path("byte_bpe_50k.json"), tokens.public_path("byte_bpe_50k.tiktoken"))
    word = tokens.word_encoder(tokens.public_path("word_bpe_49k.json"))
    for t in odd:
        assert byte(t).tolist() == tokens.json_tokenizer(tokens.public_path("byte_bpe_50k.json")).encode(t, add_special_tokens=False).ids
        assert np.frombuffer(word.encode(t), "<u2").tolist() == tokens.json_tokenizer(tokens.public_path("word_bpe_49k.json")).encode(t, add_special_tokens=False).ids


def test_toxicity_is_fair_to_groups(spark):
    rng = np.random.default_rng(4)
    filler = lambda: " ".join(f"f{x}" for x in rng.integers(0, 200, 12))
    rows = []
    for i in range(600):
        bad, group = i % 4 == 0, i % 2 == 0  # the toxic rows all mention the group, some clean ones too
        rows.append((i, f"{filler()} {'muslim' if group else 'christian'} {'vile idiot' if bad else ''}", int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    extra = spark.createDataFrame([(9001, "a muslim f1 f2", None), (9002, "you vile idiot f3", None), (9003, None, None)], "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df.unionByName(extra).drop("toxic"), df.select("doc_id", "toxic")).collect()}
    assert got[9001]["predicted"] == 0 and got[9002]["predicted"] == 1 and got[9003]["predicted"] == 0
    assert all(r["predicted"] == rows[i][2] for i, r in got.items() if i < 600)


def test_toxicity_learns_from_rows_that_are_not_held_out(spark):
    rows = [(i, "vile words" if i % 2 else "kind words") for i in range(400)] + [(None, "vile words"), (401, None), (402, ""), (403, "vile " * 100_000), (5, "vile words")]
    labels = [(i, i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2) for i in range(400)] + [(None, 1), (404, None)]  # held-out ones are wrong
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got) and all(r["predicted"] == ("vile" in r["text"]) for r in got if r["text"])
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = lambda t: 1 / (1 + math.exp(-model[1] - sum(model[0].astype(np.float32)[toxicity.Buckets()[w]] for w in set(toxicity.words_of(t)))))
    assert all(abs(r["score"] - score(r["text"])) < 1e-5 for r in got)


def test_counterfactual_term_takes_weight_off_group_names(spark):
    rng = np.random.default_rng(14)
    filler = lambda: " ".join(f"f{x}" for x in rng.integers(0, 50, 8))
    rows = [(i, f"{filler()} {'muslim' if rng.random() < (0.9 if i % 2 else 0.1) else 'christian'} {'vile' if i % 2 and rng.random() < 0.9 else ''}", i % 2) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weight = [toxicity.learn(df.drop("toxic"), df.select("doc_id", "toxic"), penalty=p)[0][toxicity.Buckets()[b"muslim"]] for p in (0, toxicity.PENALTY)]
    assert weight[0] > 1 and weight[1] < 0.5 * weight[0]


def test_sharding(spark, docs):
    many = spark.createDataFrame([(i % 50 if i % 3 else 1, "x" * 100) for i in range(900)], "doc_id long, text string")
    rows = sharding.shards(many, limit=2000).collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["n_bytes"]
    assert len(rows) == 900 and max(size.values()) <= 2000 and all(size[r["shard"]] == r["shard_bytes"] for r in rows)
    assert not any(a != b and b.startswith(a) and "-" not in b for a in size for b in size)
    assert {r["shard"] for r in sharding.shards(docs).collect()} == {""}


def test_sharding_splits_as_the_sql_does(spark):
    import duckdb

    duckdb.sql("create or replace view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = duckdb.sql(sharding.OP10_SQL)
    got = sharding.op10_sharding(spark, "/root/testdata/sf0.01").select(want.columns).collect()
    assert Counter(tuple(r) for r in got) == Counter(want.fetchall()) and len({r["shard"] for r in got}) > 8


def test_shards_are_written(spark, tmp_path):
    many = spark.createDataFrame([(i, "x" * (i % 90)) for i in range(500)], "doc_id long, text string")
    sharding.write_shards(many, f"{tmp_path}/out", limit=2000)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r[0], r[1]) for r in got.select("doc_id", "text").collect()) == Counter(tuple(r) for r in many.collect())
    assert got.groupBy("shard").agg({"text": "count"}).count() > 8


def test_ids_stay_whole_beside_a_null(spark):
    """A column of ids and nulls never becomes one of doubles."""
    big = 2**53 + 1
    df = spark.createDataFrame([(big, BASE, big + 2), (None, "one two", None), (big + 4, None, big)], "doc_id long, text string, extra long").coalesce(1)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = tokens.public_path("piece_bpe_32k.model")
    words = lambda: lambda t: np.frombuffer(tokens.word_encoder(tokens.public_path("word_bpe_49k.json")).encode(t), "<u2").astype(np.uint32)
    folder = f"{common.scratch(spark, 'files')}"
    outs = [
        minhash.near_duplicates(df), license_scan.license_scan(df), token_count.token_counts(df, model, f"{common.shared_dir(spark)}/c"), quality.quality_rules(df, labels), packing.pack_documents(df),
        token_files.read_token_files(token_files.write_token_files(df, words, 49408, f"file://{folder}"), f"file://{folder}"), pieces.piece_digests(df, model), toxicity.toxicity(df, labels), sharding.shards(df),
    ]
    for out in outs:
        assert {r["doc_id"] for r in out.collect()} == {big, None, big + 4}
    for k in (3, 7):
        assert {r["extra"] for r in outs[k].collect()} == {big, None, big + 2}


def test_extra_columns_that_clash(spark):
    """Columns named like results are replaced where columns are passed on, and ignored elsewhere."""
    names = "n_shingles component_id Kept n_bytes n_tokens over_limit start length ids_crc32 sequence_id offset part held_out Score predicted shard depth shard_bytes n_words llr base_failed node key t1 digest size root ids decoded h".split()
    df = spark.createDataFrame([(1, BASE, *[7] * len(names)), (2, "a b", *[8] * len(names))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = tokens.public_path("piece_bpe_32k.model")
    words = lambda: lambda t: np.frombuffer(tokens.word_encoder(tokens.public_path("word_bpe_49k.json")).encode(t), "<u2").astype(np.uint32)
    folder = f"{common.scratch(spark, 'files')}"
    run = {
        "op1": lambda d: minhash.near_duplicates(d), "op2": license_scan.license_scan, "op3": lambda d: token_count.token_counts(d, model, f"{common.shared_dir(spark)}/c"), "op5": lambda d: quality.quality_rules(d, labels),
        "op6": packing.pack_documents, "op7": lambda d: token_files.read_token_files(token_files.write_token_files(d, words, 49408, f"file://{folder}"), f"file://{folder}"), "op8": lambda d: pieces.piece_digests(d, model),
        "op9": lambda d: toxicity.toxicity(d, labels), "op10": sharding.shards, "stays": minhash.without_near_duplicates,
    }
    for name, f in run.items():
        got, plain = f(df), f(df.select("doc_id", "text"))
        assert len({c.lower() for c in got.columns}) == len(got.columns), name
        cols = plain.columns if name != "stays" else ["doc_id", "text"]
        assert Counter(map(tuple, got.select(cols).collect())) == Counter(map(tuple, plain.select(cols).collect())), name
    assert set(quality.quality_rules(df, labels).columns) >= {"kept", "shard"} and "Kept" not in quality.quality_rules(df, labels).columns


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    model, folder = tokens.public_path("piece_bpe_32k.model"), f"file://{common.scratch(spark, 'files')}"
    for df in (
        minhash.near_duplicates(none), license_scan.license_scan(none), token_count.token_counts(none, model, f"{common.shared_dir(spark)}/empty-cache"), ann.nearest(vectors, 100),
        minhash.without_near_duplicates(none), quality.quality_rules(none, labels), packing.pack_documents(none), token_files.write_token_files(none, lambda: None, 49408, folder),
        token_files.read_token_files(token_files.write_token_files(none, lambda: None, 49408, folder), folder), pieces.piece_digests(none, model), toxicity.toxicity(none, labels), sharding.shards(none),
    ):
        assert df.count() == 0


def test_pipeline(spark):
    """Each stage against the stage before, by brute force where the model allows it."""
    import corpus_pipeline

    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    labels = spark.read.parquet(f"{where}/labels.parquet")
    rows = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    judged = {r["doc_id"]: r for r in quality.quality_rules(docs, labels.where("quality = 1")).collect()}
    kept = [r for r in rows if judged[r["doc_id"]]["kept"]]
    out = stages["quality"](spark, docs, where)
    assert out.columns == docs.columns and Counter(out.collect()) == Counter(kept)
    docs = spark.createDataFrame(kept, docs.schema)
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    kept = [r for r in kept if not scored[r["doc_id"]]]
    out = stages["toxicity"](spark, docs, where)
    assert out.columns == docs.columns and Counter(out.collect()) == Counter(kept)
    docs = spark.createDataFrame(kept, docs.schema)
    kept.sort(key=lambda r: r["doc_id"])
    root, _ = linked([(r["doc_id"], r["text"]) for r in kept], 5)
    kept = [r for k, r in enumerate(kept) if root[k] == k]
    out = stages["near_dedup"](spark, docs, where)
    assert out.columns == docs.columns and Counter(out.collect()) == Counter(kept)
    packed = corpus_pipeline.run(spark, where).collect()
    sequences(packed)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept} and 0 < len(kept) < len(rows)


def test_toxicity_on_held_out_labels(spark):
    """sf0.1: rows that the model has never seen."""
    where = "/root/testdata/sf0.1"
    got = toxicity.op9_toxicity(spark, where).where("held_out").join(spark.read.parquet(f"{where}/labels.parquet").where("toxic is not null"), "doc_id").select("predicted", "toxic").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    bad, good = ([r["predicted"] for r in got if r["toxic"] == k] for k in (1, 0))
    print(f"held out: {len(got)} rows, accuracy {right:.4f}, recall {sum(bad) / len(bad):.4f}, false positives {sum(good) / len(good):.4f}")
    assert right >= 0.96 and sum(bad) / len(bad) >= 0.75 and sum(good) / len(good) <= 0.01


def test_toxicity_learns_from_every_word_of_a_long_text(spark):
    """A word after very many others tells the labels apart."""
    rows = [(i, " ".join(f"q{i}x{k}" for k in range(6000)) + (" vile" if i % 2 else " kind"), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights, _ = toxicity.learn(df, df.select("doc_id", "toxic"))
    assert weights[toxicity.Buckets()[b"vile"]] > 0.5 > -0.5 > weights[toxicity.Buckets()[b"kind"]]


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Null texts and ids, repeated rows, columns named like those of the stages, and no rows at all."""
    import corpus_pipeline

    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    rows = docs.unionByName(docs.limit(20)).unionByName(docs.limit(9).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(9).withColumn("doc_id", F.lit(None).cast("long")))
    rows = rows.withColumn("score", F.lit(1)).withColumn("Kept", F.lit("x")).withColumn("root", F.lit(2.0)).withColumn("t1", F.lit(3))
    for name, df in (("rows", rows), ("none", rows.limit(0))):
        folder = tmp_path / name
        df.write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(f"{where}/labels.parquet").write.parquet(str(folder / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert bool(got) == (name == "rows")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, where).columns == rows.columns, name


def test_shards_of_one_large_document_and_of_null_texts(spark):
    df = spark.createDataFrame([(1, "x" * 5000), (2, None), (3, ""), (4, "y" * 10), (5, "z" * 90)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sharding.shards(df, 100).collect()}
    assert len(got) == 5 and got[1]["n_bytes"] == 5000 and got[1]["shard_docs"] == 1 and got[2]["n_bytes"] == got[3]["n_bytes"] == 0
    assert all(r["shard_bytes"] <= 100 for i, r in got.items() if i != 1)
