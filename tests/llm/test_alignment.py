"""Alignment of two tokenizers against the libraries' tokens, compared pair by pair."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import alignment as al
from tidemark.llm import tokens

DIR = "/root/testdata/sf0.001"
JSON, RANKS, MODEL = (tokens.public_path(p) for p in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def library_tokens(text):
    """Ids and bytes of both sides as the libraries give them; None without tokens."""
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters = {c: b for b, c in tokens._byte_letters().items()}
    a = [(i, bytes(letters[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i in sp.encode(text) for p in [sp.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (a, b) if text and b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole else None


def spans(side):
    at, out = 0, []
    for i, raw in side:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows):
    docs = []
    for doc, text in rows:
        got = library_tokens(text or "") if text else None
        if got is None:
            docs.append((doc, [], [], [], ""))
            continue
        a, b = map(spans, got)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        inside = lambda side, lo, hi: ",".join(str(i) for i, _, e in side if lo < e <= hi)
        groups = [f"{inside(a, lo, hi)}|{inside(b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links = [(i, j) for i, s, e in a for j, t, u in b if s < u and t < e]
        docs.append((doc, a, b, links, ";".join(groups)))
    count = Counter(p for *_, links, _ in docs for p in set(links))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    return [(d, len(a), len(b), g.count(";") + 1 if g else 0, len(x), sum(count[p] == top[p[0]] for p in x), sum(count[p] for p in x), sha(g), g) for d, a, b, x, g in docs]


TEXTS = [
    "The quick brown fox", "the the the cat's  don't\n\n tokenisation", "", None, "naïve café — 日本語テキスト 🎉🎉 done", "a▁b has a blank mark", "<|endoftext|> and <s> </s> <unk> stay text",
    "   leading and trailing   ", "\t\x00control", "x" * 300, "Дом стоит на холме", "1234567890 12,345.67 a1b2c3", " ", "The quick brown fox", "ab́c ﬁn ①②   \xa0nbsp　wide",
]


def as_rows(df):
    cols = ("doc_id", *al.MEASURES, "n_best", "count_sum", "groups_sha256", "groups")
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("long,chunk", [(65536, 32768), (40, 8), (0, 1)])
def test_equals_the_libraries(spark, long, chunk):
    """Whole, and with nearly all documents cut into ranges that are composed."""
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[0]), (None, TEXTS[1]), (50, " ".join(t for t in TEXTS if t and "▁" not in t) * 3), (51, "word " * 200 + "▁"), (52, "日本語" * 50)]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, block int, Row int, codes string").repartition(3)
    assert as_rows(al.token_alignment(df, JSON, RANKS, MODEL, True, long, chunk)) == Counter(brute(rows))


def test_of_real_texts(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").limit(25).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(al.token_alignment(df, JSON, RANKS, MODEL, True, 1500, 300)) == Counter(brute(rows))


def test_small_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(al, "ROWS", 2)
    monkeypatch.setattr(al, "ENTRIES", 3)
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert as_rows(al.token_alignment(df, JSON, RANKS, MODEL, True)) == Counter(brute(rows))
    assert al.token_alignment(df.limit(0), JSON, RANKS, MODEL).count() == 0
    only = al.token_alignment(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), JSON, RANKS, MODEL).collect()
    assert sorted(tuple(r) for r in only) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def side(n):
    return al.Side([b"x" * k for k in range(n)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 90), max_size=8), st.randoms())
def test_fragments_compose_in_any_bracketing(a, b, cuts, rnd):
    """Ids are lengths here; ranges may cut through tokens, which belong to the range of their last byte."""
    x = side(6)
    short = sum(a) - sum(b)
    a, b = np.array(a + [1] * max(0, -short)), np.array(b + [1] * max(0, short))
    end_a, end_b = al.ends(a, x), al.ends(b, x)
    at = [0, *sorted(c for c in set(cuts) if c < end_a[-1]), int(end_a[-1])]
    whole = al.closed(a, b, x, x)
    want = [tuple(map(tuple, (a[whole.group_a == g], b[whole.group_b == g]))) for g in range(whole.group_a[-1] + 1)]

    def groups(ids):
        c = al.closed(*ids, x, x)
        return [tuple(map(tuple, (ids[0][c.group_a == g], ids[1][c.group_b == g]))) for g in range(c.group_a[-1] + 1 if len(ids[0]) else 0)]

    parts = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        in_a, in_b = (end_a > lo) & (end_a <= hi), (end_b > lo) & (end_b <= hi)
        f, middle = al.fragment(a[in_a], b[in_b], end_a[in_a], end_b[in_b])
        parts.append((f, groups(middle)))
    while len(parts) > 1:
        k = rnd.randrange(len(parts) - 1)
        (f, left), (g, right) = parts[k : k + 2]
        h, made = al.composed(f, g)
        parts[k : k + 2] = [(h, left + (groups(made) if made else []) + right)]
    f, middle = parts[0]
    assert f.cut and not len(f.suffix[0]) and groups(f.prefix) + middle == want


def test_ranges_cover_a_text():
    text = "ein zwei  drei vier fünf日本 sechs. sieben acht " * 30
    parts = list(al.ranges(text, 40))
    assert " ".join(parts) == text and len(parts) > 10 and all(len(p.encode()) >= 40 for p in parts[:-1])
    assert list(al.ranges("日本" * 100, 10)) == ["日本" * 100]
