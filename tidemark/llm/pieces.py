"""SentencePiece encoding of merge (BPE) models by backtracking, and decoding.

A sequence of pieces is the encoding of a string exactly if every two neighbours, written together and merged anew, come
out as those two pieces. So: an Aho-Corasick automaton finds all pieces at all places in one pass; from the left, the
longest piece is tried whose end isn't known to fail and which is compatible with the piece before it; if none is, the
place is marked in a bitfield and the piece before it is taken back. Compatibility is kept for pairs met before.

A text is normalised as such models do it (blanks written as U+2581, one more in front) and cut where no piece can span:
before a run of U+2581. Segments met before come out of a table of bounded size. Characters that no piece has are written as
their UTF-8 bytes' pieces.

Edge cases: null and empty texts are begin and end only; any white space, control characters and U+2581 itself are
encoded as the library does; repeated rows give equal results; an empty table gives an empty result. Models whose
normaliser changes text, whose pieces span words or which lack byte pieces are refused."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import per_text, table
from tidemark.llm.tokens import LONG, public_path, sentencepiece_model

BLANK = "▁"
MOST = 400_000
_SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class PieceEncoder:
    def __init__(self, path: str, most: int = MOST):
        import ahocorasick

        sp = self.sp = sentencepiece_model(path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in ids}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        if len(self.byte) < 256 or any(BLANK in p.lstrip(BLANK) for p in self.id) or sp.normalize(" ﬁ  A") != f"{BLANK * 2}ﬁ{BLANK * 2}A":
            raise ValueError("only merge models with byte pieces, plain normalisation and pieces within words")
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) == 1 or self.merged(p) == [p]:  # others can never come out of merging
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.most, self.pairs, self.segments = most, {}, {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging makes of the characters of a short string: best score first, then from the left."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        if len(self.pairs) >= self.most:
            self.pairs.clear()
        self.pairs[a, b] = known = self.merged(a + b) == [a, b]
        return known

    def split(self, segment: str) -> list[str]:
        """The pieces of a segment; characters that no piece has stand alone."""
        size = len(segment)
        ends: list[list[int]] = [[] for _ in range(size)]  # of the pieces from each place, shortest first
        for last, n in self.automaton.iter(segment):
            ends[last + 1 - n].append(last + 1)
        failed, path, taken, pos, k, before = 0, [], [], 0, 1, ""
        pairs, compatible = self.pairs, self.compatible
        while pos < size:
            here = ends[pos]
            if not here or here[0] != pos + 1:
                here.insert(0, pos + 1)
            for k in range(k, len(here) + 1):  # noqa: B020  from the k-th longest on
                end = here[-k]
                if failed >> end & 1:
                    continue
                piece = segment[pos:end]
                if not path or ((known := pairs.get((before, piece))) is None and compatible(before, piece)) or known:
                    path.append(piece)
                    taken.append(k)
                    pos, k, before = end, 1, piece
                    break
            else:
                failed |= 1 << pos
                pos, k = pos - len(path.pop()), taken.pop() + 1
                before = path[-1] if path else ""
        return path

    def _packed(self, segment: str) -> bytes:
        out: list[int] = []
        for p in self.split(segment):
            i = self.id.get(p)
            if i is None:
                out += [self.byte[b] for b in p.encode()]
            else:
                out.append(i)
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text, without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        # words between single blanks are segments when a blank is put in front of each
        parts = text.split(" ")
        known = self.segments
        new = set(parts).difference(known)
        if new and any(not p or BLANK in p for p in new):
            return b"".join(map(self._packed, _SEGMENT.findall(BLANK + text.replace(" ", BLANK))))
        if not new:
            return b"".join(map(known.__getitem__, parts))
        found = {p: self._packed(BLANK + p) for p in new}
        if len(known) < self.most:
            known.update((p, ids) for p, ids in found.items() if len(p) <= LONG)
        get = known.get
        return b"".join([found[p] if (x := get(p)) is None else x for p in parts])

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


@lru_cache(2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def piece_bytes(path: str) -> list[bytes]:
    """The bytes of each id: U+2581 stands for a blank, byte pieces for their byte; control pieces have none."""
    sp = sentencepiece_model(path)
    plain = lambda i: b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace(BLANK, " ").encode()
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else plain(i) for i in range(sp.get_piece_size())]


def _encoded(texts: list[str | None], model: str) -> Iterator[tuple[bytes, str]]:
    enc = piece_encoder(model)
    begin, end = np.array([enc.sp.bos_id()], "<u4").tobytes(), np.array([enc.sp.eos_id()], "<u4").tobytes()
    for text in texts:
        ids = begin + enc.encode(text) + end
        yield ids, enc.decode(np.frombuffer(ids, "<u4"))


def encoded_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers, with begin and end), decoded of docs(doc_id, text)."""

    def make() -> Callable[[list[str | None]], dict[str, object]]:
        def f(texts: list[str | None]) -> dict[str, object]:
            rows = list(_encoded(texts, model))
            return {"ids": [i for i, _ in rows], "decoded": [d for _, d in rows]}

        return f

    return per_text(docs.select("doc_id", "text"), make, "ids binary, decoded string", drop_text=True)


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests are taken in the task, so that ids and texts stay there."""

    def make() -> Callable[[list[str | None]], dict[str, object]]:
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def f(texts: list[str | None]) -> dict[str, object]:
            rows = [(len(ids) // 4, sha(ids), sha(decoded.encode())) for ids, decoded in _encoded(texts, model)]
            return {n: [r[k] for r in rows] for k, n in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

        return f

    return per_text(docs.select("doc_id", "text"), make, "n_tokens long, ids_sha256 string, decoded_sha256 string", drop_text=True)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))
