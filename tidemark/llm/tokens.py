"""Tokenizers: exact ids of whole texts, packed as little-endian integers.

`byte_level_encoder` uses the rank form of a byte-level vocabulary, which gives the ids of its JSON form several times
as fast. `WordEncoder` runs the JSON file's own BPE model on the pieces of a text and keeps what it has encoded in
tables that take entries until they are full: frequent words come early, and the rare rest is encoded each time."""

from __future__ import annotations

import base64
import json
import os
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Most chunks that a Python worker keeps, and the most characters of one (about 200 bytes each, then).
MOST, LONG = 400_000, 64


@lru_cache(4)
def sentencepiece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(4)
def json_tokenizer(path: str, special: bool = True):
    """special: whether special strings in a text are special tokens."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = not special
    return tok


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> dict[str, int]:
    return {t.content: i for i, t in json_tokenizer(path).get_added_tokens_decoder().items()}


@lru_cache(4)
def byte_level_encoder(path: str, ranks_path: str, special: bool = True) -> Callable[[str], np.ndarray]:
    """Ids as the tokenizers library gives them for `path`, without added tokens; special strings in a text are
    special tokens, as is its default, or plain text."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    enc = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path) if special else {})

    def encode(text: str) -> np.ndarray:
        try:
            return enc.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the pattern overflows its stack on some 10**6 white-space characters in a row
            return np.array(json_tokenizer(path, special).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; special tokens have none."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = {c: b for b, c in _byte_letters().items()}
    out = [b""] * (max([*vocab.values(), *added_tokens(path).values()]) + 1)
    for shown, i in vocab.items():
        out[i] = bytes(map(byte.__getitem__, shown))
    return out


class WordEncoder:
    """BPE with word ends, lower case, white space dropped: no token spans a blank, so chunks between blanks are
    encoded apart. Pieces of a chunk come from the tokenizer file's own pattern, their ids from its own model."""

    def __init__(self, path: str, dtype: str = "<u2", most: int = MOST):
        import regex

        self.tok, self.dtype, self.most = json_tokenizer(path), np.dtype(dtype), most
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = list(added_tokens(path))
        self.table = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.table)
            got = np.array([t.id for t in self.tok.model.tokenize(shown)], self.dtype).tobytes()
            if len(self.pieces) < self.most // 4 and len(piece) <= LONG:
                self.pieces[piece] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            low = chunk.lower()
            if low.isalpha():
                return self._piece(low)
        else:
            low = "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))
        if "<" in chunk and any(s in chunk for s in self.special):
            return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self._piece, self.find(low)))

    def encode(self, text: str | None) -> bytes:
        parts = (text or "").split(" ")
        new = set(parts).difference(self.chunks)
        if not new:
            return b"".join(map(self.chunks.__getitem__, parts))
        found = {p: self._chunk(p) for p in new}
        if len(self.chunks) < self.most:
            self.chunks.update((p, ids) for p, ids in found.items() if len(p) <= LONG)
        get = self.chunks.get
        return b"".join([found[p] if (x := get(p)) is None else x for p in parts])


@lru_cache(4)
def word_encoder(path: str, dtype: str = "<u2") -> WordEncoder:
    return WordEncoder(path, dtype)
