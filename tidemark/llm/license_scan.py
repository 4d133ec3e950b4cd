"""License scans by template markup: optional and replaceable regions compiled into token automata.

A template is text with two kinds of markup. <<optional>> ... <<end>> may be left out; <<any:N>> stands for up to
N words of any kind. All other words are mandatory and must stand exactly, in order. A template is compiled into
an automaton whose states are positions between its parts; optional regions become empty moves, a replaceable
region a counter of words. A text is scanned from each place where the template's anchor stands (the first
mandatory words, which every accepted run starts with); the longest accepted run counts.

Words are runs of digits, letters a-z (after lower-casing A-Z) and non-ASCII characters; all else separates.

Base result: the places of a few fixed phrases. The templates add labels of their own. `score` is the share of
the text's words that lie in a phrase or an accepted run.

Edge cases: null and empty texts have no words, no labels ('' in both columns), null places and score 0;
overlapping places all count; repeated rows are scanned alike; columns other than doc_id and text are ignored."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import per_text, table

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<any:12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
_BSD_AS_IS = "this software is provided by <<any:12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
# Templates of license notices and texts, and their labels; of several templates one has to match.
TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "apache-2.0": "licensed under <<optional>> the <<end>> apache license <<optional>> version <<end>> 2.0",
    "apache-2.0-notice": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "bsd-2-clause": _BSD + _BSD_AS_IS,
    "bsd-3-clause": _BSD + "<<optional>> 3 <<end>> neither the name of <<any:12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_AS_IS,
    "cc-by-4.0": "licensed under <<optional>> a <<optional>> creative commons <<end>> <<end>> cc by 4.0",
    "cc-by-nc-4.0": "licensed under <<optional>> a <<end>> cc by nc <<optional>> 4.0 <<end>>",
    "cc-by-nc-sa": "licensed under <<optional>> a <<end>> cc by nc sa <<optional>> <<any:2>> <<end>>",
    "cc-by-sa": "licensed under <<optional>> a <<end>> cc by sa <<optional>> <<any:2>> <<end>>",
    "copyright-notice": "copyright <<optional>> c <<end>> <<any:12>> all rights reserved",
    "gpl-2.0": "<<optional>> licensed <<end>> under the <<optional>> terms of the <<end>> gnu general public license <<optional>> as published by the free software foundation <<end>> <<optional>> either <<end>> version 2 <<optional>> of the license <<end>>",
    "gpl-3.0": "<<optional>> licensed <<end>> under the <<optional>> terms of the <<end>> gnu general public license <<optional>> as published by the free software foundation <<end>> <<optional>> either <<end>> version 3 <<optional>> of the license <<end>>",
    "isc": "permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<any:12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<any:12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "lgpl": ("gnu lesser general public license", "gnu library general public license", "gnu <<optional>> lesser <<end>> <<optional>> library <<end>> general public license <<any:6>> lgpl"),
    "mit": "<<optional>> released <<end>> <<optional>> licensed <<end>> under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software " + _AS_IS,
    "mpl-2.0": "subject to the terms of the mozilla public license v 2.0",
    "public-domain": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law " + _AS_IS,
}

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_MARK = re.compile(r"<<(optional|end|any:\d+)>>")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass(frozen=True)
class Automaton:
    """State k stands before part k; the last state accepts. parts: a word, or the most words of a region.
    skips[k]: states reached from k without a word. anchors: the words that an accepted run can start with."""

    parts: tuple[bytes | int, ...]
    skips: dict[int, tuple[int, ...]]
    anchors: tuple[bytes, ...]

    def reached(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skips.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def end(self, words: list[bytes], at: int) -> int:
        """Where the longest accepted run from word `at` ends, or -1."""
        last, found, k = len(self.parts), -1, at
        now = {(s, 0) for s in self.reached({0})}  # state and words taken in its region
        while now:
            if any(s == last for s, _ in now):
                found = k
            if k == len(words):
                break
            then: set[tuple[int, int]] = set()
            for s, taken in now:
                if s == last:
                    continue
                part = self.parts[s]
                if isinstance(part, int):
                    if taken < part:
                        then.add((s, taken + 1))
                        then.update((t, 0) for t in self.reached({s + 1}))
                elif part == words[k]:
                    then.update((t, 0) for t in self.reached({s + 1}))
            now, k = then, k + 1
        return found


def compiled(template: str) -> Automaton:
    parts: list[bytes | int] = []
    skips: dict[int, list[int]] = {}
    opened: list[int] = []
    for i, piece in enumerate(_MARK.split(template)):
        if i % 2 == 0:
            parts += words_of(piece)
        elif piece == "optional":
            opened.append(len(parts))
        elif piece == "end":
            skips.setdefault(opened.pop(), []).append(len(parts))
        else:
            skips.setdefault(len(parts), []).append(len(parts) + 1)
            parts.append(int(piece[4:]))
    if opened:
        raise ValueError(f"an optional region isn't closed: {template}")
    out = Automaton(tuple(parts), {k: tuple(v) for k, v in skips.items()}, ())
    starts = {parts[s] for s in out.reached({0}) if s < len(parts)}
    if len(parts) in out.reached({0}) or any(isinstance(p, int) for p in starts):
        raise ValueError(f"a template must start with a word: {template}")
    return Automaton(out.parts, out.skips, tuple(sorted(starts)))


def _places(flat: bytes, needle: bytes) -> Iterator[int]:
    """The words at which needle (with a blank on either side) stands in flat, in one pass."""
    at, last, word = flat.find(needle), 0, 0
    while at >= 0:
        word += flat.count(b" ", last, at)
        yield word
        last, at = at, flat.find(needle, at + 1)


def _union(spans: list[tuple[int, int]]) -> int:
    """Words in spans (start, end), each counted once."""
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def scan(text: str | None, phrases: dict[bytes, str], automata: dict[tuple[str, int], Automaton], seeds: dict[tuple[str, int], tuple[bytes, ...]]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = words_of(text)
    flat = b" " + b" ".join(words) + b" "
    base, labels, spans, n, first, last = set(), set(), [], 0, None, None
    add = lambda a, b: spans.__setitem__(-1, (spans[-1][0], b)) if spans and spans[-1][0] <= a <= spans[-1][1] <= b else spans.append((a, b))
    for phrase, label in phrases.items():
        size = phrase.count(b" ") - 1
        for start in _places(flat, phrase):
            n += 1
            first, last = start if first is None else min(first, start), start if last is None else max(last, start)
            add(start, start + size)
            base.add(label)
    for (label, k), automaton in automata.items():
        if all(x in flat for x in seeds[label, k]):
            for word in automaton.anchors:
                for start in _places(flat, b" " + word + b" "):
                    if (end := automaton.end(words, start)) >= 0:
                        labels.add(label)
                        add(start, end)
    return (len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), round(_union(spans) / len(words), 6) if words else 0.0)


NEW = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str | tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs(doc_id, text)."""
    known = {b" " + b" ".join(words_of(p)) + b" ": label for p, label in (phrases or PHRASES).items()}
    automata = {(label, n): compiled(t) for label, own in (templates or TEMPLATES).items() for n, t in enumerate([own] if isinstance(own, str) else own)}
    # a text without the longest mandatory words that no skip can pass over can't match
    seeds = {}
    for label, a in automata.items():
        free = {k for s, ends in a.skips.items() for e in ends for k in range(s, e)}
        seeds[label] = tuple(sorted((b" " + p + b" " for k, p in enumerate(a.parts) if k not in free and not isinstance(p, int)), key=len)[-2:])

    def make() -> Callable[[list[str | None]], dict[str, object]]:
        return lambda texts: dict(zip(NEW, zip(*[scan(t, known, automata, seeds) for t in texts], strict=True) if texts else [()] * len(NEW), strict=True))

    return per_text(docs.select("doc_id", "text"), make, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", drop_text=True)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
