"""Dictionary mentions by one Aho-Corasick automaton over Arrow batches.

An alias matches as a whole word, without regard to ASCII case; a space in it stands for any run of
white space, - and _. The text is lower-cased and such runs become one space, then all aliases are
found in one pass; the signs beside a hit decide whether it is a whole word. An alias that has - or _
itself is looked up again by its pattern, as there only that sign counts.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_RUNS = re.compile(r"[ \t\n\x0b\f\r\-_]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_SHAPE = "array<struct<label: string, canonical: string>>"

Rows = tuple[tuple[str, str, tuple[str, ...]], ...]


class Matcher:
    """Finds which entries (label, canonical, aliases) a text mentions, sorted."""

    def __init__(self, entries: Rows):
        self.pairs = [{"label": label, "canonical": canonical} for label, canonical, _ in entries]
        self.order = sorted(range(len(entries)), key=lambda i: entries[i][:2])
        keys: dict[str, list[tuple[int, re.Pattern | None]]] = {}
        for i, (_, _, aliases) in enumerate(entries):
            for alias in aliases:
                words = alias.translate(_LOWER).split(" ")
                exact = None
                if _RUNS.search("".join(words)):
                    exact = re.compile(f"(?<![a-z0-9]){r'[ \t\n\x0b\f\r\-_]+'.join(map(re.escape, words))}(?![a-z0-9])")
                keys.setdefault(_RUNS.sub(" ", " ".join(words)), []).append((i, exact))
        self.machine = ahocorasick.Automaton()
        for key, owners in keys.items():
            self.machine.add_word(key, (len(key), owners))
        if keys:
            self.machine.make_automaton()

    def find(self, text: str | None) -> list[dict[str, str]]:
        if text is None:
            return []
        low = text.translate(_LOWER)
        plain, found = _RUNS.sub(" ", low), set()
        if len(self.machine):
            for end, (n, owners) in self.machine.iter(plain):
                start = end - n
                if (start >= 0 and plain[start] in _WORD) or (end + 1 < len(plain) and plain[end + 1] in _WORD):
                    continue
                found.update(i for i, exact in owners if i not in found and (exact is None or exact.search(low)))
        return [self.pairs[i] for i in self.order if i in found]


@lru_cache(maxsize=8)
def matcher(entries: Rows) -> Matcher:
    return Matcher(entries)


def mentions(text: Column, entries: Rows) -> Column:
    """array<struct<label, canonical>> of a text column, sorted; empty for a null text."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("canonical", pa.string())]))

    @F.arrow_udf(_SHAPE)
    def found(texts: pa.Array) -> pa.Array:
        find = matcher(entries).find
        return pa.array([find(t) for t in texts.to_pylist()], kind)

    return found(text)
