"""Operator 3, token counts: rank-synchronous merging over ragged numpy arrays.

The operator counts what a score-ranked BPE piece model with byte fallback makes of a text.
A text becomes its pre-tokens: runs of the space mark with the word after them, and line
breaks; no piece of the vocabulary reaches over such a border, which `Pieces` checks. New
pre-tokens of a batch are laid out as one ragged array of symbols; in every round each
sequence merges its best-scored (then leftmost) adjacent pair, all sequences at once, until
none has a pair left. Surviving symbols count one each, characters outside the vocabulary
their UTF-8 bytes. Counts are kept per worker in a bounded table, as words repeat.

Defined results: a null or empty text has 0 tokens; rows are counted one by one (repeated
rows and null ids give the same); sequences of over `LONG` symbols are merged by a heap in
the same order, so that very long words stay cheap; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import buffers, picked, slices

#: The character that stands for a space.
MARK = "▁"
LONG = 1024
#: Symbols that are merged together, and up to LONG more: under 2^22, as positions have 22 bits.
GROUP = 1 << 20
#: Pre-tokens that a worker remembers.
CACHE = 1_000_000
#: The count over which a document is marked as over the limit.
LIMIT = 4096
_NO_PAIR = np.int64(1) << 40


class Pieces:
    """Symbols, pair ranks and weights of a piece model."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {sp.id_to_piece(i): i for i in normal}
        if any(MARK in piece.lstrip(MARK) or "\n" in piece for piece in ids):
            raise ValueError("pieces of this model reach over the borders of pre-tokens")
        scores = np.array([-sp.get_score(i) for i in range(n)])
        rank = np.searchsorted(np.unique(scores[normal]), scores)
        self.unknown = n  # n + k: a character of k bytes outside the vocabulary
        self.weight = np.concatenate([np.ones(n, np.int64), np.arange(5)])
        self.symbol = np.full(0x110000, -1, np.int64)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pair.tolist()], np.int64)
        self.rank = rank[self.merged].astype(np.int64)
        self.by_pair = {k: (int(r), int(m)) for k, r, m in zip(self.pair.tolist(), self.rank, self.merged, strict=True)}

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; _NO_PAIR where there is none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.rank[at], _NO_PAIR), self.merged[at]

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        found = self.symbol[points]
        size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        return np.where(found < 0, self.unknown + size, found)

    def count(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token (none is empty)."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        out = np.zeros(len(tokens), np.int64)
        for i in np.flatnonzero(lengths > LONG):
            out[i] = self._count_long(self.symbols(tokens[i]).tolist())
        short = np.flatnonzero(lengths <= LONG)
        if len(short):
            block = (np.cumsum(lengths[short]) - 1) // GROUP
            for part in np.split(short, np.flatnonzero(np.diff(block)) + 1):
                out[part] = self._count_rounds(self.symbols("".join(tokens[i] for i in part)), lengths[part])
        return out

    def _count_rounds(self, sym: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lengths), np.int64)
        seq = np.repeat(np.arange(len(lengths)), lengths)
        rank, into = np.full(len(sym), _NO_PAIR), np.zeros(len(sym), np.int64)

        def look(at: np.ndarray) -> None:
            """Set rank and merged symbol of the pairs that begin at these places."""
            at = at[(at >= 0) & (at < len(sym))]
            inner = at[at + 1 < len(sym)]
            inner = inner[seq[inner] == seq[inner + 1]]
            rank[at] = _NO_PAIR
            rank[inner], into[inner] = self.find(sym[inner], sym[inner + 1])

        look(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank << 22 | np.arange(len(sym)), starts)
            going = best >> 22 < _NO_PAIR
            sizes = np.diff(np.r_[starts, len(sym)])
            if not going.all():  # these have no pair left
                stay = np.repeat(going, sizes)
                np.add.at(out, seq[~stay], self.weight[sym[~stay]])
                place = np.cumsum(stay) - 1
                left = place[best[going] & ((1 << 22) - 1)]
                sym, seq, rank, into = sym[stay], seq[stay], rank[stay], into[stay]
            else:
                left = best & ((1 << 22) - 1)
            if not len(left):
                break
            sym[left] = into[left]
            keep = np.ones(len(sym), bool)
            keep[left + 1] = False
            place = np.cumsum(keep) - 1
            sym, seq, rank, into = sym[keep], seq[keep], rank[keep], into[keep]
            left = place[left]
            look(np.concatenate([left, left - 1]))
        return out

    def _count_long(self, sym: list[int]) -> int:
        """The same merges in the same order, from a heap of pairs."""
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (hit := self.by_pair.get(sym[i] << 20 | sym[j])):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[j]))

        for i in range(n - 1):
            push(i)
        alive = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i] = self.by_pair[a << 20 | b][1]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return sum(int(self.weight[s]) for s, live in zip(sym, alive, strict=True) if live)


class _Counts(dict):
    """Known counts; looking up an unknown pre-token notes it and gives 0."""

    def __init__(self) -> None:
        super().__init__()
        self.new: set[str] = set()

    def __missing__(self, token: str) -> int:
        self.new.add(token)
        return 0


@lru_cache(maxsize=2)
def _worker(path: str) -> tuple[Pieces, _Counts]:
    return Pieces(path), _Counts()


_PRE_TOKEN = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")


def count_texts(texts: list[str], path: str) -> list[int]:
    pieces, known = _worker(path)
    split = [_PRE_TOKEN.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    for tokens in split:
        deque(map(known.__getitem__, tokens), maxlen=0)
    if known.new:
        new = list(known.new)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            known.update(zip(part, pieces.count(part).tolist(), strict=True))
        known.new = set()
    out = [sum(map(known.__getitem__, tokens)) for tokens in split]
    if len(known) > CACHE:
        known.clear()
    return out


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                _, at = buffers(part.column("text"))
                n = count_texts([t or "" for t in part.column("text").to_pylist()], model_path)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = picked(docs, doc_id=id_col, text=text_col).mapInArrow(counted, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
