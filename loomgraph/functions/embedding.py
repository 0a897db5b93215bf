"""Hash embeddings of texts over Arrow batches: a row's non-zero cells, made inside the row."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = "struct<cells: array<struct<idx: bigint, value: bigint>>, norm: double>"
#: Tokens whose cells a worker remembers.
REMEMBERED = 1 << 18


class Cells:
    """Index and sign of tokens, as sha256 gives them: bytes 0 to 3 modulo dim, the parity of byte 4."""

    def __init__(self, pattern: str, dim: int):
        self.find, self.dim = re.compile(pattern).findall, dim
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, token: str) -> tuple[int, int]:
        found = self.known.get(token)
        if found is None:
            digest = hashlib.sha256(token.encode()).digest()
            found = int.from_bytes(digest[:4], "big") % self.dim, 1 - 2 * (digest[4] % 2)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[token] = found
        return found

    def embed(self, text: str | None) -> dict[str, object]:
        sums: dict[int, int] = defaultdict(int)
        for token, n in Counter(self.find(text or "")).items():
            idx, sign = self.of(token)
            sums[idx] += sign * n
        cells = [{"idx": i, "value": v} for i, v in sums.items() if v]
        return {"cells": cells, "norm": math.sqrt(sum(v * v for v in sums.values()))}


def embedding(lowered: Column, pattern: str, dim: int) -> Column:
    """struct<cells, norm> of a lower-cased text: signed counts of its tokens by cell, and their length."""
    kind = pa.struct([("cells", pa.list_(pa.struct([("idx", pa.int64()), ("value", pa.int64())]))), ("norm", pa.float64())])
    cells = Cells(pattern, dim)

    @F.arrow_udf(_SHAPE)
    def embed(texts: pa.Array) -> pa.Array:
        return pa.array([cells.embed(t) for t in texts.to_pylist()], kind)

    return embed(lowered)
