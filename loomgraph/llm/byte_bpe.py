"""Operator 5, byte-level BPE with the tiktoken library and a local rank file.

Long texts are split beforehand where no match of the pattern can reach across: before a
space or line break that follows a letter or digit, as white space only ever opens a match.
Decoding joins the raw bytes of the ids, so that any id sequence decodes without loss.

Defined results: a null or empty text has no tokens; rows are coded one by one (repeated
rows and null ids give the same); an empty table gives an empty table; special strings in a
text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from loomgraph.llm.common import picked, slices

#: Longest piece, in characters, that is handed to the encoder at once where a border allows.
PIECE = 1 << 16
_BORDER = re.compile(r"(?<=[0-9A-Za-z])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in parts of at most `most` characters, or up to the next safe border."""
    start = 0
    while len(text) - start > most:
        border = _BORDER.search(text, start + most)
        if border is None:
            break
        yield text[start : border.start()]
        start = border.start()
    yield text[start:]


def encode(text: str, enc: tiktoken.Encoding) -> Iterator[list[int]]:
    for part in pieces(text):
        if part:
            yield enc.encode_ordinary(part)


def decode(ids: list[int], enc: tiktoken.Encoding) -> bytes:
    return enc.decode_bytes(ids)


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the token ids of every document."""

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                ids = [[i for piece in encode(t or "", enc) for i in piece] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return picked(docs, doc_id=id_col, text=text_col).mapInArrow(coded, "doc_id bigint, ids array<int>")


def decode_ids(coded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded: the raw bytes of every id list (null ids: none)."""

    def raw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = [decode(ids or [], enc) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return picked(coded, doc_id=id_col, ids=ids_col).mapInArrow(raw, "doc_id bigint, decoded binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded, its ids decoded again."""

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                n_tokens, ids_sha, decoded_sha = [], [], []
                for text in part.column("text").to_pylist():
                    n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in encode(text or "", enc):
                        n += len(ids)
                        a.update(np.array(ids, "<u4").tobytes())
                        b.update(decode(ids, enc))
                    n_tokens.append(n)
                    ids_sha.append(a.hexdigest())
                    decoded_sha.append(b.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return picked(docs, doc_id=id_col, text=text_col).mapInArrow(digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
