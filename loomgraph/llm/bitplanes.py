"""Operator 8, token-id output by plane shuffling.

A segment is one self-contained binary record: a header, a chunk index, a document table and
the chunks. A chunk holds at most `CHUNK` consecutive ids; they are transposed into byte
planes (plane k holds byte k of every id; or bit planes, with plane_bits=1) and each plane is
compressed with zstandard, all-zero planes taking no room. The chunk index gives each chunk's place and size, so that any id range
is read without the rest. Spark writes segments as a binary column in its own Parquet files:
they commit with the task, go to any file system and survive lost executors.

Layout, little-endian: b"BPL1", u16 plane bits (1 or 8), u16 planes, u32 chunks, u32 documents,
u64 ids; documents x (i64 doc_id, u8 null, u64 ids); chunks x (u64 place, u32 ids, planes x
u32 plane bytes); planes.

Defined results: a null or empty text has the end id alone; ids ascend by doc_id (null first),
equal ids by text; a document of any length is one entry, over as many chunks as it needs; an
empty table gives an empty table.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from loomgraph.llm.common import picked, scratch_dir, slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

CHUNK = 1 << 16
#: A segment closes at the end of the document that takes it over this many ids.
SEGMENT = 1 << 20
END_ID = 2
#: Words that a worker remembers.
CACHE = 1_000_000
_HEAD = struct.Struct("<4sHHIIQ")
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u8")])


def pack_chunk(ids: np.ndarray, plane_bits: int, n_planes: int) -> list[bytes]:
    """The compressed planes of a chunk, lowest first."""
    press = zstandard.ZstdCompressor(level=1)
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if plane_bits == 8:
        planes = np.ascontiguousarray(rows[:, :n_planes].T)
    else:
        rows = np.unpackbits(rows, axis=1, bitorder="little")[:, :n_planes]
        planes = np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little")
    return [press.compress(p.tobytes()) if p.any() else b"" for p in planes]


def unpack_chunk(planes: list[bytes], n: int, plane_bits: int) -> np.ndarray:
    press, size = zstandard.ZstdDecompressor(), -(-n * plane_bits // 8)
    raw = np.zeros((32 // plane_bits, size), np.uint8)
    for k, p in enumerate(planes):
        if p:
            raw[k] = np.frombuffer(press.decompress(p, max_output_size=size), np.uint8)
    if plane_bits == 8:
        return np.ascontiguousarray(raw.T).view("<u4").reshape(n)
    rows = np.ascontiguousarray(np.unpackbits(raw, axis=1, count=n, bitorder="little").T)
    return np.packbits(rows, axis=1, bitorder="little").view("<u4").reshape(n)


def pack_segment(docs: list[tuple[int | None, int]], ids: np.ndarray, plane_bits: int = 8) -> bytes:
    n_planes = max(1, -(-int(ids.max(initial=0)).bit_length() // plane_bits))
    table = np.array([(d or 0, d is None, n) for d, n in docs], _DOC)
    index, planes, place = [], [], 0
    for start in range(0, len(ids), CHUNK):
        part = ids[start : start + CHUNK]
        own = pack_chunk(part, plane_bits, n_planes)
        index.append(struct.pack(f"<QI{n_planes}I", place, len(part), *map(len, own)))
        planes += own
        place += sum(map(len, own))
    return b"".join([_HEAD.pack(b"BPL1", plane_bits, n_planes, len(index), len(docs), len(ids)), table.tobytes(), *index, *planes])


class Segment:
    """A segment's document table and chunk index; ids(start, end) decodes only the chunks it needs."""

    def __init__(self, data: bytes):
        magic, self.plane_bits, n_planes, chunks, docs, self.n = _HEAD.unpack_from(data)
        if magic != b"BPL1":
            raise ValueError("not a bit-plane segment")
        self.data, at = data, _HEAD.size
        table = np.frombuffer(data, _DOC, docs, at)
        self.doc_ids = [None if null else int(d) for d, null in zip(table["doc_id"], table["null"], strict=True)]
        self.lengths = table["ids"].astype(np.int64)
        entry = struct.Struct(f"<QI{n_planes}I")
        at += table.nbytes
        self.index = [entry.unpack_from(data, at + i * entry.size) for i in range(chunks)]
        self.base = at + chunks * entry.size

    def chunk(self, i: int) -> np.ndarray:
        place, n, *sizes = self.index[i]
        ends = np.cumsum([self.base + place, *sizes])
        return unpack_chunk([self.data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], n, self.plane_bits)

    def ids(self, start: int, end: int) -> np.ndarray:
        first, last = start // CHUNK, -(-end // CHUNK)
        parts = [self.chunk(i) for i in range(first, last)]
        joined = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return joined[start - first * CHUNK : end - first * CHUNK]


class _Words(dict):
    """Known words' ids as bytes; looking up an unknown one notes it."""

    def __init__(self) -> None:
        super().__init__()
        self.new: set[bytes] = set()
        self.missed = False

    def __missing__(self, word: bytes) -> bytes:
        self.new.add(word)
        self.missed = True
        return b""


@lru_cache(maxsize=2)
def _worker(path: str) -> tuple[Tokenizer, _Words, np.ndarray, bool]:
    """The tokenizer, the words known so far, which ids end a pre-token, and whether case is folded."""
    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
    folds = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("ABCXYZ") == "abcxyz"
    return tokenizer, _Words(), ends, folds


#: Words that are encoded as one text.
TOGETHER = 200


def _learn(words: list[bytes], tokenizer: Tokenizer, ends: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """The ids of each word, by the library.

    Words of Latin letters alone are one pre-token each, so that many go in as one text whose
    ids are cut after each pre-token's end; others are encoded one by one.
    """
    plain, rest = [], []
    for w in words:
        s = w.decode()
        (plain if s.isalpha() and max(s) < "\u0250" else rest).append((w, s))
    groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
    for group, coded in zip(groups, tokenizer.encode_batch_fast([" ".join(s for _, s in g) for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(coded.ids, "<u4")
        cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(cuts) == len(group) and cuts[-1] == 4 * len(ids):
            raw = ids.tobytes()
            yield from ((w, raw[a:b]) for (w, _), a, b in zip(group, [0, *cuts], cuts, strict=False))
        else:
            rest += group
    coded = tokenizer.encode_batch_fast([s for _, s in rest], add_special_tokens=False)
    yield from ((w, array("I", e.ids).tobytes()) for (w, _), e in zip(rest, coded, strict=True))


_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_STOP = np.isin(_BYTES, list(b".,;:!?"))


def _words_of(texts: list[bytes], folds: bool) -> list[list[bytes]]:
    """The words of each text, cut at ASCII white space and between a letter and a stop, where
    pre-tokens end; in lower case if the tokenizer folds it (but for special tokens, which it looks for first)."""
    if folds:
        texts = [t if b"<|" in t else t.lower() for t in texts]
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    cuts = np.flatnonzero(_LETTER[data[:-1]] & _STOP[data[1:]]) + 1
    raw, at = np.insert(data, cuts, 32).tobytes(), at + np.searchsorted(cuts, at)
    return [raw[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode_words(texts: list[bytes], path: str) -> list[bytes]:
    """Ids (little-endian u32) of each UTF-8 text.

    The tokenizer drops white space and no token reaches across it, so each word between
    ASCII spaces is encoded by the library once and looked up afterwards.
    """
    tokenizer, known, ends, folds = _worker(path)
    split = _words_of(texts, folds)
    out, again = [], []
    for i, tokens in enumerate(split):
        out.append(b"".join(map(known.__getitem__, tokens)))
        if known.missed:
            again.append(i)
            known.missed = False
    if known.new:
        new = list(known.new)
        for i in range(0, len(new), 20_000):
            known.update(_learn(new[i : i + 20_000], tokenizer, ends))
        known.new = set()
    for i in again:
        out[i] = b"".join(map(known.__getitem__, split[i]))
    if len(known) > CACHE:
        known.clear()
    return out


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every document, in ascending id order, into segments under `path`.

    Columns: part, seq (their order is the order of the ids), ids (how many) and payload. The texts are
    range-partitioned by id, so that one task holds one run of ids, and encoded afterwards.
    """

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, seq, held, ids, n = TaskContext.get().partitionId(), 0, [], [], 0

        def closed() -> pa.RecordBatch:
            payload = pack_segment(held, np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([part_id], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], ["part", "seq", "ids", "payload"])

        end = struct.pack("<I", end_id)
        for batch in batches:
            for run in slices(batch, most=1 << 20):
                texts = [(t or "").encode() for t in run.column("text").to_pylist()]
                for doc_id, coded in zip(run.column("doc_id").to_pylist(), encode_words(texts, tokenizer_path), strict=True):
                    held.append((doc_id, len(coded) // 4 + 1))
                    ids += [coded, end]
                    n += held[-1][1]
                    if n >= SEGMENT:
                        yield closed()
                        seq, held, ids, n = seq + 1, [], [], 0
        if held:
            yield closed()

    rows = picked(docs, doc_id=id_col, text=text_col)
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(segments, "part int, seq int, ids long, payload binary").write.option("compression", "none").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """part, seq, at (entry in its segment), doc_id, local_start, n_tokens, ids_crc32, read from the files."""
    names = ["part", "seq", "at", "doc_id", "local_start", "n_tokens", "ids_crc32"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, payload = (batch.column(k)[i].as_py() for k in range(3))
                segment = Segment(payload)
                ends = np.cumsum(segment.lengths)
                ids = segment.ids(0, segment.n)
                crc = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, segment.lengths, strict=True)]
                m = len(crc)
                values = [[part] * m, [seq] * m, range(m), segment.doc_ids, ends - segment.lengths, segment.lengths, crc]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    return spark.read.schema("part int, seq int, payload binary").parquet(path).mapInArrow(entries, "part int, seq int, at long, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def stored_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that hold its ids."""
    spark = docs.sparkSession
    path = scratch_dir(spark)
    write_ids(docs, path, tokenizer_path, id_col, text_col)
    entries = read_ids(spark, path)
    # One row per segment of a million ids; parts first, so that each window holds one part or one row a part.
    heads = spark.read.schema("part int, seq int, ids long").parquet(path).withColumnRenamed("ids", "n")
    in_part = heads.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n"))
    parts = heads.groupBy("part").agg(F.sum("n").alias("total"))
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_start"))
    starts = in_part.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("before")).alias("offset"))
    return entries.join(starts, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
