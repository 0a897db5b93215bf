"""Operator 12, alignment of two tokenizers' tokens, over Arrow batches.

A is a byte-level BPE by its rank file (space + text; operator 5's encoder), B a sentencepiece model
(text; it puts a space in front itself). Token ids are flattened with their documents as parent
indices; cumulative byte lengths, less those before the document, give each token's end; an Acero
hash join on (document, end) finds the ends that both have, and the running count of these numbers
the groups. Tokens are linked if their ranges share a group. Links of a document are kept as distinct
id pairs with their times in one scratch table. Pair counts (documents that hold the pair linked) are
partial Table.group_by counts, summed by Spark. Each document's links then meet the counts: those of
the most frequent pairs (at most `HEAD` rows) by a broadcast, the others, each in few documents, by a
shuffle.

Defined results: a text that is null or empty, or whose tokens' joined bytes of A or B differ from
space + text (a U+2581 in it, for one), has no tokens, all numbers 0 and the digest ''; repeated rows and null
ids are documents of their own; best counts include ties; an empty table gives an empty table; other columns
are not read. Texts are coded whole; memory follows the longest text, and links of a group of many
tokens are made in blocks of `PAIRS`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import byte_bpe
from loomgraph.llm.common import Scratch, buffers, slices

#: Pairs whose counts are broadcast, at most.
HEAD = 1 << 19
#: Links that are made at once, about; a group of more than `WIDE` of them is reduced to distinct ids first.
PAIRS, WIDE = 1 << 21, 1 << 12
#: Distinct pairs that a task counts before it hands them on.
COUNTED = 1 << 21
BYTES = 1 << 20


class Vocabulary(NamedTuple):
    """Bytes, byte lengths and decimal names of all ids."""

    pieces: pa.Array
    lengths: np.ndarray
    names: pa.Array


def vocabulary(pieces: list[bytes]) -> Vocabulary:
    return Vocabulary(pa.array(pieces, pa.binary()), np.array([len(p) for p in pieces], np.int64), pa.array([str(i) for i in range(len(pieces))]))


@lru_cache(maxsize=2)
def rank_vocabulary(path: str, pattern: str) -> Vocabulary:
    enc = byte_bpe.encoding(path, pattern)
    return vocabulary([enc.decode_single_token_bytes(i) for i in range(enc.max_token_value + 1)])


@lru_cache(maxsize=2)
def piece_model(path: str):
    """The model and its vocabulary: U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, vocabulary([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])


def _joined(ids: pa.ListArray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens, and the offsets of the documents in them."""
    flat = ids.flatten()
    data, _ = buffers(words.pieces.take(flat).cast(pa.large_binary()))
    ends = np.concatenate([[0], np.cumsum(words.lengths[flat.to_numpy()])])
    return data, ends[ids.offsets.to_numpy()]


def _equal(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each document, whether the bytes are the same."""
    (a, a_at), (b, b_at) = x, y
    if np.array_equal(a_at, b_at) and np.array_equal(a, b):
        return np.ones(len(a_at) - 1, bool)
    return np.array([np.array_equal(a[i:j], b[k:m]) for i, j, k, m in zip(a_at[:-1], a_at[1:], b_at[:-1], b_at[1:], strict=True)], bool)


def token_ends(ids: pa.ListArray, lengths: np.ndarray) -> pa.Table:
    """doc, end and place of every token: bytes of its document up to its end, by a segmented cumulative sum."""
    doc, flat = pc.list_parent_indices(ids), pc.list_flatten(ids)
    ends = pc.cumulative_sum(pa.array(lengths[flat.to_numpy()]))
    before = np.concatenate([[0], ends.to_numpy()])[ids.offsets.to_numpy()[:-1]]
    return pa.table({"doc": doc, "end": pc.subtract(ends, pa.array(before).take(doc)), "place": pa.array(np.arange(len(flat)))})


def _groups(places: np.ndarray, n: int) -> np.ndarray:
    """The number of closing tokens before each of n tokens."""
    closes = np.zeros(n, np.int64)
    closes[places] = 1
    return np.cumsum(closes) - closes


def _linked(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, times_a: np.ndarray, times_b: np.ndarray) -> Iterator[pa.Table]:
    """group, a, b and times of all pairs within groups, in blocks: an Acero join on the group."""
    right = pa.table({"group": group_b, "b": b, "y": times_b})
    partners = np.bincount(group_b, minlength=int(group_a[-1]) + 1 if len(group_a) else 0)[group_a]
    made = np.cumsum(partners)
    start = 0
    while start < len(group_a):
        end = max(start + 1, int(np.searchsorted(made, (made[start - 1] if start else 0) + PAIRS, side="right")))
        left = pa.table({"group": group_a[start:end], "a": a[start:end], "x": times_a[start:end]})
        low, high = np.searchsorted(group_b, [group_a[start], group_a[end - 1] + 1])
        found = left.join(right.slice(low, high - low), "group", join_type="inner", use_threads=False)
        yield found.append_column("times", pc.multiply(found["x"], found["y"])).select(["group", "a", "b", "times"])
        start = end


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of each group and their times, by group."""
    found = pa.table({"group": group, "id": ids}).group_by(["group", "id"], use_threads=False).aggregate([([], "count_all")]).sort_by("group")
    return found["group"].to_numpy(), found["id"].to_numpy(), found["count_all"].to_numpy()


def document_pairs(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, doc: np.ndarray, radix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, pair (a x radix + b) and times of all links, distinct and ascending; doc: of each group."""
    n_a, n_b = np.bincount(group_a, minlength=len(doc)), np.bincount(group_b, minlength=len(doc))
    single, wide = (n_a == 1) & (n_b == 1), n_a * n_b > WIDE
    space = radix * (int(a.max(initial=0)) + 1)
    mine, other = single[group_a], single[group_b]
    keys = [doc[group_a[mine]] * space + a[mine] * radix + b[other]]
    times: list[np.ndarray] = [np.ones(len(keys[0]), np.int64)]
    for chosen, reduced in ((~single & ~wide, False), (wide, True)):
        if not chosen.any():
            continue
        mine, other = chosen[group_a], chosen[group_b]
        if reduced:
            (ga, ia, ta), (gb, ib, tb) = _distinct(group_a[mine], a[mine]), _distinct(group_b[other], b[other])
        else:
            ga, ia, gb, ib = group_a[mine], a[mine], group_b[other], b[other]
            ta, tb = np.ones(len(ga), np.int64), np.ones(len(gb), np.int64)
        for part in _linked(ga, ia, gb, ib, ta, tb):
            key = doc[part["group"].to_numpy()] * space + part["a"].to_numpy() * radix + part["b"].to_numpy()
            # Partial sums keep blocks of a wide group small.
            own = pa.table({"key": key, "times": part["times"]}).group_by("key", use_threads=False).aggregate([("times", "sum")])
            keys.append(own["key"].to_numpy())
            times.append(own["times_sum"].to_numpy())
    found = pa.table({"key": np.concatenate(keys), "times": np.concatenate(times)}).group_by("key", use_threads=False).aggregate([("times", "sum")])
    key, total = found["key"].to_numpy(), found["times_sum"].to_numpy()
    order = np.argsort(key)
    key, total = key[order], total[order]
    return key // space, key % space, total


def _texts(offsets: np.ndarray, texts: pa.Array, by: str) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), texts), by)


def _blanked(ids: pa.ListArray, valid: np.ndarray) -> pa.ListArray:
    """ids, with empty lists where not valid."""
    lengths = np.diff(ids.offsets.to_numpy())
    flat = ids.flatten().filter(pa.array(np.repeat(valid, lengths)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths * valid)]), pa.int32()), flat)


def align(texts: list[str], rank_path: str, pattern: str, model_path: str) -> dict[str, object]:
    """n_a, n_b, n_groups, n_links and groups of each text, and the pairs and times of all, with offsets."""
    enc, (model, words_b) = byte_bpe.encoding(rank_path, pattern), piece_model(model_path)
    words_a = rank_vocabulary(rank_path, pattern)
    kind = pa.list_(pa.int32())
    ids_a = pa.array([[i for part in byte_bpe.encode(f" {t}", enc) for i in part] if t else [] for t in texts], kind)
    ids_b = pa.array(model.encode(texts, num_threads=1), kind)
    expected = pa.array([f" {t}" if t else "" for t in texts])
    whole = buffers(expected)
    valid = _equal(_joined(ids_a, words_a), whole) & _equal(_joined(ids_b, words_b), whole)
    if not valid.all():
        ids_a, ids_b = _blanked(ids_a, valid), _blanked(ids_b, valid)

    n = len(texts)
    ends_a, ends_b = token_ends(ids_a, words_a.lengths), token_ends(ids_b, words_b.lengths)
    common = ends_a.join(ends_b, ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False).sort_by("place")
    a, b = ids_a.flatten().to_numpy().astype(np.int64), ids_b.flatten().to_numpy().astype(np.int64)
    group_a, group_b = _groups(common["place"].to_numpy(), len(a)), _groups(common["place_b"].to_numpy(), len(b))
    doc = common["doc"].to_numpy().astype(np.int64)
    g = len(doc)
    size_a, size_b = np.bincount(group_a, minlength=g), np.bincount(group_b, minlength=g)
    at = np.searchsorted(doc, np.arange(n + 1))
    links = np.concatenate([[0], np.cumsum(size_a * size_b)])

    text_a = _texts(np.concatenate([[0], np.cumsum(size_a)]), words_a.names.take(pa.array(a)), ",")
    text_b = _texts(np.concatenate([[0], np.cumsum(size_b)]), words_b.names.take(pa.array(b)), ",")
    groups = _texts(at, pc.binary_join_element_wise(text_a, text_b, "|"), ";")
    pair_doc, pairs, times = document_pairs(group_a, a, group_b, b, doc, len(words_b.lengths))
    return {
        "n_a": np.diff(ids_a.offsets.to_numpy()), "n_b": np.diff(ids_b.offsets.to_numpy()), "n_groups": np.diff(at), "n_links": links[at[1:]] - links[at[:-1]],
        "groups": groups, "pair_at": np.searchsorted(pair_doc, np.arange(n + 1)), "pairs": pairs, "times": times,
    }


def alignments(docs: DataFrame, rank_path: str, pattern: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (its place in the input), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the links: pairs and their times."""
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def aligned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=BYTES):
                found = align([t or "" for t in part.column("text").to_pylist()], rank_path, pattern, model_path)
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found["groups"].to_pylist()]
                lists = [pa.ListArray.from_arrays(pa.array(found["pair_at"], pa.int32()), pa.array(found[c], pa.int64())) for c in ("pairs", "times")]
                numbers = [pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *numbers, pa.array(digests, pa.string()), *lists], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shape = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"
    return rows.mapInArrow(aligned, shape)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair and n: in how many documents it is linked. Tasks count partly, Spark adds up."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            return pa.concat_tables(parts).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        for batch in batches:
            flat = pa.table({"pair": pc.list_flatten(batch.column("pairs"))})
            parts.append(flat.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"]))
            size += parts[-1].num_rows
            if size > 2 * COUNTED:
                parts = [merged()]
                size = parts[0].num_rows
                if size > COUNTED:
                    yield from parts[0].combine_chunks().to_batches(1 << 16)
                    parts, size = [], 0
        if parts:
            yield from merged().combine_chunks().to_batches(1 << 16)

    return found.select("pairs").mapInArrow(counted, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def aligned_documents(docs: DataFrame, rank_path: str, pattern: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    scratch = Scratch(docs.sparkSession)
    radix = len(piece_model(model_path)[1].lengths)
    found = scratch.keep(alignments(docs, rank_path, pattern, model_path, id_col, text_col), compression="zstd")
    counts = scratch.keep(pair_counts(found))
    # One row for each id of A at most.
    best = counts.groupBy(F.expr(f"pair div {radix}").alias("a")).agg(F.max("n").alias("best"))
    ranked = counts.withColumn("a", F.expr(f"pair div {radix}")).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))

    # Counts of 2^level and more are broadcast: the lowest level that few enough pairs reach.
    log = F.floor(F.log2("n") + 1e-9).cast("int")
    by_level = dict(counts.groupBy(log.alias("level")).agg(F.count("*").alias("pairs")).collect())
    level = next(k for k in range(65) if sum(v for x, v in by_level.items() if x >= k) <= HEAD)
    often = F.col("n") >= F.lit(1 << min(level, 62))
    links = found.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    head = ranked.filter(often)
    sums = [F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    parts = links.join(F.broadcast(head), "pair").groupBy("row").agg(*sums)
    if level:
        rare = links.join(F.broadcast(head.select("pair")), "pair", "left_anti").join(ranked.filter(~often), "pair").groupBy("row").agg(*sums)
        parts = parts.union(rare)
    totals = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return found.join(totals, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
