"""Operator 6, n-gram Jaccard join by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct word shingles. Sets link when their
Jaccard similarity is at least the threshold; the result gives each document its set's size and
the smallest doc_id of its connected component.

Exact copies share one set and are joined as one: all steps below work on distinct sets, the
representatives of their copies. For the other links:

1. Aside go sets that cannot have a link to a different set: of a linked set's shingles at least
   the threshold's share occurs in another set as well. Shingles are counted by a sample of
   `SAMPLE` to 2 `SAMPLE` a set (all of them in smaller sets; every set also counts what partners
   of at least its own size by the threshold sample), and a set goes aside only if the chance of
   so few shared ones is under e^-`ASIDE` for a linked set (Chernoff's bound). With exact=True
   all shingles are counted and no chance is left. Of the sets that stay all shingles are
   counted among themselves, and those with too few shared ones go for sure.
2. PartEnum. Sizes fall into bands whose upper end is low / threshold, so that links stay in a
   band or join it to the next; a set has the signatures of its own band and of the one below.
   For a band the domain is split by hash into `parts` first-level partitions, each of those
   into `SECOND` second-level ones. Two linked sets that differ in k shingles differ in more than
   `LOOSE` of them in at most k // (LOOSE + 1) first-level partitions; in every other one they
   agree on at least one subset of SECOND - LOOSE second-level partitions. All such subsets are
   enumerated, and each that holds a shingle gives a signature: (band, partition, subset, hash
   of the shingles in it). If f partitions of a set have no empty subset, it shares at least
   f - k // (LOOSE + 1) signatures with each partner. A set for which that is under 1 gives its
   shingles as signatures too, which any partner with the same lack shares.
3. Signatures with one set go, then sets with fewer signatures left than a link needs.
4. Star rounds: every signature has a leader, first the set with most of its signatures shared,
   then one drawn by hash; each set is compared with the leader it meets most often, and linked
   ones are merged. This costs a group of copies its size. Signatures within one component and
   the sets that lack others go.
5. Blocks: what is left is placed in blocks of bounded size, sets of a large component together,
   others by the largest signature they have. Blocks that share a signature across components
   are compared by parity sketches (bit i: is the number of shingles in bucket i odd), which
   bound differences from below, so they drop no link. Pairs that sketches leave are compared as
   whole sets: first a spanning forest of them per pair of blocks, then, with the components
   merged by it, all others that still join two components.

No pairs within a component are made beyond that.

Defined results: a null or blank text has an empty set and is its own component, whatever
others there are; fewer words than a shingle make one shingle of the whole sequence; repeated
rows (and rows with a null id) count as documents with equal sets, and smallest ids leave nulls
out; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from loomgraph.llm.common import Scratch, buffers, mix, picked, range_hashes, slices, window_hashes, words

WORDS = 5
#: Similarity in per cent.
THRESHOLD = 75
#: Shingles that a set counts in step 1, at least (if it has them); under twice as many.
SAMPLE = 64
#: Natural logarithm of the chance, per linked set, of going aside in step 1.
ASIDE = 36.0
#: Second-level partitions, and those of them that a subset leaves out.
SECOND, LOOSE = 3, 1
#: Star rounds.
STARS = 2
#: Shingles of a block's sets, about: sketches take at most a byte a shingle.
BLOCK = 1 << 16
#: Rows of ids or labels that are broadcast at most (up to 16 bytes each, about 50 in a hash table); more are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def _runs(row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.searchsorted(row, np.arange(n_rows))
    return first, np.append(first[1:], len(row))


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All rows' sets one after the other, each ascending; and the n + 1 offsets."""
    n_rows = len(at) - 1
    starts, ends, row = words(data, at)
    h = range_hashes(data, starts, ends, fold=True)
    first, last = _runs(row, n_rows)
    windows = window_hashes(h, size)
    out, offsets = [], np.zeros(n_rows + 1, np.int64)
    for i in range(n_rows):
        a, b = int(first[i]), int(last[i])
        if b - a >= size:
            own = np.sort(mix(windows[a : b - size + 1] + np.uint64(size)))
            own = own[np.r_[True, own[1:] != own[:-1]]]
        elif b > a:
            own = mix(window_hashes(h[a:b], b - a) + np.uint64(b - a))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        offsets[i + 1] = offsets[i] + len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), offsets


def set_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key of each set; its lowest bit is left 0, as a place for a flag."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(0x5851F42D4C957F2D)))]).astype(np.uint64)
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64) & np.int64(-2)


def _set_of(e: str):
    return F.col(e).bitwiseAND(F.lit(-2))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def sample_masks(sizes: np.ndarray) -> np.ndarray:
    """A set of this size samples the shingles whose hash has no bit of the mask."""
    level = np.maximum(np.floor(np.log2(np.maximum(sizes, 1) / SAMPLE)), 0).astype(np.uint64)
    return (np.uint64(1) << level) - np.uint64(1)


def profiles(docs: DataFrame, size: int = WORDS, threshold: int = THRESHOLD, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, d (the set's key), mask and counted (its shingles of step 1)."""

    def profiled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, at = shingle_sets(*buffers(part.column("text")), size)
                n = np.diff(at)
                # The smallest partners sample most; a set counts for them as well.
                wide, own = (np.zeros(len(n), np.uint64) if exact else sample_masks(x) for x in (-(-n * threshold // 100), n))
                chosen = (values & np.repeat(wide, n)) == 0
                kept = np.concatenate([[0], np.cumsum(chosen)])[at]
                columns = [part.column("doc_id"), pa.array(n), pa.array(set_keys(values, at)), pa.array(own.view(np.int64)), _lists(values[chosen], kept)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d", "mask", "counted"])

    return docs.mapInArrow(profiled, "doc_id bigint, n_shingles bigint, d bigint, mask bigint, counted array<bigint>")


def may_link(profile: DataFrame, threshold: int = THRESHOLD, exact: bool = False) -> DataFrame:
    """d, doc_id: the sets that step 1 leaves, each by one of its documents."""
    sets = profile.filter("n_shingles > 0")
    # The key's lowest bit tells whether the set itself samples the shingle.
    own = F.when(F.col("s").bitwiseAND(F.col("mask")) == 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    holders = sets.select("d", "mask", F.explode("counted").alias("s")).select("s", F.col("d").bitwiseOR(own).alias("e")).groupBy("s").agg(F.min("e").alias("e"), F.max("e").alias("other"))
    alone = holders.filter("e = other AND (e & 1) = 1").groupBy(_set_of("e").alias("d")).agg(F.count("*").cast("double").alias("alone"))
    sampled = F.size(F.filter("counted", lambda s: s.bitwiseAND(F.col("mask")) == 0)).cast("double")
    one = sets.groupBy("d").agg(F.min("doc_id").alias("doc_id"), F.max(sampled).alias("m"))
    p, q = F.lit(threshold / 100), (F.col("m") - F.coalesce("alone", F.lit(0.0))) / F.col("m")
    # Kullback-Leibler distance of the shared part q from p; x log x is 0 at 0.
    xlog = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    chance = F.lit(True) if exact else F.col("m") * (xlog(q, p) + xlog(1 - q, 1 - p)) > ASIDE
    return one.join(alone, "d", "left").filter((F.col("m") == 0) | ~((q < p) & chance)).select("d", "doc_id")


def parity_sketch(values: np.ndarray) -> bytes:
    """One bit per bucket, 4 to 8 buckets a shingle, a power of two in all."""
    m = 1 << max(6, (4 * len(values) - 1).bit_length())
    buckets = np.bincount((mix(values) & np.uint64(m - 1)).astype(np.int64), minlength=m)
    return np.packbits((buckets & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray, longs: int) -> np.ndarray:
    """Sketches (one a row) of fewer longs: halves fold together, as buckets are hashes modulo the size."""
    while sketches.shape[1] > longs:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def sketch_distance(x: bytes, y: bytes) -> int:
    """At most the number of shingles in one set but not in the other."""
    a, b = np.frombuffer(x, np.uint64)[None], np.frombuffer(y, np.uint64)[None]
    longs = min(a.shape[1], b.shape[1])
    return int(np.bitwise_count(folded(a, longs) ^ folded(b, longs)).sum())


def full_sets(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """d, n, the sketch and the whole set of each document that has words."""

    def full(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                values, at = shingle_sets(*buffers(part.column("text")), size)
                at = np.concatenate([[0], at[1:][np.diff(at) > 0]])
                if len(at) == 1:
                    continue
                sketches = [parity_sketch(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                columns = [pa.array(set_keys(values, at)), pa.array(np.diff(at)), pa.array(sketches, pa.binary()), _lists(values, at)]
                yield pa.RecordBatch.from_arrays(columns, ["d", "n", "sketch", "shingles"])

    return docs.select("text").mapInArrow(full, "d bigint, n bigint, sketch binary, shingles array<bigint>")


@lru_cache(maxsize=4)
def bands(threshold: int = THRESHOLD, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest size of each band."""
    low, high = [1], [100 // threshold]
    while high[-1] < most:
        low.append(high[-1] + 1)
        high.append(low[-1] * 100 // threshold)
    return np.array(low), np.array(high)


def most_apart(n: int, band: int, threshold: int = THRESHOLD) -> int:
    """Shingles by which a set of n differs at most from partners under `band`, its own or the one below."""
    # Linked sets of sizes a and b differ by (a + b) (100 - t) / (100 + t) shingles at most.
    low, high = (int(x[band]) for x in bands(threshold))
    largest = n * 100 // threshold if n <= high else high
    return (n + largest) * (100 - threshold) // (100 + threshold)


@lru_cache(maxsize=4096)
def parts(band: int, threshold: int = THRESHOLD) -> int:
    """First-level partitions: the fewest for which most sets have signatures enough by the subsets alone."""
    low, high = (int(x[band]) for x in bands(threshold))
    if low > 1 << 20:  # sets of this size are not expected; the share stays that of smaller ones
        return low * 3 // 10

    def margin(n: int, first: int) -> float:
        filled = 1 - math.exp(-n / first / SECOND)
        share = sum(math.comb(SECOND, j) * filled**j * (1 - filled) ** (SECOND - j) for j in range(LOOSE + 1, SECOND + 1))
        return first * share - 2.5 * math.sqrt(first * share * (1 - share)) - most_apart(n, band, threshold) // (LOOSE + 1) - 1

    # Steps of a hundredth: the exact value does not matter.
    for first in range(max(1, low // 5), low + 1, max(1, low // 100)):
        if margin(low, first) >= 0 and margin(high, first) >= 0:
            return first
    return max(1, low * 3 // 10)


SUBSETS = list(itertools.combinations(range(SECOND), SECOND - LOOSE))


def signatures(values: np.ndarray, band: int, threshold: int = THRESHOLD) -> tuple[np.ndarray, int]:
    """Signatures of a set under `band`, and how many of them a partner shares at least."""
    first = parts(band, threshold)
    salt = mix(np.array([band + 1], np.uint64))[0]
    spread = mix(values ^ salt)
    cell = ((spread >> np.uint64(32)) * np.uint64(first) >> np.uint64(32)) * np.uint64(SECOND) + ((spread & np.uint64(0xFFFFFFFF)) * np.uint64(SECOND) >> np.uint64(32))
    order = np.argsort(cell, kind="stable")
    cell = cell[order].astype(np.int64)
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sums, filled = np.zeros(first * SECOND, np.uint64), np.zeros(first * SECOND, bool)
    sums[cell[start]] = np.add.reduceat(mix(spread[order]), start)
    filled[cell[start]] = True
    sums, filled = sums.reshape(first, SECOND), filled.reshape(first, SECOND)
    names = np.arange(1, first + 1, dtype=np.uint64) * np.uint64(len(SUBSETS))
    own = [mix(sums[:, s].sum(axis=1) + mix(names + np.uint64(j) ^ salt))[filled[:, s].any(axis=1)] for j, s in enumerate(map(list, SUBSETS))]
    need = int((filled.sum(axis=1) > LOOSE).sum()) - most_apart(len(values), band, threshold) // (LOOSE + 1)
    if need >= 1:
        return np.concatenate(own), need
    return np.concatenate([*own, mix(spread + np.uint64(1))]), 1


def signature_lists(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """e (the set's key, its lowest bit telling which of the two bands), need, total and sig, a list."""
    low, _ = bands(threshold)

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("shingles")
            values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
            at, keys = column.offsets.to_numpy(), batch.column("d").to_numpy()
            for start in range(0, batch.num_rows, 500):
                key, need, found = [], [], []
                for i in range(start, min(start + 500, batch.num_rows)):
                    own = values[at[i] : at[i + 1]]
                    band = int(np.searchsorted(low, len(own), side="right")) - 1
                    for upper in (0, 1) if band else (0,):
                        sig, least = signatures(own, band - upper, threshold)
                        key.append(keys[i] | upper)
                        need.append(least)
                        found.append(sig)
                size = [len(x) for x in found]
                columns = [pa.array(key, pa.int64()), pa.array(need, pa.int32()), pa.array(size, pa.int32()), _lists(np.concatenate(found), np.concatenate([[0], np.cumsum(size)]))]
                yield pa.RecordBatch.from_arrays(columns, ["e", "need", "total", "sig"])

    return sets.select("d", "shingles").mapInArrow(signed, "e bigint, need int, total int, sig array<bigint>")


def shared_sets(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """d of the sets of which others hold the threshold's share of shingles, exactly."""
    rows = sets.select("d", "n", F.explode("shingles").alias("s"))
    alone = rows.groupBy("s").agg(F.min(F.struct("d", "n")).alias("one"), F.max("d").alias("other")).filter("one.d = other").groupBy("one.d", "one.n").agg(F.count("*").alias("alone"))
    poor = alone.filter(100 * (F.col("n") - F.col("alone")) < threshold * F.col("n"))
    return sets.select("d").distinct().join(poor, "d", "left_anti")


def small(rows: DataFrame) -> DataFrame:
    """Rows of one or two longs, to be broadcast if they, which are counted, are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else rows.hint("shuffle_hash")


def only_of(rows: DataFrame, ids: DataFrame, on) -> DataFrame:
    """The rows of these ids: by a broadcast if the ids are few, else by a shuffle."""
    return rows.join(small(ids), on, "left_semi")


def across(held: DataFrame, labels: DataFrame | None) -> DataFrame:
    """e, need, total, sig, d, c: signatures that hold several components, of sets with enough of them for a link."""
    own = held.select("e", "need", "total", "sig", _set_of("e").alias("d"))
    own = own.withColumn("c", F.col("d")) if labels is None else own.join(small(labels), "d")
    rows = own.select("e", "need", "total", "d", "c", F.explode("sig").alias("sig"))
    several = rows.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("sig")
    left = rows.join(several, "sig", "left_semi").groupBy("e", "need", "total", "d", "c").agg(F.collect_list("sig").alias("sig"))
    return left.filter(F.size("sig") >= F.col("need"))


def star_pairs(active: DataFrame, i: int) -> DataFrame:
    """Pairs (a, b): each set with the leader that most of its signatures have."""
    rank = -F.size("sig") / F.col("total") if i == 0 else F.xxhash64("c", F.lit(i)).cast("double")
    rows = active.select("d", "c", rank.alias("rank"), F.explode("sig").alias("sig"))
    leader = rows.groupBy("sig").agg(F.min(F.struct("rank", F.xxhash64("d"), "c", "d")).alias("l"))
    met = rows.join(leader, "sig").filter("c <> l.c").groupBy("d", F.col("l.d").alias("l")).agg(F.count("*").alias("n"))
    best = met.groupBy("d").agg(F.max(F.struct("n", "l")).alias("best"))
    return best.select(F.least("d", "best.l").alias("a"), F.greatest("d", "best.l").alias("b")).distinct()


def _near(a, b, na, nb, apart, threshold: int):
    """Do sizes and a lower bound of the difference allow a link? Numbers or arrays."""
    return ((100 + threshold) * apart <= (100 - threshold) * (na + nb)) & (100 * na >= threshold * nb) & (100 * nb >= threshold * na)


def may_be_linked(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) whose sketches allow a link."""
    left = sets.select(F.col("d").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = sets.select(F.col("d").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "x", "y"))
            keep = [i for i in range(len(a)) if _near(a, b, na[i], nb[i], sketch_distance(x[i], y[i]), threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in keep], pa.int64()) for c in (a, b)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(close, "a bigint, b bigint").distinct()


def linked(close: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets are similar enough."""
    ids = close.select(F.col("a").alias("d")).union(close.select("b"))
    wanted = only_of(sets.select("d", "shingles"), ids, "d")
    both = F.size(F.array_intersect("x", "y"))
    similar = 100 * both >= threshold * (F.size("x") + F.size("y") - both)
    rows = close.join(wanted.select(F.col("d").alias("a"), F.col("shingles").alias("x")), "a").join(wanted.select(F.col("d").alias("b"), F.col("shingles").alias("y")), "b")
    return rows.filter(similar).select("a", "b").distinct()


def components(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """d, c after merging along the links (a, b).

    Only components that a link joins take part: each round gives them the least label of their
    neighbours, then follows labels once more.
    """
    end = lambda k: labels.select(F.col("d").alias(k), F.col("c").alias(f"{k}c"))
    joined = links.join(end("a"), "a").join(end("b"), "b").filter("ac <> bc").select("ac", "bc").distinct()
    edges = scratch.keep(joined.select(F.col("ac").alias("v"), F.col("bc").alias("w")).union(joined.select("bc", "ac")))
    merged = edges.select("v", F.col("v").alias("m")).distinct()
    while True:
        near = edges.join(merged.select(F.col("v").alias("w"), "m"), "w").groupBy("v").agg(F.min("m").alias("near"))
        lower = merged.join(near, "v").select("v", F.col("m").alias("was"), F.least("m", "near").alias("m"))
        # A label that a member lowers is lowered for all that bear it.
        best = lower.groupBy("was").agg(F.min("m").alias("best"))
        step = scratch.keep(lower.join(best, "was").select("v", "was", F.least("m", "best").alias("m")))
        merged = step.select("v", "m")
        if step.filter("m <> was").isEmpty():
            break
    return scratch.keep(labels.join(merged, F.col("c") == F.col("v"), "left").select("d", F.coalesce("m", "c").alias("c")))


def blocks(active: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """d, block of each set; and one row a block: block, low and high (components), members."""
    rows = active.select("d", "c", F.explode("sig").alias("sig"))
    size = rows.groupBy("sig").agg(F.count("*").alias("size"))
    home = rows.join(size, "sig").groupBy("d", "c").agg(F.max(F.struct("size", "sig"))["sig"].alias("home"))
    home = scratch.keep(home.join(sets.select("d", "n", "sketch"), "d"))
    large = home.groupBy("c").agg(F.sum("n").alias("volume")).filter(F.col("volume") > BLOCK).select("c", F.lit(True).alias("large"))
    key = F.when(F.col("large"), F.xxhash64(F.lit("component"), "c")).otherwise(F.xxhash64(F.lit("signature"), "home"))
    keyed = home.join(large, "c", "left").withColumn("key", key).drop("large", "home")
    volume = keyed.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("d"), F.col("chunks"))
    placed = scratch.keep(keyed.join(volume, "key").withColumn("block", F.xxhash64("key", chunk)).drop("key", "chunks"))
    filled = placed.groupBy("block").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.collect_list(F.struct("d", "c", "n", "sketch")).alias("members"))
    return placed.select("d", "block"), scratch.keep(filled)


class _Members:
    """A block's sets as arrays; sketches in one matrix for each length."""

    def __init__(self, members: pa.StructArray):
        self.d, self.c, self.n = (members.field(k).to_numpy(zero_copy_only=False) for k in ("d", "c", "n"))
        sketches = members.field("sketch").to_pylist()
        length = np.array([len(s) // 8 for s in sketches])
        self.of = {int(x): np.flatnonzero(length == x) for x in np.unique(length)}
        self.sketch = {x: np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), x) for x, at in self.of.items()}


def _close_in(x: _Members, y: _Members, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i, j in the two blocks (in one: i < j) and the sketches' distance of pairs across components that may link."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lx, ix in x.of.items():
        for ly, iy in y.of.items():
            longs = min(lx, ly)
            a, b = folded(x.sketch[lx], longs), folded(y.sketch[ly], longs)
            for k, i in enumerate(ix):
                at = np.flatnonzero(y.c[iy] != x.c[i])
                if x is y:
                    at = at[iy[at] > i]
                apart = np.bitwise_count(a[k] ^ b[at]).sum(axis=1, dtype=np.int64)
                j = iy[at]
                keep = _near(None, None, x.n[i], y.n[j], apart, threshold)
                if keep.any():
                    out.append((np.full(int(keep.sum()), i), j[keep], apart[keep]))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 3


def _forest(ends: np.ndarray, order: np.ndarray) -> list[int]:
    """Of the edges (pairs of component keys), taken in this order, those of a spanning forest."""
    above: dict[int, int] = {}

    def top(v: int) -> int:
        while (u := above.get(v, v)) != v:
            above[v] = above.get(u, u)
            v = u
        return v

    chosen = []
    for k in order.tolist():
        a, b = (top(int(v)) for v in ends[k])
        if a != b:
            above[a] = b
            chosen.append(k)
    return chosen


def block_pairs(active: DataFrame, sets: DataFrame, scratch: Scratch, spanning: bool, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) across components that the sketches leave; spanning: of those of two blocks, only a spanning forest."""
    placed, filled = blocks(active, sets, scratch)
    rows = active.select("d", "c", F.explode("sig").alias("sig")).join(small(placed), "d")
    met = rows.groupBy("sig", "block").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    # Two different pairs of extremes, or one that is no single component.
    first, second = met.select("sig", *[F.col(k).alias(f"{k}1") for k in ("block", "low", "high")]), met.select("sig", *[F.col(k).alias(f"{k}2") for k in ("block", "low", "high")])
    pairs = first.join(second, "sig").filter("block1 < block2 AND NOT (low1 = high1 AND low2 = high2 AND low1 = low2)").select("block1", "block2").distinct()
    one, two = filled.select(F.col("block").alias("block1"), F.col("members").alias("x")), filled.select(F.col("block").alias("block2"), F.col("members").alias("y"))
    within = filled.filter("low <> high").select(F.col("members").alias("x"), F.lit(None).cast(filled.schema["members"].dataType).alias("y"))
    todo = pairs.join(one, "block1").join(two, "block2").select("x", "y").union(within)

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                x = _Members(batch.column("x")[k].values)
                y = _Members(batch.column("y")[k].values) if batch.column("y")[k].is_valid else x
                i, j, apart = _close_in(x, y, threshold)
                if spanning and len(i):
                    chosen = _forest(np.stack([x.c[i], y.c[j]], axis=1), np.argsort(apart - (x.n[i] + y.n[j]) / 8, kind="stable"))
                    i, j = i[chosen], j[chosen]
                a.append(np.minimum(x.d[i], y.d[j]))
                b.append(np.maximum(x.d[i], y.d[j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in (a, b)], ["a", "b"])

    return todo.mapInArrow(compared, "a bigint, b bigint").distinct()


def similar_sets(sets: DataFrame, scratch: Scratch, threshold: int = THRESHOLD) -> DataFrame:
    """d, c: the component of every set that has a link (sets without one may be left out)."""
    signed = scratch.keep(signature_lists(sets, threshold))
    active = scratch.keep(across(signed, None))
    scratch.drop(signed)
    scratch.forget_shuffles()
    labels = active.select("d", F.col("d").alias("c")).distinct()
    for i in range(STARS):
        close = scratch.keep(may_be_linked(star_pairs(active, i), sets, threshold))
        found = scratch.keep(linked(close, sets, threshold))
        if found.isEmpty():
            break
        labels = components(labels, found, scratch)
        active, before = scratch.keep(across(active.drop("d", "c"), labels)), active
        scratch.drop(before)
        scratch.forget_shuffles()
    for spanning in (True, False):
        close = scratch.keep(block_pairs(active, sets, scratch, spanning, threshold))
        if close.isEmpty():
            break
        found = scratch.keep(linked(close, sets, threshold))
        if not found.isEmpty():
            labels = components(labels, found, scratch)
            active, before = scratch.keep(across(active.drop("d", "c"), labels)), active
            scratch.drop(before)
        scratch.forget_shuffles()
    return labels


def with_key(docs: DataFrame, text_col: str = "text", size: int = WORDS) -> DataFrame:
    """docs with _d (the key of the row's set) and _n (its size)."""

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                values, at = shingle_sets(*buffers(part.column(part.schema.get_field_index(text_col))), size)
                yield part.append_column("_d", pa.array(set_keys(values, at))).append_column("_n", pa.array(np.diff(at)))

    return docs.mapInArrow(keyed, StructType([*docs.schema.fields]).add("_d", LongType()).add("_n", LongType()))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, n_shingles, component_id for every document; settings: as those of `labelled`."""
    return labelled(docs, id_col, text_col, **settings).select("doc_id", "n_shingles", "component_id")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, threshold: int = THRESHOLD, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, d (the set's key) and c (its component's, ids or not) for every document.

    size: words of a shingle; threshold: similarity in per cent; exact: step 1 counts all shingles.
    """
    scratch = Scratch(docs.sparkSession)
    own = picked(docs, doc_id=id_col, text=text_col)
    counted = scratch.keep(profiles(own, size, threshold, exact))
    chosen = scratch.keep(may_link(counted, threshold, exact).select(F.col("doc_id").alias("chosen_id")).distinct())
    profile = scratch.keep(counted.select("doc_id", "n_shingles", "d"))
    scratch.drop(counted)
    scratch.forget_shuffles()
    full = scratch.keep(full_sets(only_of(own, chosen, own["doc_id"].eqNullSafe(F.col("chosen_id"))), size))
    sets = scratch.keep(only_of(full, scratch.keep(shared_sets(full, threshold)), "d"))
    scratch.drop(full)
    scratch.forget_shuffles()
    labels = similar_sets(sets, scratch, threshold)
    labels = scratch.only(labels, profile)
    rows = profile.select("doc_id", "n_shingles", "d").join(labels, "d", "left").withColumn("c", F.coalesce("c", "d"))
    least = rows.groupBy("c").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return rows.join(least, "c").select("doc_id", "n_shingles", component.alias("component_id"), "d", "c")
