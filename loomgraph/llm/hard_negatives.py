"""Operator 13, hard negatives by Fagin's threshold algorithm.

Vectors are integer. All rows are dealt to blocks of bounded size, the anchors to groups of bounded
size, and every block meets every group once. In a block each dimension has its list of rows in order
of value. An anchor reads these lists in parallel, from the top where its component is positive and
from the bottom where it is negative; rows that it meets are looked up and scored in integers; what
the next entries of all lists would score bounds every row not met. It stops once this threshold is
strictly below the k-th score of each of its windows, or below the window itself, so that ties still
count. Spark merges the blocks' first k. Searches run twice: for the positives (same label, one
window without bounds), then for the negatives (other labels, a window for each positive).

Defined results: rows with a null label, a null vector or a null or non-finite component take no part;
missing components of shorter vectors count as 0; products are exact, scores beyond 64 bits are cut to
the nearest such number; equal scores go by the smaller id, null ids last; each of several rows with one
id is a row of its own (an anchor is not its own positive, its copies are); anchors without positives
and positives without negatives give no rows; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import Scratch

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these parts of the positive's, in per cent.
LOW, HIGH = 30, 90
#: Rows of a block: a 64th of all rows, between these bounds; anchors of a group, about.
BLOCK, ANCHORS = (8192, 65536), 2048
#: Entries of each list that the first step reads; each further step reads as many as all before it.
STEP = 16

LONG = (1 << 63) - 1
Bounds = tuple[int, int]


def integers(vector: Column, scale: int = 256) -> Column:
    """The floor of scale x each component, as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(vector: Column) -> Column:
    """Whether all components are finite; null for a null vector."""
    return F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


class SortedLists:
    """The rows of a block in the order of each dimension, for integer inner products."""

    def __init__(self, vectors: np.ndarray, most: int = LONG):
        """vectors: int64; most: the largest absolute component of any anchor, times the dimensions."""
        self.n, self.dims = vectors.shape
        bound = most * int(np.abs(vectors).max(initial=0))
        kinds = ((1 << 24, np.float32), (1 << 53, np.float64), (1 << 63, np.int64))
        # Sums of products below these bounds are exact.
        self.kind = next((kind for limit, kind in kinds if bound < limit), object)
        self.x = vectors.astype(self.kind)
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32))
        self.read = 0

    def threshold(self, anchor: np.ndarray, depth: int) -> int:
        """What a row could score that stands at this depth in every list."""
        up = np.where(anchor > 0, self.n - 1 - depth, depth)
        values = self.x[self.order[np.arange(self.dims), up], np.arange(self.dims)]
        return sum(int(a) * int(v) for a, v in zip(anchor, values, strict=True) if a)

    def search(self, anchor: np.ndarray, fits: np.ndarray, windows: list[Bounds], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows met, and their scores: among them the first k (ties too) of those that fit in each window of scores."""
        own = anchor.astype(self.kind)
        seen, scores = np.zeros(self.n, bool), np.zeros(self.n, self.kind)
        met: list[np.ndarray] = []
        used = np.flatnonzero(anchor)
        depth, step = 0, STEP
        while depth < self.n:
            end = min(self.n, depth + step)
            fresh = np.zeros(self.n, bool)
            for j in used:
                fresh[self.order[j, self.n - end : self.n - depth] if anchor[j] > 0 else self.order[j, depth:end]] = True
            if not len(used):
                fresh[:] = True
            rows = np.flatnonzero(fresh & ~seen)
            seen[rows] = True
            scores[rows] = self.x[rows] @ own
            self.read += len(rows)
            met.append(rows)
            depth, step = end, end
            if depth == self.n or seen.all() or self.settled(scores, seen & fits, windows, k, self.threshold(anchor, depth)):
                break
        rows = np.concatenate(met) if met else np.zeros(0, np.int64)
        return rows, scores[rows]

    @staticmethod
    def settled(scores: np.ndarray, fit: np.ndarray, windows: list[Bounds], k: int, threshold: int) -> bool:
        """Whether no row not met can be among the first k of a window."""
        for low, high in windows:
            if threshold < low:
                continue
            if threshold >= high:  # no k-th score is above it
                return False
            inside = scores[fit & (scores >= low) & (scores <= high)]
            if len(inside) < k or np.partition(inside, len(inside) - k)[len(inside) - k] <= threshold:
                return False
        return True


def first(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, window: Bounds, k: int) -> np.ndarray:
    """Places in `rows` of the first k in the window: higher scores, then smaller ids, then earlier rows."""
    inside = np.flatnonzero((scores >= window[0]) & (scores <= window[1]))
    if len(inside) > k:
        inside = inside[scores[inside] >= np.partition(scores[inside], len(inside) - k)[len(inside) - k]]
    if scores.dtype == object:
        return np.array(sorted(inside.tolist(), key=lambda i: (-scores[i], ids[rows[i]], rows[i]))[:k], np.int64)
    return inside[np.lexsort((rows[inside], ids[rows[inside]], -scores[inside]))[:k]]


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, shorter ones filled with 0."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims)[None] < lengths[:, None]] = flat
    return out


def longest(column: pa.ChunkedArray) -> int:
    return int(np.diff(column.combine_chunks().offsets.to_numpy()).max(initial=0))


_FOUND = "anchor bigint, window int, score bigint, id bigint, row bigint"


def _searcher(same: bool, k: int):
    """What a block's rows and a group's anchors give: the first k rows of each anchor's windows."""

    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in _FOUND.split(", ")}
        dims = max(longest(anchors["a"]), longest(rows["v"]))
        a, x = matrix(anchors["a"], dims), matrix(rows["v"], dims)
        most = int(np.abs(a).max(initial=0)) * max(dims, 1)
        number, labels = rows["row"].to_numpy(), rows["label"].to_numpy()
        ids = rows["id"].fill_null(LONG).to_numpy()
        parts: dict[int, tuple[np.ndarray, SortedLists]] = {}
        for i, (row, label, windows) in enumerate(zip(anchors["anchor"].to_pylist(), anchors["own"].to_pylist(), anchors["windows"].to_pylist(), strict=True)):
            part = label if same else None
            if part not in parts:
                chosen = np.flatnonzero(labels == label) if same else np.arange(len(labels))
                parts[part] = chosen, SortedLists(x[chosen], most)
            chosen, lists = parts[part]
            fits = number[chosen] != row if same else labels != label
            bounds = [(w["low"], w["high"]) for w in windows]
            met, scores = lists.search(a[i], fits, bounds, k)
            good = fits[met]
            met, scores = met[good], scores[good]
            for at, bound in enumerate(bounds):
                for j in first(met, scores, ids[chosen], bound, k).tolist():
                    own = chosen[met[j]]
                    for c, value in zip(out, (row, at, max(-LONG - 1, min(LONG, int(scores[j]))), None if ids[own] == LONG else int(ids[own]), int(number[own])), strict=True):
                        out[c].append(value)
        return pa.table({c: pa.array(v, pa.int32() if c == "window" else pa.int64()) for c, v in out.items()})

    return search


def _blocks(n: int) -> int:
    return max(1, math.ceil(n / min(BLOCK[1], max(BLOCK[0], math.ceil(n / 64)))))


def _place(parts: int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")


def _all(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def searched(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, same: bool, k: int) -> DataFrame:
    """anchor, window, score, id, row and rank of the first k rows of each anchor's windows, over all blocks."""
    blocks, groups = _blocks(n_rows), max(1, math.ceil(n_anchors / ANCHORS))
    left = anchors.select(F.col("row").alias("anchor"), F.col("label").alias("own"), F.col("v").alias("a"), "windows", _place(groups).alias("g"), _all(blocks).alias("b"))
    right = rows.select("row", "id", "label", "v", _place(blocks).alias("b"), _all(groups).alias("g"))
    found = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(_searcher(same, k), _FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scratch: Scratch | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    vectors: id, label and v (lists of integers); anchors: a condition on id that says which rows are anchors.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    rows = scratch.keep(vectors.select(F.col("id").cast("bigint"), F.col("label").cast("bigint"), "v").filter("label IS NOT NULL AND v IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
    asked = rows.filter(anchors)
    n_rows, n_anchors = rows.count(), asked.count()
    free = F.array(F.struct(F.lit(-LONG - 1).alias("low"), F.lit(LONG).alias("high")))
    near = scratch.keep(searched(rows, asked.withColumn("windows", free), n_rows, n_anchors, True, positives))

    # 100 x negative between low x and high x positive: whole numbers from the ceiling to the floor.
    score = F.col("score").cast("decimal(38, 0)")
    bound = F.struct(F.ceil(score * low / 100).cast("bigint").alias("low"), F.floor(score * high / 100).cast("bigint").alias("high"), "rank")
    windows = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", bound.alias("w")))).alias("ws")).select("anchor", F.transform("ws", lambda x: F.struct(x["w"]["low"].alias("low"), x["w"]["high"].alias("high"))).alias("windows"))
    found = searched(rows, asked.join(windows.withColumnRenamed("anchor", "row"), "row"), n_rows, n_anchors, False, negatives)
    kept = near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = found.join(kept, ["anchor", "window"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, moved: int = 7, labels: int = 10) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by `every`; ids divisible by `moved` take the next of the labels."""
    at = embeddings.select(embeddings[id_col].alias("id"), embeddings[vector_col].alias("v"), embeddings[label_col].alias("label"))
    label = F.when(F.col("id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return hard_negatives(at.filter(usable(F.col("v"))).select("id", label.alias("label"), integers(F.col("v")).alias("v")), F.col("id") % every == 0)
