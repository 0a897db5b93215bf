"""An inverted-file index of stored vectors: lists around centroids, searched list by list.

Centroids are fitted by k-means on a bounded sample (`SAMPLE` rows, drawn by a hash of the id); every
row is then put into the list of its nearest centroid and written with the list as partition column.
Lists of over `PART` rows are dealt out over several parts, so that a list that holds a third of all
rows, such as copies of one vector, is searched by several tasks.

A search sends each query to its nearest lists only. Queries and lists meet by (list, part): a shuffle
of the queries' copies, never all queries times all rows. `probes` says how many lists a query visits;
`exact` visits further lists as long as one could hold a nearer row, by the triangle inequality on each
list's radius, so that the result is that of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.tables import shared_folder, written

#: Rows that centroids are fitted on, about, and the steps of fitting.
SAMPLE, STEPS = 20_000, 8
#: Lists, at most; otherwise the square root of the rows.
LISTS = 1024
#: Rows of a list that one task searches, about.
PART = 20_000
#: Queries that one task takes from a group, about.
QUERIES = 4096


@dataclass
class VectorIndex:
    """rows: vec_id, embedding, list, part. lists: list, n, parts, radius. centroids: one row a list."""

    rows: DataFrame
    lists: DataFrame
    centroids: np.ndarray
    path: str


def _floats(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, to rounding."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def fit(sample: np.ndarray, n_lists: int, steps: int = STEPS) -> np.ndarray:
    """k-means from spread rows of the sample; a centroid that loses all rows stays."""
    rows = np.unique(sample, axis=0)
    centroids = rows[np.linspace(0, len(rows) - 1, min(n_lists, len(rows))).astype(int)].copy()
    for _ in range(steps):
        own = squared(sample, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, embedding, list and distance of every row."""

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = squared(_floats(batch.column("embedding")), centroids)
            own = far.argmin(1)
            yield batch.append_column("list", pa.array(own, pa.int32())).append_column("distance", pa.array(np.sqrt(far[np.arange(len(own)), own])))

    return vectors.mapInArrow(assign, "vec_id bigint, embedding array<float>, list int, distance double")


def build(vectors: DataFrame, path: str | None = None, n_lists: int | None = None) -> VectorIndex:
    """Index vec_id, embedding rows (others are left out); without rows there are no lists."""
    spark = vectors.sparkSession
    path = path or shared_folder(spark)
    full = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>")).filter("vec_id IS NOT NULL AND size(embedding) > 0")
    n = full.count()
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = full.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy("vec_id").limit(2 * SAMPLE).toArrow()
    sample = _floats(drawn["embedding"]) if n else np.zeros((0, 1))
    centroids = fit(sample, n_lists or max(1, min(LISTS, round(math.sqrt(n))))) if n else sample
    placed = _assigned(full, centroids) if n else full.selectExpr("*", "0 AS list", "0.0D AS distance")
    placed = written(placed, f"{path}/rows", ["list"])
    lists = written(placed.groupBy("list").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")), f"{path}/lists")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    return _with_parts(placed, lists, centroids, path)


def _with_parts(placed: DataFrame, lists: DataFrame, centroids: np.ndarray, path: str) -> VectorIndex:
    # A row for each list, LISTS at most.
    rows = placed.join(F.broadcast(lists.select("list", "parts")), "list").select("vec_id", "embedding", "list", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
    return VectorIndex(rows, lists, centroids, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()
    return _with_parts(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/lists"), _floats(centroids["centroid"]) if len(centroids) else np.zeros((0, 1)), path)


def _visits(index: VectorIndex, queries: DataFrame, first: int, last: int | None, bound: str | None = None) -> DataFrame:
    """query_id, q, list, part and seat of the lists that each query visits: those ranked first to last by distance.

    bound: a column of queries; a list is visited only if its ball comes within that distance.
    """
    centroids = index.centroids
    radius = np.zeros(len(centroids))
    for r in index.lists.select("list", "radius").collect():
        radius[r["list"]] = r["radius"]
    filled = np.array(sorted(r["list"] for r in index.lists.select("list").collect()), np.int64)

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.sqrt(squared(_floats(batch.column("q")), centroids))[:, filled]
            order = np.argsort(far, axis=1, kind="stable")[:, first:last]
            near = np.take_along_axis(far, order, 1)
            keep = np.ones(order.shape, bool)
            if bound:
                limit = batch.column(bound).to_numpy(zero_copy_only=False)
                # Rounding of distances is far below this slack.
                keep = near - radius[filled][order] <= np.where(np.isnan(limit), np.inf, limit)[:, None] + 1e-6
            at, which = np.nonzero(keep)
            rows = batch.select(["query_id", "q"]).take(pa.array(at))
            yield rows.append_column("list", pa.array(filled[order[at, which]], pa.int32()))

    found = queries.mapInArrow(visit, "query_id bigint, q array<float>, list int")
    parts = F.broadcast(index.lists.select("list", "parts"))
    return found.join(parts, "list").select("query_id", "q", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def _scan(k: int):
    """The k nearest rows of one list's part for each query that visits it."""

    def scan(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "distance": []}
        if len(queries) and len(rows):
            x, ids = _floats(rows["embedding"]), rows["vec_id"].to_numpy()
            for start in range(0, len(queries), 256):
                part = queries.slice(start, 256)
                q, own = _floats(part["q"]), part["query_id"].to_numpy()
                far = squared(q, x)
                far[ids[None] == own[:, None]] = np.inf
                most = min(k, len(ids)) - 1
                edge = np.partition(far, most, axis=1)[:, most]
                for i in range(len(own)):
                    # Rows within rounding of the k-th are measured again, coordinate by coordinate.
                    near = np.flatnonzero((far[i] <= edge[i] * (1 + 1e-9) + 1e-9) & np.isfinite(far[i]))
                    distance = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                    best = near[order := np.lexsort((ids[near], np.round(distance, 9)))[:k]]
                    out["query_id"] += [own[i]] * len(best)
                    out["vec_id"] += ids[best].tolist()
                    out["distance"] += distance[order].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "distance": pa.array(out["distance"], pa.float64())})

    return scan


def _met(index: VectorIndex, visits: DataFrame, k: int, seats: int) -> DataFrame:
    seat: Column = F.pmod(F.xxhash64("query_id"), F.lit(seats)).cast("int")
    rows = index.rows.select("vec_id", "embedding", F.col("list").alias("l"), F.col("part").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(seats - 1))).alias("s"))
    left = visits.withColumn("seat", seat).groupBy("list", "part", "seat")
    return left.cogroup(rows.groupBy("l", "p", "s")).applyInArrow(_scan(k), "query_id bigint, vec_id bigint, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
    """query_id, vec_id, distance and rank of the k nearest rows (but the query itself, by id) in the lists visited.

    queries: vec_id, embedding. Ties go to the smaller id.
    """
    asked = queries.select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<float>").alias("q")).filter("query_id IS NOT NULL AND size(q) > 0")
    n = asked.count()
    if not n or not len(index.centroids):
        return index.rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).limit(0)
    seats = max(1, math.ceil(n * min(probes, len(index.centroids)) / len(index.centroids) / QUERIES))
    first = _best(_met(index, _visits(index, asked, 0, probes), k, seats), k)
    if not exact or probes >= len(index.centroids):
        return first
    first = written(first)
    limit = first.filter(F.col("rank") == k).select("query_id", F.col("distance").alias("limit"))
    bounded = asked.join(limit, "query_id", "left")
    rest = _met(index, _visits(index, bounded, probes, None, "limit"), k, max(1, math.ceil(n / QUERIES)))
    return _best(first.drop("rank").unionByName(rest), k)


def full_scan(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """search without an index: the stated queries meet all rows, in parts of PART rows and QUERIES queries."""
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>")).filter("vec_id IS NOT NULL AND size(embedding) > 0")
    asked = queries.select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<float>").alias("q")).filter("query_id IS NOT NULL AND size(q) > 0")
    parts, seats = (max(1, math.ceil(df.count() / most)) for df, most in ((rows, PART // 4), (asked, QUERIES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select("query_id", "q", place("query_id", seats).alias("seat"), every(parts).alias("part")).groupBy("part", "seat")
    right = rows.select("vec_id", "embedding", place("vec_id", parts).alias("p"), every(seats).alias("s")).groupBy("p", "s")
    return _best(left.cogroup(right).applyInArrow(_scan(k), "query_id bigint, vec_id bigint, distance double"), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, n_true and n_found: how many of each query's true neighbours were found."""
    hits = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))


def probes_for(index: VectorIndex, vectors: DataFrame, k: int, least: float = 0.95, most_queries: int = 64) -> int:
    """The fewest lists (by doubling) at which a hash-drawn sample of queries reaches this recall against exact search."""
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_queries)
    truth = written(search(index, drawn, k, exact=True))
    probes = 4
    while probes < len(index.centroids):
        n = recall(search(index, drawn, k, probes), truth).agg(F.sum("n_found") / F.sum("n_true")).first()[0]
        if n is None or n >= least:
            return probes
        probes *= 2
    return len(index.centroids)
