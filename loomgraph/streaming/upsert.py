"""Incremental graph building: each micro-batch of chunks goes into the stored nodes and edges.

The tables are versioned by the batch id and bucketed by key, so that a batch rewrites only the buckets
it touches, and one that runs again after a failure gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.lexicon import Entry
from loomgraph.operators import extraction, versioned


def latest(spark: SparkSession, path: str, batch_id: int | None = None) -> str | None:
    """Where the rows of path (nodes or edges) are, once a batch has come; batch ids no longer name folders."""
    rows = f"{path}/rows"
    return rows if versioned.exists(spark, rows) else None


def upsert_batch(path: str, lexicon: list[Entry], buckets: int = versioned.BUCKETS):
    """A foreachBatch function that keeps path/nodes and path/edges."""

    def run(chunks: DataFrame, batch_id: int) -> None:
        found = extraction.extract(chunks, lexicon)
        merged = extraction.merge_nodes(found[0]), extraction.merge_edges(found[1])
        for table, rows in zip(versioned.graph_tables(path, buckets), merged, strict=True):
            table.upsert(rows.withColumn("sequence", F.lit(batch_id).cast("bigint")))

    return run
