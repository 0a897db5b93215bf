"""Tables with a key and a sequence, kept up to date in place: a batch rewrites only the buckets that it touches.

A table lies in folders by a hash of its key. An upsert reads the buckets of the batch's keys, keeps of each
key what the sequence says is latest, and overwrites those folders alone (dynamic partition overwrite), so
that what it reads and writes follows the batch and not the table. Rows of an older sequence that arrive late
don't replace newer ones, and a batch that runs again after a failure gives the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: The column of folders.
PLACE = "bucket_of_key"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@dataclass
class VersionedTable:
    """path/rows: the table; path/meta: its number of buckets, fixed by the first upsert.

    sequence: a column that orders the versions of a key. props: a map column whose entries are
    versions of their own: an entry stays until a later one of its name comes; None: whole rows.
    """

    path: str
    key: list[str]
    sequence: str
    props: str | None = None
    buckets: int = BUCKETS

    @property
    def rows_path(self) -> str:
        return f"{self.path}/rows"

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.rows_path).drop(PLACE, "sequences_")

    def of_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys; buckets without any are not read."""
        spark = keys.sparkSession
        asked = keys.select(*self.key).distinct().withColumn(PLACE, self._place(self._buckets(spark)))
        found = spark.read.parquet(self.rows_path).filter(F.col(PLACE).isin(self._touched(asked)))
        return found.join(asked, [*self.key, PLACE], "left_semi").drop(PLACE, "sequences_")

    def upsert(self, batch: DataFrame) -> list[int]:
        """Take the batch in; the buckets that were written."""
        spark = batch.sparkSession
        n = self._buckets(spark)
        new = self._stored(batch).withColumn(PLACE, self._place(n))
        touched = self._touched(new)
        if not touched:
            return []
        both = new
        if exists(spark, self.rows_path):
            old = spark.read.parquet(self.rows_path).filter(F.col(PLACE).isin(touched)).withColumn(PLACE, F.col(PLACE).cast("int"))
            both = old.select(*new.columns).unionByName(new)
        out = self._latest(both).repartition(min(len(touched), 4 * spark.sparkContext.defaultParallelism), PLACE)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PLACE).parquet(self.rows_path)
        return touched

    def _place(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(n)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        """Bucket numbers, `buckets` at most."""
        return sorted(r[0] for r in rows.select(PLACE).distinct().collect())

    def _buckets(self, spark: SparkSession) -> int:
        meta = f"{self.path}/meta"
        if not exists(spark, f"{meta}/_SUCCESS"):
            spark.range(self.buckets, self.buckets + 1).coalesce(1).write.mode("overwrite").parquet(meta)
        return spark.read.parquet(meta).first()[0]

    def _stored(self, batch: DataFrame) -> DataFrame:
        if not self.props:
            return batch
        return batch.withColumn("sequences_", F.transform_values(self.props, lambda k, v: F.col(self.sequence)))

    def _latest(self, rows: DataFrame) -> DataFrame:
        by = [*self.key, PLACE]
        if not self.props:
            rest = [c for c in rows.columns if c not in (*by, self.sequence)]
            # Of equal sequences the greatest row stays, so that a rerun gives the same.
            last = rows.groupBy(*by).agg(F.max(F.struct(self.sequence, *rest)).alias("last"))
            return last.select(*by, "last.*").select(*rows.columns)
        entries = rows.select(*by, self.sequence, F.explode_outer(F.map_entries(self.props)).alias("e"), "sequences_")
        entries = entries.select(*by, self.sequence, F.col("e.key").alias("k"), F.struct(F.col("sequences_")[F.col("e.key")].alias("s"), F.col("e.value").alias("v")).alias("x"))
        last = entries.groupBy(*by, "k").agg(F.max("x").alias("x"), F.max(self.sequence).alias(self.sequence))
        every = F.array_sort(F.filter(F.collect_list(F.struct("k", "x")), lambda e: e["k"].isNotNull()))
        out = last.groupBy(*by).agg(F.max(self.sequence).alias(self.sequence), every.alias("e"))
        take = lambda name: F.map_from_entries(F.transform("e", lambda e: F.struct(e["k"], e["x"][name])))
        return out.select(*by, self.sequence, take("v").alias(self.props), take("s").alias("sequences_")).select(*rows.columns)


#: The fields of a chunk that a store keeps beside its text.
METADATA = {"source_path": "string", "relative_path": "string", "chunk_index": "int", "chunk_kind": "string", "section": "string", "line_start": "int", "line_end": "int", "content_hash": "string"}


def chunk_rows(chunks: DataFrame, sequence: Column) -> DataFrame:
    """chunk_id, content, metadata (of every field, '' or 0 or line 1 where it is missing) and sequence."""
    missing = {"string": F.lit(""), "int": F.lit(0)}

    def of(name: str, kind: str) -> Column:
        default = F.lit(1) if name.startswith("line_") else missing[kind]
        own = F.col(name) if name in chunks.columns else F.col("relative_path") if name == "source_path" and "relative_path" in chunks.columns else F.lit(None)
        return F.coalesce(own.cast(kind), default).alias(name)

    return chunks.select("chunk_id", F.coalesce("content", F.lit("")).alias("content"), F.struct(*[of(*x) for x in METADATA.items()]).alias("metadata"), sequence.cast("bigint").alias("sequence"))


def chunk_table(path: str, buckets: int = BUCKETS) -> VersionedTable:
    return VersionedTable(path, ["chunk_id"], "sequence", buckets=buckets)


def graph_tables(path: str, buckets: int = BUCKETS) -> tuple[VersionedTable, VersionedTable]:
    """nodes and edges, whose properties are versions of their own."""
    from loomgraph.operators.graph import EDGE_KEY, NODE_KEY

    return VersionedTable(f"{path}/nodes", NODE_KEY, "sequence", "props", buckets), VersionedTable(f"{path}/edges", EDGE_KEY, "sequence", "props", buckets)
