"""Scratch tables in the folder that spark.checkpoint.dir names, which driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder; only a local session, as in tests, may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, partitions: list[str] | None = None) -> DataFrame:
    """df written as Parquet and read back: its plan ends there, and a lost executor's part can be read again."""
    path = path or shared_folder(df.sparkSession)
    df.write.partitionBy(*(partitions or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
