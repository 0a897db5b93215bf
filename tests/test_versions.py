"""Versioned tables, and trends as streaming state."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import governance, versioned
from loomgraph.plans.registry import DAY_METRICS, _daily, chunks

SHAPE = "k1 string, k2 int, v string, seq bigint"


def files(path):
    return set(glob.glob(f"{path}/rows/*/*.parquet"))


def test_latest_version_stays(spark, tmp_path):
    rng = random.Random(1)
    table, truth = versioned.VersionedTable(str(tmp_path / "t"), ["k1", "k2"], "seq", buckets=8), {}
    for step in range(5):
        rows = [(rng.choice(["a", "b", None]), rng.randrange(12), f"v{step}-{i}", rng.randrange(20)) for i in range(25)]
        for a, b, v, s in rows:
            truth[a, b] = max(truth.get((a, b), (-1, "")), (s, v))
        table.upsert(spark.createDataFrame(rows, SHAPE))
        assert {(r.k1, r.k2): (r.seq, r.v) for r in table.read(spark).collect()} == truth
    again = spark.createDataFrame(rows, SHAPE)
    table.upsert(again)  # a batch that runs again changes nothing
    assert {(r.k1, r.k2): (r.seq, r.v) for r in table.read(spark).collect()} == truth
    assert table.upsert(again.limit(0)) == []
    keys = spark.createDataFrame([("a", 1), ("zz", 1)], "k1 string, k2 int")
    assert {(r.k1, r.k2) for r in table.of_keys(keys).collect()} == {("a", 1)} & set(truth)


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = versioned.VersionedTable(str(tmp_path / "t"), ["k1"], "seq", buckets=32)
    table.upsert(spark.range(2000).selectExpr("CAST(id AS string) AS k1", "'old' AS v", "0L AS seq"))
    before = files(table.path)
    touched = table.upsert(spark.createDataFrame([("7", "new", 1), ("fresh", "new", 1)], "k1 string, v string, seq bigint"))
    after = files(table.path)
    assert 1 <= len(touched) <= 2 and len(after - before) == len(before - after) == len(touched)
    assert all(any(f"bucket_of_key={b}/" in f for b in touched) for f in after ^ before)
    rows = {r.k1: r.v for r in table.read(spark).collect()}
    assert len(rows) == 2001 and [k for k, v in rows.items() if v == "new"] and rows["7"] == rows["fresh"] == "new"
    # The number of buckets belongs to the table.
    other = versioned.VersionedTable(table.path, ["k1"], "seq", buckets=5)
    other.upsert(spark.createDataFrame([("7", "newer", 2)], "k1 string, v string, seq bigint"))
    assert table.read(spark).filter("k1 = '7'").collect()[0].v == "newer"


def test_properties_are_versions_of_their_own(spark, tmp_path):
    nodes, _ = versioned.graph_tables(str(tmp_path / "g"), 4)
    shape = "label string, name string, props map<string,string>, sequence bigint"
    for rows in ([("A", "x", {"p": "2", "q": "2"}, 2), ("A", "y", {}, 1)], [("A", "x", {"p": "1", "r": "1"}, 1)], [("A", "x", {"q": "3"}, 3), ("B", "x", None, 3)]):
        nodes.upsert(spark.createDataFrame(rows, shape))
    got = {(r.label, r["name"]): (dict(r.props or {}), r.sequence) for r in nodes.read(spark).collect()}
    assert got == {("A", "x"): ({"p": "2", "q": "3", "r": "1"}, 3), ("A", "y"): ({}, 1), ("B", "x"): ({}, 3)}


def test_chunks_keep_their_metadata(spark, sf_dir, tmp_path):
    rows = chunks(spark, sf_dir)
    table = versioned.chunk_table(str(tmp_path / "c"), 4)
    table.upsert(versioned.chunk_rows(rows, F.lit(1)))
    table.upsert(versioned.chunk_rows(rows.filter("chunk_index = 0").withColumn("content", F.lit("changed")), F.lit(2)))
    table.upsert(versioned.chunk_rows(rows.withColumn("content", F.lit("late")), F.lit(0)))
    got = table.read(spark)
    assert got.count() == rows.count() and got.filter("content = 'late'").isEmpty()
    assert got.filter("content = 'changed'").count() == rows.filter("chunk_index = 0").count()
    own = got.select("chunk_id", "metadata.*").select("chunk_id", "relative_path", "chunk_index", "section", "line_start", "line_end")
    assert own.exceptAll(rows.select(*own.columns)).isEmpty()
    bare = versioned.chunk_rows(spark.createDataFrame([("c", None)], "chunk_id string, content string"), F.lit(1)).first()
    assert (bare.content, bare.metadata.relative_path, bare.metadata.chunk_index, bare.metadata.line_start) == ("", "", 0, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_trend_state_equals_the_windowed_trend(spark, sf_dir, tmp_path, rocks):
    """Days in three arrivals, with a restart between them, give what the window over the whole table gives."""
    from loomgraph.streaming.trends import drift_stream

    daily = _daily(spark, sf_dir).withColumn("day", F.date_format("day", "yyyy-MM-dd")).filter("day IS NOT NULL").cache()
    days = sorted(r.day for r in daily.select("day").distinct().collect())
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 9), (9, 10), (10, len(days))):
        daily.filter(F.col("day").isin(days[low:high])).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(daily.schema).parquet(source)
        query = drift_stream(stream, "event_type", "day", DAY_METRICS, keep=5).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    whole = governance.trend(daily, "event_type", "day", DAY_METRICS, keep=10_000)
    columns = ["event_type", "day", *[f"delta_{m}" for m in DAY_METRICS]]
    expected = whole.select(*columns, governance.drift(whole.columns).alias("drift_flagged"))
    got = spark.read.parquet(out).select(*expected.columns)
    assert got.count() == expected.count() == daily.count() and len(days) > 12
    key = lambda df: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    assert key(got) == key(expected)
    assert got.filter("drift_flagged").count() > 0
