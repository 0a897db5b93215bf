"""Shards against a brute-force definition, with hot groups, ties, nulls and forced subdivision."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import sharding
from loomgraph.llm.common import materialize


def brute(rows, shards):
    """(doc_id, size, crc, shard, slot) of (doc_id, text) rows."""
    rows = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), -(1 << 63) if i is None else i, i, t or "") for i, t in rows)
    sizes = [len(t.encode()) + 8 for *_, t in rows]
    total, at, start, group = sum(sizes), 0, [], {}
    for (h, *_), n in zip(rows, sizes, strict=True):
        start.append(at)
        first, length = group.get(h, (at, 0))
        group[h] = (first, length + n)
        at += n
    out, slots = [], {}
    for (h, _, i, t), a, n in zip(rows, start, sizes, strict=True):
        first, length = group[h] if group[h][1] * shards * 100 <= total else (a, n)
        shard = shards * (2 * first + length) // (2 * total)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i, n, zlib.crc32(t.encode()), shard, slots[shard]))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def rows(n=3000):
    rng = random.Random(5)
    words = ["ore", "wind", "É", "日本", "lake ", "\n", "x" * 40]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 400])))) for i in range(n // 2)]
    out += [(i, "the same text in a third of all rows") for i in range(n // 2, n * 5 // 6)]
    out += [(None, "no id")] * 300 + [(7, "no id")] * 50 + [(i, None) for i in range(20)] + [(1, "y" * 60_000)]
    return out


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_equals_brute_force(spark, shards):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(5).selectExpr("*", "1 AS h", "'x' AS shard", "2 AS n")
    out = sharding.shard_documents(docs, shards)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out.collect()]
    assert sorted(found, key=key) == sorted(brute(data, shards), key=key)
    assert {(r.law, r.grown_shard) for r in out.select("law", "grown_shard").distinct().collect()} == {("bytes", None)}


def test_ranges_are_subdivided(spark):
    """A sample of few keys leaves overfull ranges; they are subdivided, hot groups too, and the result stays."""
    data = rows()
    records = materialize(sharding.keyed(spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)))
    n, size = records.agg(F.count("*"), F.sum("size")).first()
    coarse = sharding.quantiles(sharding.drawn(records, n, size, 0.5 * 40 / 2, 0), 40)
    bounds, counts = sharding.splitters(records, n, size, 40, drawn_each=0.5, few=10)
    assert len(bounds) > len(set(coarse))
    assert bounds == sorted(set(bounds)) and sum(c[0] for c in counts) == n and sum(c[1] for c in counts) == size
    big = 60_008 / size
    assert max(c[0] / n + c[1] / size for c in counts) <= 2 * 2 / 40 * 1.5 + big
    hot = int(hashlib.md5(b"the same text in a third of all rows").hexdigest()[:15], 16)
    assert sum(b[0] == hot for b in bounds) > 3
    for drawn_each, parts in ((0.5, 40), (30, 100), (30, 1)):
        out = sharding.assigned(records, 24, parts, drawn_each)
        found = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out.collect()]
        assert sorted(found, key=key) == sorted(brute(data, 24), key=key)


def test_sample_follows_size(spark):
    docs = spark.createDataFrame([(i, str(i) * (100 if i % 10 == 0 else 2)) for i in range(100_000, 104_000)], "doc_id bigint, text string")
    records = materialize(sharding.keyed(docs))
    n, size = records.agg(F.count("*"), F.sum("size")).first()
    large = records.filter("size > 500").select("n").collect()
    found = sharding.drawn(records, n, size, 400, 3)
    assert found == sharding.drawn(records.repartition(7), n, size, 400, 3)
    assert 700 < len(found) < 900 and abs(sum(w for _, w in found) - 2) < 0.3
    part = len({k[2] for k, _ in found} & {r.n for r in large}) / len(found)
    assert abs(part - records.filter("size > 500").agg(F.sum(sharding.weight(n, size))).first()[0] / 2) < 0.1


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.shard_documents(none).count() == 0
    one = sharding.shard_documents(spark.createDataFrame([(3, "abc")], "doc_id bigint, text string")).first()
    assert (one.doc_id, one.size, one.shard, one.slot) == (3, 11, 12, 0)


def test_write_shards(spark, tmp_path):
    data = rows(600)
    docs = spark.createDataFrame([(i, t, "own", j) for j, (i, t) in enumerate(data)], "doc_id bigint, text string, shard string, Slot int").repartition(3)
    slot, shard = sharding.write_shards(docs, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {"doc_id", "text", "shard", "Slot", slot, shard} and len(back.columns) == 6
    found = [(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()), r[shard], r[slot]) for r in back.collect()]
    assert sorted(found, key=key) == sorted(brute(data, 6), key=key)
    assert sorted(r["Slot"] for r in back.collect()) == list(range(len(data)))
