"""Operator 11, shards of near-equal bytes by sampled splitters, with DataFrame functions only.

Records are ordered by (hash of the text, doc_id), so that equal texts stand side by side. A
size-weighted sample of the keys gives quantile boundaries; these split the records into ranges;
a range that exact counts show to be overfull is sampled again and subdivided. Ranges laid end to
end have exact offsets from sums over their records, and the shards cut that line at equal byte
marks. Only sampled keys and one count per range (at most `RANGES` a shard) reach the driver.

The law is `bytes`: a group of equal texts lies in the shard that its middle byte falls into, so a
shard departs from the mean by half a group, or half a record, at each end. Groups of more than
1 / `WHOLE` of a shard are cut between records. The result depends on the records alone, neither on
the sample nor on partitions.

Defined results: a null text has 8 bytes and the hash and checksum of an empty one; null ids come
first in their group; rows with equal ids and texts are interchangeable and get a slot each; an
empty table gives an empty table; a record above a shard's share leaves shards empty; other columns
can't clash, as only the id and the text are read (`write_shards` keeps all columns).
"""

from __future__ import annotations

import json
import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import Scratch

SHARDS = 24
#: Bytes that a record takes besides its text.
OVERHEAD = 8
#: A group of equal texts stays whole up to this part of a shard's bytes.
WHOLE = 100
#: Ranges of a shard, at least and at most, and the records that a range should hold between.
FEWEST, RANGES, RANGE_ROWS = 8, 512, 200_000
#: Sampled keys for each boundary.
DRAWN = 24
#: A range of more than this many times the mean rows and bytes, and of more rows than `FEW`, is overfull; rounds of subdividing.
OVERFULL, FEW, ROUNDS = 2.0, 100, 4

_KEY = ("h", "k", "n")
Key = tuple[int, int, int]
LEAST = -(1 << 63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", place: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32 and the record's key: h (60 bits of the text's MD5), k (the id), n (its place in the input, or `place`)."""
    text = F.coalesce("text", F.lit(""))
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    place = F.monotonically_increasing_id() if place is None else place
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), place.alias("n")).select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        h.alias("h"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)).alias("k"),
        "n",
    )


def weight(rows: int, size: int) -> Column:
    """A record's part of all bytes plus its part of all records, so that ranges are even in both; 2 in all."""
    return F.col("size") / F.lit(float(size)) + F.lit(1.0 / rows)


def drawn(records: DataFrame, rows: int, size: int, rate: float, salt: int) -> list[tuple[Key, float]]:
    """Keys sampled with probability rate x weight (at most 1), ascending, each with the weight it stands for.

    The draw is a hash of the key: a task that runs again draws the same.
    """
    w = weight(rows, size)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(salt), *map(F.col, _KEY)), 11) / F.lit(float(1 << 53))
    chosen = records.filter(u < w * F.lit(rate)).select(*_KEY, F.greatest(w, F.lit(1 / rate)).alias("w"))
    return sorted(((r.h, r.k, r.n), r.w) for r in chosen.collect())


def quantiles(sample: list[tuple[Key, float]], parts: int) -> list[Key]:
    """Keys that cut the sample into parts of equal weight: a range starts at each."""
    total = sum(w for _, w in sample)
    marks, out = iter(range(1, parts)), []
    mark = next(marks, None)
    for (key, _), reached in zip(sample, accumulate(w for _, w in sample), strict=True):
        while mark is not None and reached * parts >= mark * total:
            out.append(key)
            mark = next(marks, None)
    return out


def snapped(keys: list[Key]) -> list[Key]:
    """The boundaries at these keys: the first key in each group moves to the group's start, so that only groups with several are cut."""
    ordered = sorted(set(keys))
    return sorted({(b[0], LEAST, -1) if i == 0 or ordered[i - 1][0] != b[0] else b for i, b in enumerate(ordered)})


def ranged(records: DataFrame, bounds: list[Key]) -> DataFrame:
    """records with `range`, the number of boundaries at or below the key, found by halving."""
    if not bounds:
        return records.withColumn("range", F.lit(0))
    text = json.dumps([{"h": h, "k": k, "n": n} for h, k, n in bounds])
    line = F.from_json(F.lit(text), "array<struct<h: bigint, k: bigint, n: bigint>>")  # folded to a constant
    steps, key = F.array(*(F.lit(1 << j) for j in reversed(range(len(bounds).bit_length())))), F.struct(*_KEY)

    def halved(at: Column, step: Column) -> Column:
        return F.when(F.get(line, at + step - 1) <= key, at + step).otherwise(at)

    return records.withColumn("range", F.aggregate(steps, F.lit(0), halved))


def counted(records: DataFrame, bounds: list[Key]) -> list[tuple[int, int]]:
    """Rows and bytes of every range."""
    found = {r.range: (r.rows, r.size) for r in ranged(records, bounds).groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).collect()}
    return [found.get(i, (0, 0)) for i in range(len(bounds) + 1)]


def splitters(records: DataFrame, rows: int, size: int, parts: int, drawn_each: int = DRAWN, few: int = FEW) -> tuple[list[Key], list[tuple[int, int]]]:
    """Boundaries of about `parts` ranges, overfull ones subdivided, and each range's rows and bytes."""
    mean, rate = 2 / parts, drawn_each * parts / 2
    share = lambda c: c[0] / rows + c[1] / size
    keys = quantiles(drawn(records, rows, size, rate, 0), parts)
    for salt in range(1, ROUNDS + 1):
        bounds = snapped(keys)
        counts = counted(records, bounds)
        over = [i for i, c in enumerate(counts) if c[0] > few and share(c) > OVERFULL * mean]
        if not over or salt == ROUNDS:
            break
        edges = [(LEAST, LEAST, -1), *bounds, (-LEAST, 0, 0)]
        again = drawn(ranged(records, bounds).filter(F.col("range").isin(over)), rows, size, 8**salt * rate, salt)
        for i in over:
            keys += quantiles([x for x in again if edges[i] <= x[0] < edges[i + 1]], math.ceil(share(counts[i]) / mean))
    return bounds, counts


def assigned(records: DataFrame, shards: int = SHARDS, parts: int | None = None, drawn_each: int = DRAWN, scratch: Scratch | None = None) -> DataFrame:
    """n, doc_id, size, text_crc32, shard and slot of each of the written `keyed` records."""
    spark = records.sparkSession
    scratch = scratch or Scratch(spark)
    rows, size = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shape = ["n", "doc_id", "size", "text_crc32"]
    if not rows:
        return records.select(*shape, F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    parts = parts or shards * min(RANGES, max(FEWEST, math.ceil(rows / shards / RANGE_ROWS)))
    bounds, counts = splitters(records, rows, size, parts, drawn_each)
    offsets = list(zip(accumulate((c[0] for c in counts), initial=0), accumulate((c[1] for c in counts), initial=0), strict=True))
    starts = spark.createDataFrame([(i, *o) for i, o in enumerate(offsets[:-1])], "range int, range_row bigint, range_byte bigint")

    inside = Window.partitionBy("range").orderBy(*_KEY)
    group = Window.partitionBy("range", "h")
    placed = ranged(records, bounds).withColumns({"row": F.row_number().over(inside) - 1, "byte": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    placed = placed.withColumns({"group_byte": F.min("byte").over(group), "group_size": F.sum("size").over(group)})
    placed = placed.join(F.broadcast(starts), "range").withColumns({c: F.col(c) + F.col(o) for c, o in (("row", "range_row"), ("byte", "range_byte"), ("group_byte", "range_byte"))})
    placed = scratch.keep(placed.select(*shape, "h", "row", "byte", "group_byte", "group_size"))

    # Groups that a boundary cuts are those of boundaries inside groups, at most one a range.
    cut = sorted({b[0] for b in bounds if b[2] >= 0})
    if cut:
        of = spark.createDataFrame([(h,) for h in cut], "h bigint")
        whole = placed.join(F.broadcast(of), "h", "left_semi").groupBy("h").agg(F.min("byte").alias("_byte"), F.sum("size").alias("_size"))
        placed = placed.join(F.broadcast(whole), "h", "left").withColumns({"group_byte": F.coalesce("_byte", "group_byte"), "group_size": F.coalesce("_size", "group_size")})
    kept = F.col("group_size") * (shards * WHOLE) <= size
    first, length = F.when(kept, F.col("group_byte")).otherwise(F.col("byte")), F.when(kept, F.col("group_size")).otherwise(F.col("size"))
    middle = placed.select(*shape, "row", (first * 2 + length).alias("middle"))
    sharded = middle.withColumn("shard", F.expr(f"cast(({shards} * middle) div {2 * size} as int)"))
    begin = sharded.groupBy("shard").agg(F.min("row").alias("begin"))
    return sharded.join(F.broadcast(begin), "shard").select(*shape, "shard", (F.col("row") - F.col("begin")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    scratch = Scratch(docs.sparkSession)
    out = assigned(scratch.keep(keyed(docs, id_col, text_col)), shards, scratch=scratch)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, str]:
    """Write all columns of docs in a folder a shard under path, in order of slots; the names of the columns of slots and shards."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = scratch.keep(docs.toDF(*at.values()).withColumn("n", F.monotonically_increasing_id()))
    keys = scratch.keep(keyed(rows, at[id_col], at[text_col], F.col("n")))
    where = assigned(keys, shards, scratch=scratch).select("n", "shard", "slot")
    parts = max(shards, spark.sparkContext.defaultParallelism)
    joined = rows.join(where, "n").repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot")
    slot, shard = (f"{'_' * sum(c.lower().lstrip('_') == name for c in docs.columns)}{name}" for name in ("slot", "shard"))
    joined.select(*(F.col(new).alias(old) for old, new in at.items()), F.col("slot").alias(slot), F.col("shard").alias(shard)).write.partitionBy(shard).parquet(path)
    scratch.clear()
    return slot, shard
