"""Entity resolution: canonical keys, greedy Jaccard merges, canonical names, pair metrics.

entities: entity_id, name.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.lexicon import Entry
from loomgraph.functions.text import trigrams
from loomgraph.operators.tables import shared_folder

THRESHOLD = 0.70


def plain_key(name: Column) -> Column:
    """Lower-case words joined by _."""
    words = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    return F.when(words == "", "unknown").otherwise(F.replace(words, F.lit(" "), F.lit("_")))


def alias_table(spark: SparkSession, lexicon: list[Entry]) -> DataFrame:
    """key, canonical_key: a later entry's alias goes over an earlier one's."""
    rows = [(i, e.canonical, a) for i, e in enumerate(lexicon) for a in (e.canonical, *e.aliases)]
    table = spark.createDataFrame(rows, "ord int, canonical string, alias string")
    return table.groupBy(plain_key(F.col("alias")).alias("key")).agg(F.max_by(plain_key(F.col("canonical")), "ord").alias("canonical_key"))


def canonical_keys(entities: DataFrame, lexicon: list[Entry]) -> DataFrame:
    """entities with key: by the dictionary (fixed, so broadcast), else by substitution."""
    rows = entities.withColumn("key", plain_key(F.col("name")))
    fixed = F.replace(F.replace("key", F.lit("risk_parity"), F.lit("riskparity")), F.lit("value_at_risk"), F.lit("var"))
    found = rows.join(F.broadcast(alias_table(entities.sparkSession, lexicon)), "key", "left")
    return found.withColumn("key", F.coalesce("canonical_key", fixed)).drop("canonical_key")


def groups(keyed: DataFrame) -> DataFrame:
    """key, name (the shortest, then first), n."""
    return keyed.groupBy("key").agg(F.min(F.struct(F.length("name").alias("l"), "name"))["name"].alias("name"), F.count("*").alias("n"))


def similar_keys(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a < b, keys whose names' word sets have Jaccard >= threshold; found by shared words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0)))
    sets = reps.select("key", words.alias("words"))
    # Prefix filter: similar sets share one of each other's first rarest words.
    rows = sets.select("key", F.size("words").alias("size"), F.explode("words").alias("word"))
    common = rows.groupBy("word").agg(F.count("*").alias("df"))
    order = Window.partitionBy("key").orderBy("df", "word")
    prefix = rows.join(common, "word").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1)
    left = prefix.select(F.col("key").alias("a"), "word", F.col("size").alias("na"))
    right = prefix.select(F.col("key").alias("b"), "word", F.col("size").alias("nb"))
    close = (F.col("a") < F.col("b")) & (F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na"))
    pairs = left.join(right, "word").filter(close).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("words").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("words").alias("y")), "b")
    return both.filter(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")) >= threshold).select("a", "b")


def components(pairs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, component (its smallest key) of all keys in pairs (a, b), by alternating stars.

    Each round links every key's larger, then its smaller, neighbours with its smallest one, which
    halves long chains; rounds grow with the logarithm of a chain's length.
    """
    edges = keep(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    seen = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        edges = keep(small.filter("u <> v").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("key"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct())


#: Pairs of a component that one task merges; a larger one is merged in rounds over all executors.
MERGED_AT_ONCE = 200_000


def greedy_leaders(reps: DataFrame, pairs: DataFrame, materialize: Callable[[DataFrame], DataFrame] | None = None, at_once: int = MERGED_AT_ONCE) -> DataFrame:
    """key, leader: in key order, each key not yet absorbed absorbs its later similar keys.

    Keys meet only within a connected component, so each component of up to `at_once` pairs is
    merged in one pass by one task; larger ones go by rounds (in_rounds), with the same result.
    materialize cuts the lineage of a step (default: a checkpoint in the session's checkpoint folder).
    """
    keep = materialize or cut
    pairs = keep(pairs.select("a", "b"))
    of = keep(components(pairs, keep))
    owned = pairs.join(of.withColumnRenamed("key", "a"), "a")
    size = owned.groupBy("component").agg(F.count("*").alias("n"))
    small = owned.join(size.filter(F.col("n") <= at_once), "component", "left_semi")
    merged = small.groupBy("component").applyInArrow(_merged, "key string, leader string")
    large = keep(owned.join(size.filter(F.col("n") > at_once), "component", "left_semi").select("a", "b"))
    if not large.isEmpty():
        ends = large.select(F.col("a").alias("key")).union(large.select("b")).distinct()
        merged = merged.unionByName(in_rounds(ends, large, keep))
    return reps.select("key").join(merged, "key", "left").withColumn("leader", F.coalesce("leader", "key"))


def _merged(pairs: pa.Table) -> pa.Table:
    """The greedy merge of one component."""
    later: dict[str, list[str]] = {}
    for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
        later.setdefault(a, []).append(b)
        later.setdefault(b, [])
    leader: dict[str, str] = {}
    for key in sorted(later, key=lambda k: k.encode()):
        if leader.setdefault(key, key) == key:
            for b in later[key]:
                leader.setdefault(b, key)
    return pa.table({"key": pa.array(leader.keys(), pa.string()), "leader": pa.array(leader.values(), pa.string())})


def in_rounds(reps: DataFrame, pairs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """greedy_leaders without groups: a key is decided once all its smaller similar keys are.

    It joins the smallest of them that is a leader, or leads. Each round decides at least the
    smallest undecided key of every component.
    """
    state = keep(reps.select("key").withColumn("leader", F.lit(None).cast("string")))
    lower = pairs.select(F.col("b").alias("key"), "a")
    while True:
        known = state.select(F.col("key").alias("a"), F.col("leader").alias("a_leader"))
        seen = lower.join(known, "a").groupBy("key").agg(
            F.min(F.when(F.col("a_leader") == F.col("a"), F.col("a"))).alias("first_leader"),
            F.min(F.when(F.col("a_leader").isNull(), F.col("a"))).alias("first_open"),
        )
        rows = state.join(seen, "key", "left")
        ready = F.col("first_open").isNull() | (F.col("first_leader") < F.col("first_open"))
        state = keep(rows.select("key", F.coalesce("leader", F.when(ready, F.coalesce("first_leader", "key"))).alias("leader")))
        if state.filter("leader IS NULL").isEmpty():
            return state


def cut(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, its plan cut off."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark).rsplit("/", 1)[0])
    return df.checkpoint()


#: Hashes of a name's trigrams, in bands of so many: names that agree in a band are candidates.
BANDS, IN_BAND = 24, 2
#: Keys of a band's value that are all compared; of more, each with its next `NEIGHBOURS` by name.
COMPARED, NEIGHBOURS = 50, 20


def all_pairs(reps: DataFrame) -> DataFrame:
    """All pairs a < b of keys, for inputs so small that a model may be asked about each."""
    return reps.select(F.col("key").alias("a")).join(reps.select(F.col("key").alias("b")), F.col("a") < F.col("b"))


def blocked_pairs(reps: DataFrame, bands: int = BANDS, in_band: int = IN_BAND) -> DataFrame:
    """Candidate pairs a < b: names that share the smallest trigram hashes of a band, or sort side by side.

    A band's value that many names have is not multiplied out: there each name meets the next ones in
    order of name. `pair_recall` tells what part of all pairs that a model calls the same is found.
    """
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("name"), "[^\\p{L}\\p{N}]+", " ")), F.lit(" "))
    words = F.array_join(F.array_sort(F.split(F.trim(plain), " ")), " ")
    seeds = range(bands * in_band)
    hashes = [F.array_min(F.transform("grams", _seeded(s))) for s in seeds]
    rows = reps.select("key", "name", words.alias("words"), trigrams(plain).alias("grams"))
    band = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(*hashes[i * in_band : (i + 1) * in_band]).alias("value")) for i in range(bands)])
    # Two names of the same words in another order are side by side in this list.
    sorted_by = F.struct(F.lit(-1).alias("band"), F.xxhash64("words").alias("value"))
    held = rows.filter(F.size("grams") > 0).select("key", "name", F.explode(F.concat(band, F.array(sorted_by))).alias("x")).select("key", "name", "x.band", "x.value")
    place = Window.partitionBy("band", "value").orderBy("name", "key")
    ranked = held.withColumns({"r": F.row_number().over(place), "n": F.count("*").over(Window.partitionBy("band", "value"))}).filter("n > 1")
    reach = F.when(F.col("n") <= COMPARED, F.col("n")).otherwise(F.lit(NEIGHBOURS))
    later = ranked.select("band", "value", F.col("key").alias("x"), F.explode(F.sequence(F.col("r") + 1, F.least(F.col("n"), F.col("r") + reach))).alias("r")).join(ranked.select("band", "value", "r", F.col("key").alias("y")), ["band", "value", "r"])
    return later.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()


def _seeded(seed: int) -> Callable[[Column], Column]:
    return lambda g: F.xxhash64(F.lit(seed), g)


def pair_recall(found: DataFrame, truth: DataFrame) -> float:
    """The part of the pairs of truth that found has; 1 without any."""
    row = truth.select("a", "b").join(found.select("a", "b").distinct().withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return row.hits / row.n if row.n else 1.0


def assisted_pairs(reps: DataFrame, candidates: DataFrame, same: Callable[[Column, Column], Column]) -> DataFrame:
    """Of candidate key pairs (a, b), those whose names a model (an expression or a pandas_udf) calls the same."""
    named = candidates.join(reps.select(F.col("key").alias("a"), F.col("name").alias("x")), "a").join(reps.select(F.col("key").alias("b"), F.col("name").alias("y")), "b")
    return named.filter(same(F.col("x"), F.col("y"))).select("a", "b")


def resolve(entities: DataFrame, lexicon: list[Entry], threshold: float = THRESHOLD, same: Callable[[Column, Column], Column] | None = None, candidates: Callable[[DataFrame], DataFrame] = blocked_pairs) -> DataFrame:
    """entities with cluster, the leading key of their group.

    same: a model's judgement of two names, asked about the candidates (all_pairs for small inputs).
    """
    keyed = canonical_keys(entities, lexicon)
    reps = groups(keyed)
    pairs = similar_keys(reps, threshold)
    if same is not None:
        pairs = pairs.union(assisted_pairs(reps, candidates(reps), same)).distinct()
    leaders = greedy_leaders(reps, pairs)
    return keyed.join(leaders, "key").withColumn("cluster", F.concat(F.lit("canon::"), "leader")).drop("key", "leader")


def canonical(resolved: DataFrame) -> DataFrame:
    """cluster, canonical_name (the shortest, then first), aliases, entity_ids."""
    out = resolved.groupBy("cluster").agg(F.min(F.struct(F.length("name").alias("l"), "name"))["name"].alias("canonical_name"), F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    return out.select("cluster", "canonical_name", F.array_remove("names", F.col("canonical_name")).alias("aliases"), "entity_ids")


def predicted_pairs(resolved: DataFrame) -> DataFrame:
    """id_a < id_b within a cluster: the operator's defined output is the pairs themselves."""
    ids = resolved.select("cluster", "entity_id").distinct()
    return ids.select("cluster", F.col("entity_id").alias("id_a")).join(ids.select("cluster", F.col("entity_id").alias("id_b")), "cluster").filter("id_a < id_b").select("id_a", "id_b")


def group_pair_counts(resolved: DataFrame, gold: str) -> DataFrame:
    """predicted, actual, both: numbers of pairs within clusters, within gold classes, within both.

    n (n - 1) / 2 of each group's size: the pairs are not made, so a large group costs its rows.
    """
    pairs = lambda *keys: resolved.groupBy(*keys).agg(F.countDistinct("entity_id").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))
    out = pairs("cluster").select(F.col("pairs").alias("predicted"))
    return out.join(pairs(gold).select(F.col("pairs").alias("actual")), how="cross").join(pairs("cluster", gold).select(F.col("pairs").alias("both")), how="cross")


def audit(resolved: DataFrame, metrics: DataFrame, now: Column) -> DataFrame:
    """One row for the append-only log: entities, clusters and merged ones, with the pair metrics, at a time."""
    counts = resolved.agg(F.count("*").alias("n_entities"), F.countDistinct("cluster").alias("n_clusters")).withColumn("n_merged", F.col("n_entities") - F.col("n_clusters"))
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return counts.join(F.broadcast(metrics), how="cross").withColumn("timestamp_utc", stamp)


def pair_metrics(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of predicted, actual and both."""
    p = F.col("both") / F.greatest(F.lit(1), F.col("predicted"))
    r = F.col("both") / F.greatest(F.lit(1), F.col("actual"))
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return counts.select("predicted", "actual", "both", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))
