"""Components, greedy merges without rounds, and candidates for a model with their recall."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import lexicon as lx
from loomgraph.operators import resolution
from loomgraph.operators.tables import written
from loomgraph.sources import files as fs


def greedy(keys, pairs):
    near, leader = {}, {}
    for a, b in pairs:
        near.setdefault(min(a, b), set()).add(max(a, b))
    for k in sorted(keys):
        if leader.setdefault(k, k) == k:
            for b in sorted(near.get(k, ())):
                leader.setdefault(b, k)
    return leader


class Counted:
    def __init__(self):
        self.n = 0

    def __call__(self, df):
        self.n += 1
        return written(df)


def frames(spark, keys, pairs):
    return spark.createDataFrame([(k, k) for k in keys], "key string, name string"), spark.createDataFrame(pairs or [("", "")], "a string, b string").filter("a <> ''")


@pytest.mark.parametrize("at_once", [0, 3, 200_000])
def test_merges_equal_the_specification(spark, at_once):
    rng = random.Random(at_once)
    keys = [f"{'éAz'[i % 3]}{i:03d}" for i in range(90)]
    pairs = list({tuple(sorted(rng.sample(keys, 2))) for _ in range(60)})
    reps, links = frames(spark, keys, pairs)
    got = {r.key: r.leader for r in resolution.greedy_leaders(reps, links, written, at_once).collect()}
    assert got == greedy(keys, pairs)
    assert {r.key: r.leader for r in resolution.greedy_leaders(reps, links.limit(0), written, at_once).collect()} == {k: k for k in keys}


def test_steps_do_not_grow_with_a_chain(spark):
    steps = []
    for n in (30, 480):
        keys = [f"k{i:04d}" for i in range(n)]
        pairs = list(zip(keys, keys[1:], strict=False))
        keep = Counted()
        got = {r.key: r.leader for r in resolution.greedy_leaders(*frames(spark, keys, pairs), keep).collect()}
        assert got == greedy(keys, pairs)
        steps.append(keep.n)
    assert steps[1] <= steps[0] + 6 and steps[1] < 20


def test_components_of_shuffled_chains_and_stars(spark):
    rng = random.Random(3)
    names = [f"n{i:03d}" for i in range(200)]
    rng.shuffle(names)
    pairs = [tuple(sorted(p)) for p in zip(names[:100], names[1:100], strict=False)] + [tuple(sorted((names[100], x))) for x in names[101:170]] + [("x", "y"), ("x", "y")]
    got = {r.key: r.component for r in resolution.components(spark.createDataFrame(pairs, "a string, b string"), written).collect()}
    want = {k: min(group) for group in (names[:100], names[100:170], ["x", "y"]) for k in group}
    assert got == want


def typed(rng, name):
    i = rng.randrange(1, len(name) - 1)
    return rng.choice([name[:i] + name[i + 1 :], name[:i] + rng.choice("aeiou") + name[i:], name[: i - 1] + name[i] + name[i - 1] + name[i + 1 :], name.upper(), " ".join(reversed(name.split()))])


def test_candidates_reach_their_recall(spark):
    rng = random.Random(8)
    syllables = ["ra", "to", "mi", "nel", "dor", "sha", "ku", "ven", "pol", "ist", "gra", "bu", "fen", "lo", "wic", "har", "ost", "quin", "ber", "sol", "tem", "ja", "ulf", "cor"]
    names = sorted({" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(2, 4))) for _ in range(300)})
    rows = [(f"{i}/{j}", name if j == 0 else typed(rng, name)) for i, name in enumerate(names) for j in range(3)]
    reps = spark.createDataFrame(rows, "key string, name string").cache()
    same = lambda x, y: F.levenshtein(F.lower(x), F.lower(y)) <= 2
    found = resolution.blocked_pairs(reps).cache()
    truth = resolution.assisted_pairs(reps, resolution.all_pairs(reps), same).cache()
    assert truth.count() > 300
    assert resolution.pair_recall(found, truth) >= 0.9
    # A tenth of all pairs at most, and what similar words alone gave.
    assert found.count() < 0.1 * len(rows) * (len(rows) - 1) / 2
    assert resolution.pair_recall(resolution.similar_keys(reps, 0.3), truth) < resolution.pair_recall(found, truth)
    both = resolution.assisted_pairs(reps, found, same)
    assert both.exceptAll(truth).isEmpty()


def test_hot_blocks_stay_linear(spark):
    reps = spark.range(3000).selectExpr("CAST(id AS string) AS key", "'the very same name' AS name")
    assert resolution.blocked_pairs(reps).count() <= 3000 * resolution.NEIGHBOURS


def test_model_assist_and_audit(spark, tmp_path):
    rows = [(1, "Acme Corp"), (2, "ACME corp."), (3, "Acme Korp"), (4, "Other Ltd"), (5, None), (6, "")]
    entities = spark.createDataFrame(rows, "entity_id int, name string")
    near = lambda x, y: F.levenshtein(x, y) <= 2
    for candidates in (resolution.all_pairs, resolution.blocked_pairs):
        got = resolution.resolve(entities.filter("entity_id < 5"), lx.DOMAIN, same=near, candidates=candidates)
        clusters = {r.entity_id: r.cluster for r in got.collect()}
        assert clusters[1] == clusters[2] == clusters[3] != clusters[4]
    metrics = resolution.pair_metrics(resolution.group_pair_counts(got.withColumn("gold", F.col("entity_id") < 4), "gold"))
    fs.append_audit(resolution.audit(got, metrics, F.to_timestamp(F.lit("2024-01-02 03:04:05"))), str(tmp_path / "log"))
    row = spark.read.json(str(tmp_path / "log")).first()
    assert (row.n_entities, row.n_clusters, row.n_merged, row.precision, row.recall, row.f1, row.timestamp_utc[:19]) == (4, 2, 2, 1.0, 1.0, 1.0, "2024-01-02T03:04:05")
