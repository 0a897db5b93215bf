"""Hard negatives against brute force, with odd rows, ties and thresholds that stop early."""

import math
import random

import numpy as np
import pytest

from loomgraph.llm import hard_negatives as hn

SHAPE = "vec_id bigint, embedding array<float>, label int, id string, v int"


def brute(rows, every=100):
    """Contract rows of (vec_id, vector, label) triples."""
    part = []
    for i, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in vector]
        part.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, v))
    order = lambda s, i, n: (-s, i is None, i or 0, n)
    out = []
    for n, (a, label, v) in enumerate(part):
        if a is None or a % every:
            continue
        scored = sorted((order(sum(x * y for x, y in zip(v, w)), i, m), i, own) for m, (i, own, w) in enumerate(part) if m != n)
        for (s, *_), p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(-t[0], i) for t, i, own in scored if own != label and 30 * -s <= 100 * -t[0] <= 90 * -s]
            out += [(a, p, r, i, -s, t) for r, (t, i) in enumerate(fit[:10], 1)]
    return out


def mined(spark, rows, **kinds):
    docs = spark.createDataFrame([(i, v, x, "clash", 1) for i, v, x in rows], SHAPE).repartition(3)
    out = hn.mined(docs, **kinds)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return [tuple(r) for r in out.collect()]


def same(found, expected):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(found, key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("block", [7, 64, 8192])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hn, "BLOCK", (block, block))
    monkeypatch.setattr(hn, "ANCHORS", 3)
    rng = random.Random(block)
    # A narrow grid gives ties; copies, short vectors and unusable rows besides.
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)], rng.randrange(3)) for i in range(400)]
    rows += [(i + 1000, rows[0][1], rng.randrange(3)) for i in range(40)]
    rows += [(1, None, 1), (2, [float("nan")] * 6, 1), (3, [float("inf")] * 6, 2), (4, [None, 1.0], 0), (5, [0.5] * 6, None), (600, [], 1), (700, [1.0, 0.5], 2), (None, [1.0] * 6, 1), (None, [0.5] * 6, 2)]
    same(mined(spark, rows), brute(rows))


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 3)]) == []
    rows = [(100, [1.0], 3), (100, [1.0], 3), (2, [0.5], 4), (3, [0.9], 4), (4, [-1.0], 4)]
    found = mined(spark, rows)
    same(found, brute(rows))
    assert [r[3] for r in found] == [3, 2, 3, 2] or len(found) == 4


def test_large_components_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1e9, 3e12, -2e12, 7.5]) * rng.random() for _ in range(3)], i % 2) for i in range(120)]
    # These scores, of up to 2^104, are cut to 64 bits.
    cut = mined(spark, rows)
    assert max(abs(x) for r in cut for x in r[4:]) <= (1 << 63) - 1
    small = [(i, [x / 1e7 for x in v], label) for i, v, label in rows]
    same(mined(spark, small), brute(small))


def skewed(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    return np.rint(256 * rng.standard_normal((n, dims)) * 0.5 ** np.arange(dims)).astype(np.int64)


def test_threshold_stops_early_and_keeps_ties():
    x = skewed(20_000, 8)
    lists = hn.SortedLists(x, int(np.abs(x).max()) * 8)
    fits = np.arange(20_000) % 3 > 0
    for anchor in x[:40]:
        before = lists.read
        scores = x @ anchor
        top = int(scores.max())
        windows = [(top * 3 // 10, top * 9 // 10), (top // 2, top * 2)]
        rows, found = lists.search(anchor, fits, windows, 10)
        assert (found == scores[rows]).all() and len(set(rows.tolist())) == len(rows)
        good = fits[rows]
        for window in windows:
            got = rows[good][hn.first(rows[good], found[good], np.arange(20_000), window, 10)]
            inside = np.flatnonzero(fits & (scores >= window[0]) & (scores <= window[1]))
            assert got.tolist() == sorted(inside.tolist(), key=lambda i: (-scores[i], i))[:10]
        assert lists.read - before < 20_000
    assert lists.read < 0.5 * 40 * 20_000


def test_threshold_bounds_what_is_not_met():
    x = skewed(500, 5)
    lists = hn.SortedLists(x)
    for anchor in x[:20]:
        for depth in (0, 10, 200):
            met = {int(r) for j in np.flatnonzero(anchor) for r in (lists.order[j][::-1] if anchor[j] > 0 else lists.order[j])[:depth]}
            rest = [i for i in range(500) if i not in met]
            assert max((x[rest] @ anchor).tolist(), default=-(1 << 60)) <= lists.threshold(anchor, depth)
