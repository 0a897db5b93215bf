"""The vector index and the trigram index against full scans."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import lexicon as lx
from loomgraph.operators import extraction, graph, retrieval, text_index, vector_index
from loomgraph.plans.registry import chunks, questions, table

SHAPE = "vec_id bigint, embedding array<float>"


def vectors(spark, n=600, dims=6):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((9, dims)) * 4
    rows = [(i, (centres[i % 9] + rng.standard_normal(dims)).astype(np.float32).tolist()) for i in range(n)]
    # Copies of one vector: a hot list, and ties.
    rows += [(n + i, rows[0][1]) for i in range(n // 2)]
    return rows, spark.createDataFrame([*rows, (None, rows[1][1]), (9_999, None), (9_998, [])], SHAPE).repartition(4)


def brute(rows, asked, k):
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in asked:
        far = np.sqrt(((x - np.array(v)) ** 2).sum(1))
        order = sorted((round(d, 9), j) for d, (j, _) in zip(far, rows, strict=True) if j != i)
        out[i] = [j for _, j in order[:k]]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("part", [50, 20_000])
def test_exact_search_equals_a_full_scan(spark, monkeypatch, part):
    monkeypatch.setattr(vector_index, "PART", part)
    monkeypatch.setattr(vector_index, "QUERIES", 16)
    rows, df = vectors(spark)
    asked = df.filter("vec_id % 20 = 0")
    expected = brute(rows, [r for r in rows if r[0] % 20 == 0], 5)
    index = vector_index.build(df)
    assert index.rows.count() == len(rows)
    assert by_query(vector_index.search(index, asked, 5, probes=2, exact=True)) == expected
    assert by_query(vector_index.full_scan(df, asked, 5)) == expected
    assert by_query(vector_index.search(vector_index.load(spark, index.path), asked, 5, probes=2, exact=True)) == expected
    if part == 50:
        assert index.lists.agg(F.max("parts")).first()[0] > 1


def test_recall_reaches_its_aim(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    asked = df.filter("vec_id % 100 = 0")
    index = vector_index.build(df)
    truth = vector_index.full_scan(df, asked, 5)
    probes = vector_index.probes_for(index, df, 5)
    found = vector_index.recall(vector_index.search(index, asked, 5, probes), truth).agg(F.sum("n_found"), F.sum("n_true")).first()
    assert probes < len(index.centroids) and found[0] >= 0.9 * found[1] and found[1] == 100


def test_index_without_rows(spark):
    none = spark.createDataFrame([], SHAPE)
    some = spark.createDataFrame([(1, [1.0, 2.0])], SHAPE)
    assert vector_index.search(vector_index.build(none), some, 3).count() == 0
    assert vector_index.search(vector_index.build(some), some, 3, exact=True).count() == 0
    assert vector_index.search(vector_index.build(some), none, 3).count() == 0


def test_plan_has_no_nested_loop(spark):
    _, df = vectors(spark)
    for out in (vector_index.full_scan(df, df, 3), vector_index.search(vector_index.build(df), df, 3)):
        assert "NestedLoop" not in out._jdf.queryExecution().toString()


def text_rows(spark, n=500):
    rng = random.Random(2)
    words = ["alpha", "Beta-2", "gam_ma", "the", "weather", "other", "İstanbul", "日本語", "x", "zeta99"]
    rows = [(f"c{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(n)] + [("rare", "an unusual quetzal here"), ("null", None)]
    return spark.createDataFrame(rows, "chunk_id string, content string").repartition(3)


ASKED = [("a", "The weather and ZETA99"), ("b", "quetzal"), ("c", "no hits whatsoever qqq"), ("d", ""), ("e", None), ("f", "her eta beta-2 gam_ma")]


def test_sparse_search_equals_the_scan(spark):
    docs, asked = text_rows(spark), spark.createDataFrame(ASKED, "query_id string, text string")
    index = text_index.build(docs, folders=7)
    key = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))
    expected = key(retrieval.sparse_hits(docs, asked, 8))
    assert len(expected) == 17
    assert key(text_index.search(index, asked, 8)) == expected


def test_batches_of_questions(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(text_index, "QUESTIONS", 2)
    rows, asked = chunks(spark, sf_dir), questions(spark)
    key = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))
    assert key(text_index.search(text_index.build(rows), asked, 5)) == key(retrieval.sparse_hits(rows, asked, 5))


def test_retrieval_in_batches_gives_the_same(spark, sf_dir, monkeypatch):
    rows, asked = chunks(spark, sf_dir), questions(spark)
    names = extraction.chunk_mentions(rows, lx.COMMON).select("chunk_id", F.col("canonical").alias("name"))
    searches = [lambda: retrieval.sparse_hits(rows, asked, 3), lambda: retrieval.dense_hits(rows, asked, 3), lambda: retrieval.graph_seed_hits(names, asked, 3)]
    key = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in df.collect())
    whole = [key(f()) for f in searches]
    monkeypatch.setattr(retrieval, "QUESTIONS", 2)
    assert [key(f()) for f in searches] == whole and all(whole)


def test_only_blocks_with_candidates_are_read(spark, tmp_path):
    docs = text_rows(spark, 3000)
    index = text_index.build(docs, str(tmp_path / "index"), folders=16)
    asked = spark.createDataFrame([("b", "quetzal")], "query_id string, text string")
    found = text_index.candidates(index, asked.selectExpr("text AS token"))
    assert found.count() == 1
    out = text_index.search(index, asked, 5)
    assert [r.chunk_id for r in out.collect()] == ["rare"]
    pruned = text_index.pruned(index.store, text_index.candidates(index, asked.selectExpr("text AS token")).select(text_index._folder(F.col("block"), 16).alias("folder")))
    assert pruned.select("folder").distinct().count() == 1 and 0 < pruned.count() < 3000
    filters = [x for x in out._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1:] if "folder" in x.split("]")[0]]
    assert filters and all(" = " in x.split("PushedFilters")[0] for x in filters)
    again = text_index.load(spark, str(tmp_path / "index"))
    assert [r.chunk_id for r in text_index.search(again, asked, 5).collect()] == ["rare"]
    # Postings grow with the blocks, not with the pairs of tokens and chunks.
    assert index.postings.groupBy("gram").count().agg(F.max("count")).first()[0] <= index.store.select("block").distinct().count()


def test_postings_take_a_row_per_run_of_blocks(spark):
    docs = spark.range(6400).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("the same words "), F.when(F.col("id") % 100 == 0, F.lit("and zq-"))).alias("content"))
    index = text_index.build(docs.coalesce(1), folders=1)
    assert index.store.select("block").distinct().count() >= 100
    assert index.postings.filter("gram = 'sam'").count() <= 8  # runs of 32 blocks, by task


@pytest.mark.parametrize("cut", [1, 70, 100, 5000])
def test_postings_of_odd_texts_in_pieces(spark, cut):
    """Batches and tasks may end within a block; texts may be null, short or of other scripts."""
    rng = random.Random(3)
    texts = ["", None, "ab", "abc", "a b cde", "日本語abc日def", "x_y-z 9", "é", "tabs\tand\nlines"]
    rows = [(i // 64, i % 64, rng.choice(texts)) for i in range(64 * 70)]
    want = {}
    for block, bit, text in rows:
        for g in {text[i : i + 3] for i in range(len(text) - 2)} if text else ():
            if all(c in text_index.CHARACTERS for c in g):
                want[g, block] = want.get((g, block), 0) | 1 << bit
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["block", "bit", "content"])
    none = whole.slice(0, 3).set_column(2, "content", pa.array([None] * 3, pa.string()))
    pieces = [whole.slice(i, cut) for i in range(0, len(rows), cut)]
    half = len(pieces) // 2
    out = [b for task in (pieces[:half], [*pieces[half:], none.slice(0, 0)], [none]) for b in text_index._postings(iter(task))]
    found = {}
    for b in out:
        for r in b.to_pylist():
            for block, bits in zip(r["blocks"], r["bits"], strict=True):
                found[r["gram"], block] = found.get((r["gram"], block), 0) | bits % (1 << 64)
    assert found == want
    index = text_index.TextIndex(spark.createDataFrame(pa.Table.from_batches([b for b in out if len(b)])).withColumn("folder", F.lit(0)), None, 1)
    met = text_index.candidates(index, spark.createDataFrame([("tabs",), ("cde",), ("nothing",)], "token string")).collect()
    assert {(r.token, r.block, r.bits % (1 << 64)) for r in met} == {(t, b, x) for t, g in (("tabs", "tab"), ("cde", "cde")) for (h, b), x in want.items() if h == g}


def brute_subgraph(nodes, edges, terms, hops, most_seeds, most_nodes):
    named = sorted(set(nodes))
    kept = dict.fromkeys([n for n in named if any(t.lower() in n[1].lower() for t in terms if len(t) >= 3)][:most_seeds], 0)
    last = set(kept)
    for hop in range(1, hops + 1):
        near = {b for e in edges for a, b in ((e[:2], e[3:]), (e[3:], e[:2])) if a in last and b in set(named)} - set(kept)
        last = set(sorted(near)[: most_nodes - len(kept)])
        kept |= dict.fromkeys(last, hop)
    kept = dict(sorted(kept.items(), key=lambda x: (x[1], x[0]))[:most_nodes])
    return kept, {e for e in edges if e[:2] in kept and e[3:] in kept}


@pytest.mark.parametrize(("hops", "most_seeds", "most_nodes"), [(1, 5, 12), (2, 5, 40), (3, 2, 25), (1, 30, 8)])
def test_subgraphs_of_many_questions(spark, hops, most_seeds, most_nodes):
    rng = random.Random(hops)
    nodes = [(rng.choice("AB"), f"{rng.choice(['north', 'south', 'EAST'])}-{i}") for i in range(60)]
    edges = list({(*rng.choice(nodes), "R", *rng.choice(nodes)) for _ in range(150)} | {("A", "missing", "R", *nodes[0])})
    questions = [("q1", ["north", "zz"]), ("q2", ["east-1", "th-2"]), ("q3", ["nothing"]), ("q4", []), ("q5", ["o", "ou"]), ("q6", ["SOUTH", "south"])]
    kept, inner = graph.subgraphs(spark.createDataFrame(nodes, "label string, name string"), spark.createDataFrame(edges, "src_label string, src_name string, rel string, dst_label string, dst_name string"), spark.createDataFrame(questions, "query_id string, terms array<string>"), hops, most_seeds, most_nodes)
    found, links = {}, {}
    for r in kept.collect():
        found.setdefault(r.query_id, {})[r.label, r["name"]] = r.hop
    for r in inner.collect():
        links.setdefault(r.query_id, set()).add(tuple(r)[1:])
    for q, terms in questions:
        nodes_of, edges_of = brute_subgraph(nodes, edges, terms, hops, most_seeds, most_nodes)
        assert found.get(q, {}) == nodes_of and links.get(q, set()) == edges_of


def test_subgraph_plan_does_not_grow_with_hops(spark):
    nodes, edges = spark.createDataFrame([("A", "abc")], "label string, name string"), spark.createDataFrame([("A", "abc", "R", "A", "abc")], "src_label string, src_name string, rel string, dst_label string, dst_name string")
    asked = spark.createDataFrame([("q", ["abc"])], "query_id string, terms array<string>")
    scans = [graph.subgraphs(nodes, edges, asked, hops)[1]._jdf.queryExecution().optimizedPlan().toString().count("Relation") for hops in (1, 4)]
    assert scans[0] == scans[1] <= 3


def test_subgraphs_write_no_more_than_their_limits(spark, monkeypatch):
    """A term that occurs in all names, and a hub: neither is multiplied by the questions that meet it."""
    names = [("A", f"north-{i:04}") for i in range(900)] + [("H", "hub")]
    edges = [("H", "hub", "R", *n) for n in names[:900:2]] + [("H", "hub", "R", "A", f"gone-{i}") for i in range(40)] + [(*names[4], "R", *names[6]), (*names[4], "S", *names[6])]
    asked = [(f"q{i}", ["north"] if i % 2 else ["hub", "nort"] if i % 3 else ["hub"]) for i in range(40)]
    made, keep = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, *a: made.append(keep(df, *a)) or made[-1])
    kept, inner = graph.subgraphs(spark.createDataFrame(names * 2, "label string, name string"), spark.createDataFrame(edges, "src_label string, src_name string, rel string, dst_label string, dst_name string"), spark.createDataFrame(asked, "query_id string, terms array<string>"), 1, 5, 12)
    assert sorted(t.count() for t in made)[-2:] <= [40, 2 * len(names)]  # the questions, and the texts of all nodes
    found, links = {}, {}
    for r in kept.collect():
        found.setdefault(r.query_id, {})[r.label, r["name"]] = r.hop
    for r in inner.collect():
        links.setdefault(r.query_id, set()).add(tuple(r)[1:])
    for q, terms in asked:
        assert (found[q], links.get(q, set())) == brute_subgraph(names, edges, terms, 1, 5, 12)


def test_automaton_equals_the_patterns(spark, sf_dir):
    """On all documents, and on texts made of the aliases with odd borders and runs."""
    rng = random.Random(9)
    joints = [" ", "-", "_", " - ", "\n", "", "x", "É", ".", "__", "\t", "9"]
    aliases = [a for e in lx.DOMAIN for a in e.aliases]
    made = ["".join(rng.choice([a, a.upper(), a.replace(" ", rng.choice(joints)), a.replace("-", " ")]) + rng.choice(joints) for a in rng.sample(aliases, 6)) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in [*made, None, "", "VaR", "ſemi deviation", "es"]], "text string").union(table(spark, sf_dir, "documents").select("text"))
    for lexicon in (lx.DOMAIN, lx.COMMON):
        patterns = F.array_compact(F.array(*[F.when(F.col("text").rlike(lx.alias_pattern(e.aliases)), F.struct(F.lit(e.label).alias("label"), F.lit(e.canonical).alias("canonical"))) for e in lexicon]))
        both = rows.select(F.array_sort(patterns).alias("a"), lx.mentions(F.col("text"), lexicon).alias("b")).cache()
        assert both.filter("a <> b OR a IS NULL OR b IS NULL").count() == 0
        assert both.filter("size(a) > 1").count() > 20


def test_extraction_takes_one_pass(spark, sf_dir):
    for out in extraction.extract(chunks(spark, sf_dir), lx.COMMON):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
