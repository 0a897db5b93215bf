"""Operators against hand-computed values and independent specifications."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import lexicon as lx
from loomgraph.operators import agent, chunking, evaluation, extraction, governance, graph, resolution, retrieval, routing, semantic
from loomgraph.sources import files as fs

MODULE = '''"""Module doc."""
import os

class A(Base):
    def f(self, x, y=1, *args):
        return os

async def g(a: int):
    pass
'''


def spec_windows(text, size, overlap):
    out, start, step = [], 0, max(1, size - max(0, overlap))
    while start < len(text):
        end = min(len(text), start + size)
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end >= len(text):
            break
        start += step
    return out


def test_windows_follow_the_specification(spark):
    rng = random.Random(1)
    texts = ["", " ", "x" * 10, "a b " * 30, *("".join(rng.choice("ab \n") for _ in range(rng.randrange(1, 200))) for _ in range(30))]
    df = spark.createDataFrame([(f"f{i}", t, "docs", ".py", "") for i, t in enumerate(texts)], "relative_path string, text string, source_type string, extension string, module_name string")
    for size, overlap in ((20, 5), (7, 0), (10, 10), (5, 9)):
        rows = chunking.window_chunks(df, size, overlap).select("relative_path", "chunk_index", "content").collect()
        got = {}
        for r in sorted(rows):
            got.setdefault(r.relative_path, []).append(r.content)
        assert got == {f"f{i}": w for i, t in enumerate(texts) if (w := spec_windows(t, size, overlap))}


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def tree(tmp_path):
    write(tmp_path, "pkg/mod.py", MODULE)
    write(tmp_path, "pkg/broken.py", "def (:\n")
    write(tmp_path, "tests/test_mod.py", "def helper():\n    pass\n\ndef test_b():\n    assert g(1)\n\ndef test_a():\n    run(2)\n")
    write(tmp_path, "docs/source/page.rst", "####\nRisk\n####\nIntro.\n\nPart Two\n--------\nBody.\n")
    write(tmp_path, "README.md", "Preamble.\n\n# One\ntext\n## Two\nmore\n")
    write(tmp_path, "examples/a.ipynb", '{"cells": [{"cell_type": "markdown", "source": ["# T\\n", "x"]}, {"cell_type": "code", "source": "y = 1"}, {"cell_type": "code", "source": []}]}')
    write(tmp_path, "skip.bin", "x")
    return tmp_path


def test_files_are_classified_and_chunked(spark, tree):
    files = fs.load_directory(spark, str(tree))
    kinds = {r.relative_path: r.source_type for r in files.collect()}
    assert kinds == {"pkg/mod.py": "python", "pkg/broken.py": "python", "tests/test_mod.py": "test", "docs/source/page.rst": "docs", "README.md": "python", "examples/a.ipynb": "example"}
    rows = chunking.chunk_files(files).orderBy("relative_path", "chunk_index").collect()
    by = lambda path: [(r.chunk_kind, r.section, r.line_start, r.line_end) for r in rows if r.relative_path == path]
    assert by("pkg/mod.py") == [("module_docstring", "module_docstring", 1, 1), ("class", "A", 4, 6), ("function", "g", 8, 9), ("function", "f", 5, 6), ("fallback", "fallback", 2, 3)]
    assert by("pkg/broken.py") == [("fallback", "fallback", 1, 2)]
    assert [k[1] for k in by("tests/test_mod.py")] == ["test_b", "test_a"]
    assert [k[1] for k in by("README.md")] == ["Preamble.", "One", "Two"]
    assert [k[1] for k in by("docs/source/page.rst")] == ["Risk", "Part Two"]
    assert [k[:1] + k[2:] for k in by("examples/a.ipynb")] == [("example_section", 1, 1), ("example_cell", 2, 2)]
    assert len({r.content_hash for r in rows}) == len(rows)
    assert rows == chunking.chunk_files(files).orderBy("relative_path", "chunk_index").collect()


def test_slices_and_module_names(spark, tree):
    chunks = chunking.chunk_files(fs.load_directory(spark, str(tree)))
    assert fs.select_chunks(chunks, 1, 2).count() == 2
    with pytest.raises(ValueError):
        fs.select_chunks(chunks, -1)
    with pytest.raises(ValueError):
        fs.select_chunks(chunks, 0, 0)
    named = spark.createDataFrame([("lib/src/a/b.py",), ("lib/src/a/__init__.py",)], "p string").select(fs.module_name(F.col("p"), "lib/src/")).collect()
    assert [r[0] for r in named] == ["a.b", "a"]


def chunk_row(content, kind="python", i=0):
    return (f"m.py::chunk:{i}", "m.py", kind, "m", "fallback", i, 1, 1, content)


CHUNKS = "chunk_id string, relative_path string, source_type string, module_name string, chunk_kind string, chunk_index int, line_start int, line_end int, content string"


def test_symbols_parameters_and_targets(spark):
    nodes, edges = extraction.extract(spark.createDataFrame([chunk_row(MODULE), chunk_row("CVaR and HRP; print(x) test_q() call_me(1)", "test", 1)], CHUNKS), lx.DOMAIN)
    names = {(r.label, r.name) for r in nodes.collect()}
    assert {("PythonClass", "A"), ("PythonFunction", "f"), ("PythonFunction", "g"), ("Parameter", "f:x"), ("Parameter", "f:y"), ("Parameter", "f:args"), ("PythonFunction", "call_me"), ("RiskMeasure", "CVaR"), ("Concept", "cvar")} <= names
    assert not {n for k, n in names if k == "Parameter" and n.startswith("g:")}
    found = {(r.rel, r.src_name, r.dst_name) for r in edges.collect()}
    assert ("RELATED_TO", "Hierarchical Risk Parity", "CVaR") in found
    assert ("SUPPORTS_RISK_MEASURE", "m.py", "CVaR") in found and ("VALIDATES", "m.py", "call_me") in found


def test_last_property_wins(spark):
    rows = spark.createDataFrame([("A", "x", {"k": "1", "j": "0"}, 1), ("A", "x", {"k": "2"}, 2), ("A", "y", {}, 3)], "label string, name string, props map<string,string>, ord int")
    assert {(r.name, tuple(sorted(r.props.items()))) for r in extraction.merge_nodes(rows).collect()} == {("x", (("j", "0"), ("k", "2"))), ("y", ())}


def test_model_payloads_are_filtered(spark):
    chunks = spark.createDataFrame([chunk_row("a"), chunk_row("boom", i=1)], CHUNKS)

    def extractor(content, kind):
        if content == "boom":
            raise RuntimeError
        return {"nodes": [{"label": "Solver", "name": "X", "properties": {"v": 1}}, {"label": "Nope", "name": "Y"}, "bad"], "edges": [{"source_name": "X", "target_name": "Z", "relation_type": "USES", "source_label": "Solver"}, {"source_name": "X", "target_name": "Z", "relation_type": "NOPE"}]}

    nodes, edges = extraction.model_graph(chunks, extraction.model_payloads(chunks, extractor))
    assert [(r.label, r.name) for r in nodes.collect()] == [("Solver", "X")]
    assert {(r.rel, r.src_name, r.dst_label) for r in edges.collect()} == {("MENTIONS", "m.py::chunk:0", "Solver"), ("USES", "X", "Concept")}


def test_upsert_and_integrity(spark):
    schema = "label string, name string, props map<string,string>"
    old = spark.createDataFrame([("A", "x", {"a": "1", "b": "1"})], schema)
    new = spark.createDataFrame([("A", "x", {"b": "2"}), ("A", "y", {})], schema)
    assert {(r.name, tuple(sorted(r.props.items()))) for r in graph.upsert(old, new, ["label", "name"]).collect()} == {("x", (("a", "1"), ("b", "2"))), ("y", ())}
    edges = spark.createDataFrame([("A", "x", "R", "A", "y")] * 18 + [("A", "x", "R", "B", "y")] * 2, "src_label string, src_name string, rel string, dst_label string, dst_name string")
    row = graph.edge_integrity(edges, new).first()
    assert (row.n_edges, row.n_skipped, row["limit"], row.ok) == (20, 2, 1, False)
    with pytest.raises(RuntimeError):
        graph.require_integrity(edges, new)


def test_merge_weights(spark):
    hit = "query_id string, chunk_id string, score double"
    dense = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.4)], hit)
    sparse = spark.createDataFrame([("q", "b", 2.0), ("q", "c", 4.0)], hit)
    got = {r.chunk_id: round(r.score, 6) for r in retrieval.merge_hits(dense, sparse, 5).collect()}
    assert got == {"a": 0.5, "b": 0.96, "c": 1.4}


def test_dense_ranks_the_right_chunk_first(spark):
    chunks = spark.createDataFrame([("c0", "Hierarchical Risk Parity HRP allocation method"), ("c1", "Conditional Value at Risk explanation")], "chunk_id string, content string")
    asked = spark.createDataFrame([("q", "HRP allocation")], "query_id string, text string")
    top = retrieval.dense_hits(chunks, asked, 1).first()
    assert top.chunk_id == "c0" and 0 < top.score <= 1


@pytest.mark.parametrize("text, mode", [("relationship of solver and method", "graph"), ("which file and line", "graph"), ("file path and line", "sparse"), ("use rp.thing now", "sparse"), ("compare docs versus code", "hybrid_rerank"), ("", "hybrid_rerank")])
def test_routes(spark, text, mode):
    assert routing.route(spark.createDataFrame([("q", text)], "query_id string, text string")).first().mode == mode


def test_low_confidence_falls_back(spark):
    row = routing.route(spark.createDataFrame([("q", "x")], "query_id string, text string"), least=0.99).first()
    assert (row.mode, row.reason) == ("hybrid_rerank", "low_confidence_fallback")


def test_plan_and_check(spark):
    df = spark.createDataFrame([("How does HRP work?",), ("Why",), ("  ",)], "q string")
    got = [r[0] for r in df.select(agent.sub_questions(F.col("q"))).collect()]
    assert got == [["How does HRP work?", "Corpus details on hrp work", "methodology evidence for: How does HRP work?"], ["Why", "methodology evidence for: Why"], []]


def test_metric_values(spark):
    row = spark.range(1).select(
        evaluation.context_recall(F.array(F.lit("alpha"), F.lit("beta")), F.array(F.lit("Alpha here"), F.lit("none"))).alias("recall"),
        evaluation.context_precision(F.array(F.lit("alpha")), F.array(F.lit("Alpha here"), F.lit("none"))).alias("precision"),
        evaluation.weighted_precision(F.lit("alpha gamma"), F.array(F.lit("alpha")), F.array(F.lit("alpha beta"))).alias("weighted"),
        evaluation.claim_faithfulness(F.lit("alpha beta gamma. delta eps zeta"), F.array(F.lit("alpha beta"))).alias("claims"),
        evaluation.weighted_relevance(F.lit("alpha beta"), F.lit("alpha gamma")).alias("relevance"),
        evaluation.grounding(F.lit("alpha beta gamma"), F.array(F.lit("alpha"), F.lit("x"), F.lit("y"), F.lit("beta"))).alias("grounding"),
        evaluation.estimated_cost(F.lit("alpha"), F.lit("beta"), F.array(F.lit("gamma delta"))).alias("cost"),
        *[c.alias(n) for n, c in evaluation.link_metrics(F.array(F.lit("zzz")), F.array(F.lit("a"), F.lit("zzz"))).items()],
    ).first()
    assert (row.recall, row.precision, row.claims) == (0.5, 0.5, 0.5)
    assert row.weighted == pytest.approx(0.65 + 0.35 / 3, abs=1e-4)
    assert row.relevance == pytest.approx(0.2 / 3 + 0.4, abs=1e-4)
    assert row.grounding == pytest.approx(0.75 / 3 + 0.25 * 0.5, abs=1e-4)
    assert row.cost == pytest.approx(2e-6) and (row.link_mrr, row.link_hits_3) == (0.5, 1.0)


def test_coherent_evidence_scores_higher(spark):
    schema = "content string, entities array<string>, neighbours array<string>"
    coherent = [("alpha method", ["alpha"], ["alpha", "beta chunk"]), ("alpha beta", ["alpha"], ["alpha", "gamma chunk"])]
    df = spark.createDataFrame([(coherent,), ([("alpha method", [], [])],), ([],)], f"results array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
    a, b, c = (r[0] for r in df.select(evaluation.multi_hop(F.lit("alpha beta"), F.col("results"))).collect())
    assert a > b > c == 0.0


def test_contrast(spark):
    base = spark.createDataFrame([(0.5, 10.0, 0.1)], "context_recall double, avg_latency_ms double, grounding double")
    cand = spark.createDataFrame([(0.6, 12.0, 0.10001)], base.schema)
    out = evaluation.contrast(base, cand)
    assert {r.metric: r.verdict for r in out.collect()} == {"context_recall": "improved", "avg_latency_ms": "regressed", "grounding": "unchanged"}
    assert evaluation.winner(out).first().winner == "tie"


def greedy_spec(keys, similar):
    out, gone = {}, set()
    for i, a in enumerate(keys):
        if a in gone:
            continue
        out[a] = a
        for b in keys[i + 1 :]:
            if b not in gone and (a, b) in similar:
                out[b] = a
                gone.add(b)
    return out


def test_greedy_merge_follows_the_specification(spark):
    for seed in range(4):
        rng = random.Random(seed)
        keys = [f"k{i:02d}" for i in range(14)]
        similar = {(a, b) for a in keys for b in keys if a < b and rng.random() < 0.2}
        reps = spark.createDataFrame([(k,) for k in keys], "key string")
        pairs = spark.createDataFrame([*similar] or [("", "")], "a string, b string")
        got = {r.key: r.leader for r in resolution.greedy_leaders(reps, pairs).collect()}
        assert got == greedy_spec(keys, similar)


def test_entities_share_aliases(spark):
    rows = spark.createDataFrame([("e1", "CVaR"), ("e2", "conditional value at risk"), ("e3", "Expected Shortfall"), ("e4", "Other thing")], "entity_id string, name string")
    out = resolution.canonical(resolution.resolve(rows, lx.DOMAIN)).orderBy("canonical_name").collect()
    assert [(r.canonical_name, r.entity_ids) for r in out] == [("CVaR", ["e1", "e2", "e3"]), ("Other thing", ["e4"])]


def test_gate_and_drift(spark):
    good = {"answer_faithfulness": 0.9, "answer_relevance": 0.9, "context_recall": 0.9, "grounding": 0.9, "multi_hop_accuracy": 0.9, "avg_latency_ms": 1.0, "estimated_cost_usd": 0.0}
    df = spark.createDataFrame([tuple(good.values())], ", ".join(f"{k} double" for k in good))
    assert governance.gate(df).first().passed
    with pytest.raises(RuntimeError, match="grounding"):
        governance.require_gate(df.withColumn("grounding", F.lit(0.1)))


@pytest.mark.parametrize("q, status, label", [("", "blocked", None), ("please DELETE all", "blocked", None), ("count riskmeasure", "safe", "RiskMeasure"), ("count unknowns", "escalate", None), ("what mentions CVaR", "safe", None), ("tell me", "escalate", None)])
def test_guard(spark, q, status, label):
    row = spark.createDataFrame([(q,)], "q string").select(governance.guard(F.col("q")).alias("d")).first().d
    assert (row.status, row.label) == (status, label)


def test_triples_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("Solver", 'A "x" \\ y'), ("Solver", "")], "label string, name string")
    edges = spark.createDataFrame([("Solver", "a", "USES", "Solver", "b")], "src_label string, src_name string, rel string, dst_label string, dst_name string")
    rows = semantic.instances(nodes, edges).unionByName(semantic.ontology(spark, lx.DOMAIN))
    safe = rows.withColumn("s", F.regexp_replace("s", '[<>"\\\\]', "_"))
    fs.write_triples(safe, str(tmp_path / "t"))
    assert {tuple(r) for r in fs.read_triples(spark, str(tmp_path / "t")).collect()} == {tuple(r) for r in safe.collect()}


def test_samples_are_checked(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"samples": [{"question": " q ", "reference_answer": "r", "tags": [" a ", ""]}]}')
    (tmp_path / "bad.json").write_text('[{"question": "", "reference_answer": "r"}]')
    row = fs.load_samples(spark, str(tmp_path / "ok.json")).first()
    assert (row.question, row.tags, row.expected_context_terms) == ("q", ["a"], [])
    with pytest.raises(Exception, match="needs a question"):
        fs.load_samples(spark, str(tmp_path / "bad.json")).collect()


def test_streaming_upsert(spark, tmp_path):
    from loomgraph.streaming.upsert import latest, upsert_batch

    source, out = tmp_path / "in", tmp_path / "out"
    for i, text in enumerate(["CVaR here", "VaR there"]):
        spark.createDataFrame([chunk_row(text, i=i)], CHUNKS).coalesce(1).write.mode("append").parquet(str(source))
        query = spark.readStream.schema(CHUNKS).parquet(str(source)).writeStream.foreachBatch(upsert_batch(str(out), lx.DOMAIN)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    nodes = spark.read.parquet(latest(spark, f"{out}/nodes", 99))
    assert {r.name for r in nodes.collect()} >= {"CVaR", "VaR", "m.py::chunk:0", "m.py::chunk:1"}


def test_agent_plan_takes_every_turn(spark, tmp_path):
    from loomgraph.plans import registry

    turns = [(1, 0, "user", "river"), (1, 1, "user", "how is stone"), (2, 0, "user", None), (2, 3, "user", "cloud")]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.part: r.n for r in registry.agent_plan(spark, str(tmp_path)).collect()}
    assert got == {0: 3, 1: 3, 2: 1}


def test_files_round_trip(spark, tmp_path):
    """Samples in all three forms, triples with every escape, and files that are no UTF-8."""
    from loomgraph.sources import files

    rows = spark.createDataFrame([(f"question {i}?", "an answer", ["one", " two "]) for i in range(10)], "question string, reference_answer string, expected_context_terms array<string>")
    files.save_samples(rows.repartition(2), str(tmp_path / "saved"))
    assert sorted(r.question for r in files.load_samples(spark, str(tmp_path / "saved")).collect()) == sorted(r.question for r in rows.collect())
    for name, text in (("array.json", '[{"question": "q1", "reference_answer": "a"}, {"question": "q2", "reference_answer": "a"}]'), ("object.json", '{"samples": [{"question": "q1", "reference_answer": "a"}, {"question": "q2", "reference_answer": "a"}]}')):
        (tmp_path / name).write_text(text)
        assert sorted(r.question for r in files.load_samples(spark, str(tmp_path / name)).collect()) == ["q1", "q2"]
    odd = ["plain", 'say "hi"', "back\\nslash", "line\nbreak", "car\rriage", "tab\there", "\\", ""]
    triples = spark.createDataFrame([(f"urn:s{i}", "urn:p", o, "literal") for i, o in enumerate(odd)] + [("urn:s", "urn:p", "urn:o", "iri")], "s string, p string, o string, o_kind string")
    files.write_triples(triples, str(tmp_path / "triples"))
    assert sorted(map(tuple, files.read_triples(spark, str(tmp_path / "triples")).collect())) == sorted(map(tuple, triples.collect()))
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "bad.txt").write_bytes(b"good \xff bytes")
    assert [r.text for r in files.load_directory(spark, str(tmp_path / "tree")).collect()] == ["good \ufffd bytes"]


def test_upsert_keeps_one_row_of_an_id(spark):
    from loomgraph.operators import retrieval

    old = spark.createDataFrame([("a", "old"), ("b", "old")], "chunk_id string, content string")
    new = spark.createDataFrame([("a", "first"), ("a", "second"), ("c", "new")], "chunk_id string, content string")
    assert sorted(map(tuple, retrieval.upsert_chunks(old, new).collect())) == [("a", "second"), ("b", "old"), ("c", "new")]


def test_failed_answers_get_a_second_call(spark):
    from pyspark.sql.functions import pandas_udf

    calls = spark.sparkContext.accumulator(0)

    @pandas_udf("string")
    def generator(text, context):
        calls.add(int(text.notna().sum()))
        return text.map(lambda t: "alpha beta" if t == "good question" else "zzz yyy")

    hit = ("c1", 1, 0.5, ["alpha"], ["alpha"], "alpha beta", "m.py", "s", 0, 1, 2)
    schema = "chunk_id string, rank int, score double, entities array<string>, neighbours array<string>, content string, relative_path string, section string, chunk_index int, line_start int, line_end int"
    hits = spark.createDataFrame([hit], schema)
    asked = spark.createDataFrame([("a", "good question"), ("b", "bad question")], "query_id string, text string")
    out = agent.answer(asked, lambda q: q.select("query_id").crossJoin(F.broadcast(hits)), generator.asNondeterministic())
    rows = {r.query_id: r for r in out.collect()}
    assert (rows["a"].attempts, rows["a"].verified, rows["b"].attempts, rows["b"].verified) == (1, True, 2, False)
    assert calls.value >= 3
    assert [(c.chunk_id, c.relative_path, c.line_start, c.line_end, c.matched_entities) for c in rows["a"].citations] == [("c1", "m.py", 1, 2, ["alpha"])]
    assert {r.query_id: r.support for r in agent.insights(out).collect()} == {"a": "Strong source support", "b": "Partial source support"}


def test_reports_and_comparisons_are_saved(spark, tmp_path):
    scored = spark.createDataFrame([("a", 0.5, 10.0), ("b", 1.0, 20.0)], "question string, context_recall double, latency_ms double")
    er = spark.createDataFrame([(0.5, 1.0, 0.6667)], "precision double, recall double, f1 double")
    report = evaluation.report(scored, er=er, metadata={"retrieval_mode": "sparse"})
    row = report.first()
    assert (row.num_samples, row.context_recall, row.avg_latency_ms, row.er_f1, row.retrieval_mode) == (2, 0.75, 15.0, 0.6667, "sparse")
    fs.save_report(report, str(tmp_path / "report"))
    assert fs.read_reports(spark, str(tmp_path / "report")).first().avg_latency_ms == 15.0
    better = evaluation.report(scored.withColumn("context_recall", F.lit(1.0)))
    deltas = evaluation.sample_deltas(scored, scored.withColumn("context_recall", F.lit(1.0)), ["context_recall"])
    fs.save_comparison(evaluation.contrast(report, better), deltas, str(tmp_path / "both"), "old", "new")
    assert {(r.metric, r.verdict, r.candidate_label) for r in spark.read.json(str(tmp_path / "both/metrics")).collect()} == {("context_recall", "improved", "new"), ("avg_latency_ms", "unchanged", "new")}
    assert sorted(r.delta_context_recall for r in spark.read.json(str(tmp_path / "both/samples")).collect()) == [0.0, 0.5]


def test_history_is_appended_and_cut(spark, tmp_path):
    path = str(tmp_path / "history")
    for day in range(33):
        spark.createDataFrame([("s", day, 0.9 if day < 32 else 0.5)], "series string, day int, grounding double").coalesce(1).write.mode("append").parquet(path) if day < 32 else governance.append_history(spark.createDataFrame([("s", day, 0.5)], "series string, day int, grounding double"), path)
    rows = governance.history(spark, path, "series", "day", ["grounding"]).orderBy("day").collect()
    assert [r.day for r in rows] == list(range(3, 33))
    assert [r.drift_flagged for r in rows] == [False] * 29 + [True]


def test_only_reading_statements_pass(spark):
    df = spark.createDataFrame([("MATCH (n) RETURN n",), ("match (n) delete n",), ("CREATE (n)",), (None,)], "s string")
    assert [r[0] for r in df.select(governance.read_only(F.col("s"))).collect()] == [True, False, False, False]


def test_an_embedder_takes_the_hash_embeddings_place(spark):
    def by_length(rows, key, text, dim):
        return rows.select(key, F.lit(0).alias("idx"), F.length(text).alias("value"), F.length(text).cast("double").alias("norm"))

    chunks = spark.createDataFrame([("c0", "abc"), ("c1", "xyz")], "chunk_id string, content string")
    asked = spark.createDataFrame([("q", "other words")], "query_id string, text string")
    assert [(r.chunk_id, r.score) for r in retrieval.dense_hits(chunks, asked, 2, embedder=by_length).orderBy("rank").collect()] == [("c0", 1.0), ("c1", 1.0)]
