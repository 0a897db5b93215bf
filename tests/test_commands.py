"""The commands over a small source tree, and the settings."""

import json

import pytest

from loomgraph.__main__ import main
from loomgraph.operators import retrieval
from loomgraph.settings import Settings


def test_commands_from_source_tree_to_gate(spark, tmp_path, capsys):
    root = tmp_path / "tree"
    for name, text in {"src/m.py": "class A:\n    def f(self, x):\n        return x\n", "docs/source/a.rst": "Title\n=====\n\nHierarchical Risk Parity (HRP) is clustering.\n", "tests/test_m.py": "def test_a():\n    assert build(1)\n", "src/skip.bin": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    at = lambda name: str(tmp_path / name)
    assert main(["ingest", str(root), at("chunks")], spark) == 0
    chunks = spark.read.parquet(at("chunks"))
    assert {(r.relative_path, r.source_type) for r in chunks.select("relative_path", "source_type").collect()} == {("src/m.py", "python"), ("docs/source/a.rst", "docs"), ("tests/test_m.py", "test")}
    assert main(["ingest", str(root), at("again"), "--old", at("chunks")], spark) == 0
    assert sorted(r.chunk_id for r in spark.read.parquet(at("again")).collect()) == sorted(r.chunk_id for r in chunks.collect())
    assert main(["build-graph", at("chunks"), at("graph")], spark) == 0
    names = {(r.label, r.name) for r in spark.read.parquet(at("graph/nodes")).collect()}
    assert {("PythonClass", "A"), ("Parameter", "f:x"), ("PythonFunction", "build"), ("PortfolioMethod", "Hierarchical Risk Parity")} <= names
    assert main(["build-graph", at("chunks"), at("graph2"), "--old", at("graph"), "--most", "1"], spark) == 0
    assert {(r.label, r.name) for r in spark.read.parquet(at("graph2/nodes")).collect()} == names
    assert main(["graph-stats", at("graph")], spark) == 0
    assert main(["eval", at("chunks"), at("report"), "--mode", "sparse"], spark) == 0
    report = spark.read.json(at("report")).collect()
    assert len(report) == 1 and report[0].num_samples == 5 and report[0].retrieval_mode == "sparse"
    assert main(["eval-gate", at("report")], spark) == 1
    good = {"context_recall": 0.9, "answer_faithfulness": 0.9, "answer_relevance": 0.9, "grounding": 0.9, "multi_hop_accuracy": 0.9, "avg_latency_ms": 1.0, "estimated_cost_usd": 0.0}
    (tmp_path / "good.json").write_text(json.dumps(good))
    assert main(["eval-gate", at("good.json")], spark) == 0
    spark.createDataFrame([(1, "HRP", "a"), (2, "hierarchical risk parity", "a"), (3, "Other thing", "b")], "entity_id long, name string, gold string").write.parquet(at("entities"))
    capsys.readouterr()
    assert main(["er-eval", at("entities")], spark) == 0
    assert "f1" in capsys.readouterr().out


def test_settings(spark):
    assert Settings() == Settings(retrieval_mode=" HYBRID_RERANK ", vector_store="cells", embedding_provider="hash")
    for bad in ({"retrieval_mode": "best"}, {"vector_store": "x"}, {"embedding_dim": 4}):
        with pytest.raises(ValueError):
            Settings(**bad)
    spark.conf.set("spark.loomgraph.embedding_dim", "16")
    spark.conf.set("spark.loomgraph.adaptive_routing", "false")
    try:
        assert Settings.of(spark, retrieval_mode="dense", top_k=None) == Settings(retrieval_mode="dense", embedding_dim=16, adaptive_routing=False)
    finally:
        spark.conf.unset("spark.loomgraph.embedding_dim")
        spark.conf.unset("spark.loomgraph.adaptive_routing")
    assert Settings(vector_store="lexical").dense_store() is retrieval.sparse_hits
    with pytest.raises(ValueError):
        Settings(embedding_provider="given").dense_store()
    chunks = spark.createDataFrame([("a", "alpha beta"), ("b", "gamma delta")], "chunk_id string, content string")
    asked = spark.createDataFrame([("q", "alpha")], "query_id string, text string")
    assert [r.chunk_id for r in Settings().dense_store()(chunks, asked, 1).collect()] == ["a"]
