"""Measured evaluation runs, failing retrievers and the labels that readers see."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import evaluation, routing

HIT = "query_id string, rank int, content string, relative_path string, entities array<string>, neighbours array<string>"


def samples(spark):
    return spark.createDataFrame([("s1", "what is risk", "a risk", ["risk"]), ("s2", "how to hedge", "hedging", [])], "query_id string, question string, reference_answer string, expected array<string>")


def retriever(asked):
    if asked.first().mode == "sparse":
        raise ValueError("the store is down")
    item = F.struct(F.lit(1).alias("rank"), F.lit("risk is measured and hedge ratios follow").alias("content"), F.lit("m.py").alias("relative_path"), F.array(F.lit("risk")).alias("entities"), F.array(F.lit("risk"), F.lit("var")).alias("neighbours"))
    return asked.select("query_id", item.alias("x")).select("query_id", "x.*")


def test_runs_are_measured_and_survive_a_failing_retriever(spark):
    er = spark.createDataFrame([(0.5, 1.0, 0.6667)], "precision double, recall double, f1 double")
    report, scored, stages = evaluation.run(samples(spark), retriever, ["dense", "sparse"], er=er, metadata={"embedding_provider": "hash"})
    rows = {r["mode"]: r for r in report.collect()}
    assert set(rows) == {"dense", "sparse"} and all(r.num_samples == 2 and r.er_f1 == 0.6667 and r.metric_profile == "weighted" and r.embedding_provider == "hash" for r in rows.values())
    assert rows["dense"].avg_latency_ms > 0 and rows["dense"].context_recall > rows["sparse"].context_recall == 0
    by_stage = {s["stage"]: s for s in stages}
    assert by_stage["retrieve dense"]["n_rows"] == 2 and by_stage["score"]["n_rows"] == 4
    assert "the store is down" in by_stage["retrieve sparse"]["error"] and by_stage["retrieve sparse"]["n_rows"] == 0
    assert rows["dense"].avg_latency_ms == pytest.approx(by_stage["retrieve dense"]["ms"] / 2, rel=1e-3)
    got = {r.query_id: (len(r.contexts), r.answer) for r in scored.collect()}
    assert got["s1/sparse"] == (0, "No supporting contexts were retrieved.") and got["s1/dense"][0] == 1
    # A sample without expected terms takes those of its question and answer.
    assert all(len(r.expected) > 0 for r in scored.filter("query_id = 's2/dense'").collect())


def test_template_branches(spark):
    shape = "results array<struct<content:string,entities:array<string>,relative_path:string>>"
    cases = [
        ([], "No supporting contexts were retrieved."),
        ([("Short text", ["a", "b"], "p")], "Regarding q: Short text. Key entities: a, b."),
        ([("Short text", [], "p")], "Regarding q: Short text."),
        ([("", ["a"], "p")], "Regarding q: key entities include a. Source: p."),
        ([("  ", [], "p")], "Regarding q: see source p."),
    ]
    rows = spark.createDataFrame([(r,) for r, _ in cases], shape).coalesce(1)
    assert [r[0] for r in rows.select(evaluation.synthesize(F.lit("q"), F.col("results"))).collect()] == [a for _, a in cases]


def test_labels(spark):
    rows = [("sparse", 0.8, "rule_default; embedding=0.8"), ("dense", 0.6, "embedding=0.600"), ("dense", 0.3, "rule_dense_intent"), ("hybrid_rerank", 0.1, "low_confidence_fallback"), ("hybrid_rerank", 0.9, "static_config (adaptive routing disabled)")]
    df = spark.createDataFrame(rows, "mode string, confidence double, reason string").coalesce(1)
    got = df.select(routing.signal_label(F.col("confidence"), F.col("reason")), routing.reason_text(F.col("mode"), F.col("reason"))).collect()
    assert [r[0] for r in got] == ["High match", "Targeted match", "Heuristic match", "Broad fallback", "Configured default"]
    assert got[1][1] == "This question best matched the dense pattern." and got[0][1].startswith("No strong route")
    costs = spark.createDataFrame([(0.0,), (0.0005,), (0.0123,)], "c double").coalesce(1)
    assert [r[0] for r in costs.select(routing.cost_label(F.col("c"))).collect()] == ["Low", "<$0.001 / query", "$0.0123 / query"]


def test_costs_round_as_their_sql(spark):
    import duckdb

    texts = spark.range(0, 3000, 1, 4).select("id", F.repeat(F.lit("abc "), F.col("id").cast("int")).alias("text"))
    cost = evaluation.estimated_cost(F.lit(""), F.lit(""), F.array("text"))
    got = [r.cost for r in texts.select("id", cost.alias("cost")).orderBy("id").collect()]
    assert got == [r[0] for r in duckdb.sql("SELECT round(range * 0.0000005::DOUBLE, 6) FROM range(3000) ORDER BY range").fetchall()]


def test_cost_labels_round_the_stored_number(spark):
    given = [0.001, 0.00165, 0.00295, 0.0123, 0.03125, 0.99995, 1234.5]
    costs = spark.createDataFrame([(c,) for c in given], "c double").coalesce(1)
    assert [r[0] for r in costs.select(routing.cost_label(F.col("c"))).collect()] == [f"${c:.4f} / query" for c in given]


def test_hops_round_as_their_sql(spark, tmp_path):
    import duckdb

    from loomgraph.plans import rowwise

    words = ["alpha beta", "alpha", "beta gamma delta", "", "delta user", "gamma", "system alpha eps", "eps zeta eta beta"]
    roles = ["user", "assistant", "system", "user", None]
    turns = [(c, t, roles[(c + t * (1 + c // 5)) % 5], " ".join(words[(c * (t + 1) + t * t + j) % 8] for j in range(1 + c % 3))) for c in range(400) for t in range(2 + c % 7)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.accuracy for r in rowwise.multi_hop_scores(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = dict(con.sql(rowwise.ORACLES["multi_hop_scores"]).fetchall())
    assert {c: (got.get(c), want[c]) for c in want if got.get(c) != want[c]} == {}
    assert len(got) == len(want) == 400
