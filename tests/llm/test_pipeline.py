"""The corpus pipeline and the registered training-data queries."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import byte_bpe, jaccard_join, queries
from loomgraph.llm.oracles import ORACLES

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Each stage's input and result, written and read back."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, docs, sf_dir))
        out.append((name, docs, after))
        docs = after
    return out


def test_all_but_the_last_stage_return_documents(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
        assert after.join(before, "doc_id", "left_anti").count() == 0


def test_quality_stage_keeps_good_documents(stages, spark, sf_dir):
    _, _, after = stages[0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(after.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
    rows = labels.groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()
    assert {r.quality: r.share > 0.5 for r in rows} == {0: False, 1: True}


def test_near_duplicate_stage_leaves_one_of_each_group(stages):
    _, before, after = stages[1]
    groups = jaccard_join.jaccard_components(before).select("component_id").distinct()
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(r.component_id for r in groups.collect())
    assert jaccard_join.jaccard_components(after).filter("doc_id <> component_id").count() == 0


def test_secret_stage_keeps_all_rows(stages):
    _, before, after = stages[2]
    assert after.count() == before.count()
    assert after.filter(F.col("text").rlike("password=[0-9a-f]{6}|AKIA[A-Z0-9]{16}")).count() == 0
    changed = after.join(before.select("doc_id", F.col("text").alias("was")), "doc_id").filter("text <> was")
    assert changed.count() == changed.filter(F.col("text").rlike("\\[(assign|access|hex|markov)\\]")).count()


def test_last_stage_round_trips(stages):
    _, before, after = stages[4]
    enc = byte_bpe.encoding(queries.tokenizer_path("byte_bpe_50k.tiktoken"), queries.split_pattern())
    want = {r.doc_id: (len(enc.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in before.collect()}
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in after.collect()} == want


def test_stages_take_awkward_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "no id " * 30, "en", None, 180), (4, "word " * 3000, "en", "s", 15000)]
    extra = spark.createDataFrame(rows, DOCUMENTS).withColumn("kept", F.lit("theirs")).withColumn("component_id", F.lit(0))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = extra
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == extra.columns
    assert corpus_pipeline.near_duplicate_stage(spark, extra, str(tmp_path)).filter("doc_id = 3").count() == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, extra.limit(0), str(tmp_path)).count() == 0


def test_near_duplicates_without_ids(spark, sf_dir):
    words = [f"w{i}" for i in range(200)]
    a, near, b, c = " ".join(words), " ".join([*words, "end"]), " ".join(words[::-1]), " ".join(f"v{i}" for i in range(50))
    texts = [(1, a), (None, a), (None, near), (None, b), (None, b), (None, b + " end"), (None, c), (None, ""), (None, None), (7, ""), (7, c + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCUMENTS)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()]
    assert [t for i, t in got if i == 1] == [a] and sum(i == 7 for i, _ in got) == 1
    none = [t for i, t in got if i is None]
    assert len(none) == 3 and sum(not t for t in none) == 2 and sum(t in (b, b + " end") for t in none if t) == 1


def test_registered_queries(spark, sf_dir):
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(ORACLES) <= set(queries.queries())
