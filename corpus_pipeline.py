"""A corpus pipeline: classify, join near duplicates, redact secrets, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all
but the last return the columns of documents. `run` writes each result as Parquet in the shared
folder and reads it back as the next stage's input.

Defined results: null and empty texts pass the stages as the operators define (the classifier
judges an empty text like any other; it has no near duplicates, no secrets and no tokens); of
rows that repeat an id one stays; rows without an id stay if their text is blank, else one of a
component in which no row has an id; an empty table gives an empty table; other columns pass through unchanged, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import byte_bpe, jaccard_join, mixing, quality_model, secrets
from loomgraph.llm.common import materialize
from loomgraph.llm.queries import split_pattern, table, tokenizer_path

#: Share of all tokens that the mixing stage samples.
SHARE = 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.classify(docs, model).filter("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join: the one with the smallest id."""
    groups = materialize(jaccard_join.labelled(docs))
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_first"))
    odd = materialize(groups.groupBy("doc_id").agg(F.count("*").alias("_times")).filter("doc_id IS NULL OR _times > 1").select(F.col("doc_id").alias("_odd")))
    kept = docs.join(first, docs["doc_id"] == first["_first"], "left_semi")
    if odd.isEmpty():
        return kept
    # Rows that their id does not tell apart are chosen by their sets.
    plain = kept.join(odd, kept["doc_id"] == odd["_odd"], "left_anti")
    rows = jaccard_join.with_key(docs.join(odd, docs["doc_id"].eqNullSafe(odd["_odd"]), "left_semi"))
    own = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_first"), F.col("d").alias("_key")).distinct()
    repeated = rows.join(own, (rows["doc_id"] == own["_first"]) & (rows["_d"] == own["_key"]), "left_semi")
    nameless = groups.filter("component_id IS NULL AND n_shingles > 0").groupBy("c").agg(F.min("d").alias("_key"))
    single = rows.filter("doc_id IS NULL AND _n > 0").join(nameless.select("_key"), F.col("_d") == F.col("_key"), "left_semi")
    blank = rows.filter("doc_id IS NULL AND _n = 0")
    chosen = repeated.dropDuplicates(["doc_id"]).union(single.dropDuplicates(["_d"])).union(blank)
    return plain.union(chosen.drop("_d", "_n"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by marks."""
    return secrets.redact(docs, secrets.train(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by calibrated probabilities."""
    return mixing.mix(docs, share=SHARE)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    return byte_bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE", encoding_stage),
]
#: SQL cannot train the classifier or apply the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
