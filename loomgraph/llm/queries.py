"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import alignment, bitplanes, byte_bpe, hard_negatives, html_extract, jaccard_join, jpeg, mixing, quality_model, quality_rules, secrets, sharding, token_counts
from loomgraph.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are, on this node and every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.classify(docs, model).select("doc_id", "source", "lang", "log_ratio", "host_rate", "path_rate", "p_quality", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.calibrated(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "source", "lang", "_topic AS topic", "_tokens AS n_tokens", "_rate AS rate", "_kept AS kept")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern())


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.secret_digest(secrets.scan(docs, secrets.train(docs)))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.stored_ids(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern(), tokenizer_path("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_rules, op2_quality_model, op3_token_counts, op4_mixing, op5_byte_bpe, op6_jaccard_join, op7_secrets, op8_token_ids, op9_html_extract, op10_media, op11_sharding, op12_alignment, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
