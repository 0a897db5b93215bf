"""Commands over the library: python -m loomgraph COMMAND ...; each is one Spark job over its inputs."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import lexicon as lx
from loomgraph.operators import chunking, evaluation, extraction, governance, graph, resolution, retrieval
from loomgraph.settings import CHOICES, Settings
from loomgraph.sources import files as fs


def ingest(spark: SparkSession, source: str, out: str, old: str | None = None) -> DataFrame:
    """Chunk a source tree's focus folders into `out`, over the chunks of `old`; files and chunks by type."""
    folders = fs.focus_directories(spark, source)
    names = {next((x for x in fs.FOCUS if f.endswith("/" + x)), f.rsplit("/", 1)[-1]): f for f in folders}
    chunks = chunking.chunk_files(fs.load_directories(spark, names))
    if old:
        chunks = retrieval.upsert_chunks(spark.read.parquet(old), chunks)
    chunks.write.mode("overwrite").parquet(out)
    return fs.summarize(spark.read.parquet(out))


def build_graph(spark: SparkSession, chunks: str, out: str, old: str | None = None, offset: int = 0, most: int | None = None) -> DataFrame:
    """Nodes and edges of the chunks into `out`, over the graph in `old`; stops where too many edges lack an end."""
    rows = spark.read.parquet(chunks)
    if offset or most:
        rows = fs.select_chunks(rows, offset, most)
    found = extraction.extract(rows, lx.DOMAIN)
    for name, merged, key in (("nodes", extraction.merge_nodes(found[0]), ["label", "name"]), ("edges", extraction.merge_edges(found[1]), graph.EDGE_KEY)):
        if old:
            merged = graph.upsert(spark.read.parquet(f"{old}/{name}"), merged, key)
        merged.write.mode("overwrite").parquet(f"{out}/{name}")
    graph.require_integrity(spark.read.parquet(f"{out}/edges"), spark.read.parquet(f"{out}/nodes"))
    return graph_stats(spark, out)


def graph_stats(spark: SparkSession, graph_path: str) -> DataFrame:
    return graph.stats(spark.read.parquet(f"{graph_path}/nodes"), spark.read.parquet(f"{graph_path}/edges"))


def evaluate(spark: SparkSession, chunks: str, out: str, samples: str | None = None, settings: Settings | None = None) -> DataFrame:
    """The report of the samples (the built-in ones by default), also written to `out`."""
    settings = settings or Settings.of(spark)
    rows = spark.read.parquet(chunks)
    asked = fs.load_samples(spark, samples).withColumnRenamed("expected_context_terms", "expected") if samples else evaluation.default_samples(spark)
    asked = asked.select(F.sha2(F.concat_ws("\0", "question", "reference_answer"), 256).alias("query_id"), "question", "reference_answer", "expected")
    mentions = extraction.chunk_mentions(rows, lx.DOMAIN).select("chunk_id", F.col("canonical").alias("name"))
    sources = rows.select(F.col("relative_path").alias("src"), "chunk_id")
    edges = lx.taxonomy(spark, lx.DOMAIN, lx.SIBLINGS)[1]
    store = settings.dense_store()
    retriever = lambda q: retrieval.retrieve(rows, mentions, sources, edges, q, lx.DOMAIN, settings.top_k, settings.embedding_dim, store)
    scored = evaluation.score_samples(evaluation.answer_samples(asked, retriever, [settings.retrieval_mode]))
    fs.save_report(evaluation.report(scored, metadata={"retrieval_mode": settings.retrieval_mode}), out)
    return spark.read.json(out)


def er_evaluate(spark: SparkSession, entities: str) -> DataFrame:
    """Precision, recall and f1 of the resolution of labelled entities (entity_id, name, gold)."""
    rows = spark.read.parquet(entities)
    resolved = resolution.resolve(rows.select("entity_id", "name"), lx.DOMAIN)
    return resolution.pair_metrics(resolution.group_pair_counts(resolved.join(rows.select("entity_id", "gold"), "entity_id"), "gold"))


def gate(spark: SparkSession, report: str) -> DataFrame:
    """Which reports pass the regression gate, with the metrics that fail."""
    return governance.gate(fs.read_reports(spark, report)).select("failures", "passed")


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loomgraph")
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name: str, *places: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name)
        for place in places:
            own.add_argument(place)
        return own

    add("ingest", "source", "out").add_argument("--old")
    build = add("build-graph", "chunks", "out")
    build.add_argument("--old")
    build.add_argument("--offset", type=int, default=0)
    build.add_argument("--most", type=int)
    add("graph-stats", "graph_path")
    run = add("eval", "chunks", "out")
    run.add_argument("--samples")
    run.add_argument("--mode", choices=CHOICES["retrieval_mode"])
    add("er-eval", "entities")
    add("eval-gate", "report")
    return parser


COMMANDS = {"ingest": ingest, "build-graph": build_graph, "graph-stats": graph_stats, "eval": evaluate, "er-eval": er_evaluate, "eval-gate": gate}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command and show its rows, which are summaries; 1 if the gate fails."""
    given = vars(_arguments().parse_args(argv))
    command = given.pop("command")
    spark = spark or SparkSession.builder.appName("loomgraph").getOrCreate()
    if command == "eval":
        given["settings"] = Settings.of(spark, retrieval_mode=given.pop("mode"))
    out = COMMANDS[command](spark, **given)
    out.show(100, truncate=False)
    return int(command == "eval-gate" and not out.filter("NOT passed").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
