"""The engine's registered queries, each over its whole tables.

The corpus is the documents table: a file per document, its kind by id so that every branch is
reached. The property graph is the star schema, with defects by rule for the validators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import lexicon as lx
from loomgraph.functions.text import embedding_cells, question_tokens, tokens
from loomgraph.operators import agent, chunking, evaluation, extraction, governance, graph, resolution, retrieval, routing, semantic
from loomgraph.operators.tables import written
from loomgraph.plans.oracles import ORACLES
from loomgraph.sources import files as fs

Query = Callable[[SparkSession, str], DataFrame]
KINDS = ["python", "docs", "example", "test"]
K = 5

# The questions of the retrieval queries: id, mode, text.
QUESTIONS = [
    ("q1", "sparse", "the and that with"),
    ("q2", "graph", "relationship between the and for"),
    ("q3", "hybrid_rerank", "compare that and this"),
    ("q4", "sparse", ""),
    ("q5", "dense", "explain the meaning of that which was with from this and for are their than then"),
    ("q6", "sparse", "With with THE the Demonstrative FOR"),
]
EVALUATED = [
    ("the and that with", "The and that are with this.", ["the", "that with", "and"]),
    ("how was this from that", "This was from that for the and.", ["this", "from", "zebra"]),
    ("", "", []),
]
# Relations among the common dictionary's entries, for hops.
COMMON_SIBLINGS = [("Determiner", "The", "Demonstrative"), ("Preposition", "For", "With")]
DAY_METRICS = ["answer_faithfulness", "grounding", "avg_latency_ms", "estimated_cost_usd"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relative_path, text, source_type, module_name and extension of every document."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("documents/"), F.col("doc_id").cast("string"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select(path.alias("relative_path"), F.coalesce("text", F.lit("")).alias("text"), kind.alias("source_type"), fs.module_name(path).alias("module_name"), F.lit(".txt").alias("extension"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.window_chunks(corpus(spark, sf_dir))


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id string, mode string, text string")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.chunk_mentions(chunks(spark, sf_dir), lx.COMMON).select("chunk_id", F.col("canonical").alias("name"))


def has_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select(F.col("relative_path").alias("src"), "chunk_id")


def prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks and their mentions, written once for plans that use them many times; and the chunks' sources."""
    rows = written(chunks(spark, sf_dir))
    names = written(extraction.chunk_mentions(rows, lx.COMMON).select("chunk_id", F.col("canonical").alias("name")))
    return rows, names, rows.select(F.col("relative_path").alias("src"), "chunk_id")


def common_edges(spark: SparkSession) -> DataFrame:
    return lx.taxonomy(spark, lx.COMMON, COMMON_SIBLINGS)[1]


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    node = lambda df, label, name: df.select(F.lit(label).alias("label"), name.cast("string").alias("name"))
    parts = [
        node(t("customer"), "Customer", F.when(F.col("c_custkey") % 101 == 0, "").otherwise(F.col("c_name"))),
        node(t("orders"), "Order", F.col("o_orderkey")),
        node(t("part"), "Part", F.concat(F.lit("part-"), F.col("p_partkey"))),
        node(t("supplier"), "Supplier", F.col("s_name")),
        node(t("nation"), "Nation", F.col("n_name")),
        node(t("region"), "Region", F.col("r_name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, x, rel, b, y: df.select(F.lit(a).alias("src_label"), x.cast("string").alias("src_name"), F.lit(rel).alias("rel"), F.lit(b).alias("dst_label"), y.cast("string").alias("dst_name"))
    items, nation = t("lineitem"), t("nation")
    part = F.concat(F.when(F.col("l_partkey") % 97 == 0, "missing-").otherwise("part-"), F.col("l_partkey"))
    whole = F.concat(F.lit("part-"), F.col("l_partkey"))
    supplied = items.select("l_partkey", "l_suppkey").distinct().join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    placed = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = edge(placed, "Customer", F.col("c_name"), "PRECEDES", "Order", F.col("o_orderkey"))
    out = out.union(edge(items.select("l_orderkey", "l_partkey").distinct(), "Order", F.col("l_orderkey"), "REQUIRES", "Part", part))
    out = out.union(edge(supplied, "Part", whole, "SUPPLIED_BY", "Supplier", F.col("s_name")))
    out = out.union(edge(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "Customer", F.col("c_name"), "RELATED_TO", "Nation", F.col("n_name")))
    out = out.union(edge(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "Supplier", F.col("s_name"), "RELATED_TO", "Nation", F.col("n_name")))
    return out.union(edge(nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), "Nation", F.col("n_name"), "IS_SUBTYPE_OF", "Region", F.col("r_name")))


def corpus_summary(spark, sf_dir):
    return fs.summarize(chunks(spark, sf_dir))


def chunk_window(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "chunk_index", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


def chunk_lines(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "line_start", "line_end", "section")


def section_chunks(spark, sf_dir):
    """Conversations as .md files: a heading per turn, so that each turn is a section."""
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conversations/"), F.col("conv_id"), F.lit("/"), F.col("turn")).alias("relative_path"), F.concat(F.lit("# "), F.coalesce("role", F.lit("none")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    turns = turns.withColumns({"extension": F.lit(".md"), "source_type": F.lit("docs")})
    return chunking.chunk_files(turns).groupBy("section").agg(F.count("*").alias("n_chunks"), F.countDistinct("relative_path").alias("n_turns"), F.sum(F.length("content")).alias("n_chars"))


def token_freq(spark, sf_dir):
    words = corpus(spark, sf_dir).select(F.explode(tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def hash_embed_cells(spark, sf_dir):
    return embedding_cells(corpus(spark, sf_dir), "relative_path", "text").select("relative_path", "idx", "value", F.round("norm", 9).alias("norm"))


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def sparse_topk(spark, sf_dir):
    return _ranked(retrieval.sparse_hits(chunks(spark, sf_dir), questions(spark), K))


def dense_topk(spark, sf_dir):
    return _ranked(retrieval.dense_hits(chunks(spark, sf_dir), questions(spark), K))


def vector_knn(spark, sf_dir):
    """Every vector whose id is divisible by 100, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    near = retrieval.vector_neighbours(vectors, vectors.filter("vec_id % 100 = 0"), K)
    return near.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def lexicon_mentions(spark, sf_dir):
    return extraction.chunk_mentions(chunks(spark, sf_dir), lx.COMMON)


def mention_edges(spark, sf_dir):
    edges = extraction.extract(chunks(spark, sf_dir), lx.COMMON)[1]
    return extraction.merge_edges(edges.filter("rel <> 'RELATED_TO' AND rel <> 'HAS_CHUNK'")).select(*graph.EDGE_KEY)


def related_to_pairs(spark, sf_dir):
    pairs = extraction.related_pairs(chunks(spark, sf_dir), lx.COMMON)
    return pairs.groupBy("src_label", "src_name", "dst_label", "dst_name").agg(F.count("*").alias("n_chunks"))


def graph_nodes(spark, sf_dir):
    nodes = extraction.merge_nodes(extraction.extract(chunks(spark, sf_dir), lx.COMMON)[0])
    return nodes.select("label", "name", F.size("props").alias("n_props"))


def graph_stats(spark, sf_dir):
    nodes, edges = extraction.extract(chunks(spark, sf_dir), lx.COMMON)
    return graph.stats(extraction.merge_nodes(nodes), extraction.merge_edges(edges))


def taxonomy_edges(spark, sf_dir):
    """Dictionary edges between entries that the corpus mentions."""
    seen = mentions(spark, sf_dir).select(F.col("name").alias("src_name")).distinct()
    return common_edges(spark).join(seen, "src_name", "left_semi").select(*graph.EDGE_KEY)


def graph_seed_topk(spark, sf_dir):
    return _ranked(retrieval.graph_seed_hits(mentions(spark, sf_dir), questions(spark), K))


def graph_hop_topk(spark, sf_dir):
    return _ranked(retrieval.graph_hop_hits(mentions(spark, sf_dir), common_edges(spark), questions(spark), lx.COMMON, K))


def hybrid_merge(spark, sf_dir):
    rows, asked = chunks(spark, sf_dir), questions(spark)
    return _ranked(retrieval.merge_hits(retrieval.dense_hits(rows, asked, K), retrieval.sparse_hits(rows, asked, K), K))


def graph_expand(spark, sf_dir):
    hits = retrieval.sparse_hits(chunks(spark, sf_dir), questions(spark), K)
    out = retrieval.expand(hits, mentions(spark, sf_dir), has_chunk(spark, sf_dir))
    return out.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.array_join("entities", "|").alias("entities"), F.array_join("neighbour_chunks", "|").alias("neighbour_chunks"))


def hybrid_rerank(spark, sf_dir):
    (rows, names, sources), asked = prepared(spark, sf_dir), questions(spark)
    hits = written(retrieval.merge_hits(retrieval.dense_hits(rows, asked, K), retrieval.sparse_hits(rows, asked, K), K))
    out = retrieval.rerank(retrieval.expand(hits, names, sources))
    return out.select("query_id", "chunk_id", F.round("score", 5).alias("score"))


def retrieve_modes(spark, sf_dir):
    """All questions, each by its own mode."""
    out = retrieval.retrieve(*prepared(spark, sf_dir), common_edges(spark), questions(spark), lx.COMMON, K)
    return out.select("query_id", "chunk_id", F.round("score", 5).alias("score"), F.size("entities").alias("n_entities"), F.size("neighbours").alias("n_neighbours"))


def star_stats(spark, sf_dir):
    return graph.stats(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))


def query_subgraph(spark, sf_dir):
    nodes, edges = star_nodes(spark, sf_dir), star_edges(spark, sf_dir)
    return graph.query_subgraph(nodes.filter("name <> ''"), edges, ["asia", "europe", "supplier#00000000"], 60, 300)[1]


def graph_view(spark, sf_dir):
    nodes, edges = star_nodes(spark, sf_dir), star_edges(spark, sf_dir)
    return graph.view(nodes.filter("name <> ''"), edges, 35, ["Order"], isolates=False)[0].select("label", "name", "degree")


def edge_integrity(spark, sf_dir):
    return graph.edge_integrity(star_edges(spark, sf_dir), star_nodes(spark, sf_dir))


def shacl_checks(spark, sf_dir):
    return semantic.structural_checks(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))


def shacl_report(spark, sf_dir):
    return semantic.check_report(semantic.structural_checks(star_nodes(spark, sf_dir), star_edges(spark, sf_dir)))


def triples(spark, sf_dir):
    """Instance triples by predicate."""
    rows = semantic.instances(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))
    return rows.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("n_subjects"), F.countDistinct("o").alias("n_objects"))


def bgp_subclass(spark, sf_dir):
    rows = semantic.instances(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))
    return semantic.labelled_links(rows, semantic.NAMESPACE + "IS_SUBTYPE_OF", "child", "parent")


def bgp_related(spark, sf_dir):
    rows = semantic.instances(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))
    return semantic.labelled_links(rows, semantic.NAMESPACE + "RELATED_TO", "source", "target").groupBy("target").agg(F.count("*").alias("n"))


def relation_axioms(spark, sf_dir):
    found = star_edges(spark, sf_dir).groupBy(F.col("rel").alias("relation")).agg(F.count("*").alias("n"))
    return semantic.relation_semantics(found).join(found, "relation").select("relation", "predicate", "owl_type", "domain", "range", "n")


def er_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities; every third name has punctuation, every fifth another case."""
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" !"))).when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return part.select(F.col("p_partkey").alias("entity_id"), name.alias("name"), F.concat_ws("/", F.lower("p_name"), "p_type").alias("gold"))


def _keyed(spark, sf_dir):
    return resolution.canonical_keys(er_entities(spark, sf_dir), lx.DOMAIN).withColumnRenamed("key", "cluster")


def er_groups(spark, sf_dir):
    out = resolution.canonical(_keyed(spark, sf_dir))
    return out.select("cluster", "canonical_name", F.array_join("aliases", "|").alias("aliases"), F.size("entity_ids").alias("n_ids"))


def er_pairs(spark, sf_dir):
    return resolution.predicted_pairs(_keyed(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), "p_brand"), "entity_id").withColumn("cluster", F.concat_ws("/", "cluster", "p_brand")))


def er_metrics(spark, sf_dir):
    return resolution.pair_metrics(resolution.group_pair_counts(_keyed(spark, sf_dir), "gold"))


def er_similar(spark, sf_dir):
    """Similar part names (words and type together) by Jaccard of their words."""
    part = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name")).distinct()
    return resolution.similar_keys(part.select(F.col("name").alias("key"), "name"), 0.7)


def er_greedy(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name")).distinct()
    reps = part.select(F.col("name").alias("key"), "name")
    leaders = resolution.greedy_leaders(reps, resolution.similar_keys(reps, 0.7))
    return leaders.groupBy("leader").agg(F.count("*").alias("n"))


def eval_rows(spark: SparkSession, sf_dir: str, mode: str = "sparse") -> DataFrame:
    """Results rows of the evaluated questions, by one retrieval mode."""
    samples = spark.createDataFrame([(f"e{i}", *s) for i, s in enumerate(EVALUATED)], "query_id string, question string, reference_answer string, expected array<string>")
    tables = prepared(spark, sf_dir)
    retriever = lambda q: retrieval.retrieve(*tables, common_edges(spark), q, lx.COMMON, K)
    return evaluation.answer_samples(samples, retriever, [mode]).withColumn("query_id", F.substring_index("query_id", "/", 1))


def context_metrics(spark, sf_dir):
    """Recall, precision and link ranks over all chunks of each document and fixed terms."""
    rows = _document_contexts(spark, sf_dir)
    e, c = F.array(*map(F.lit, ["the", "with this", "zebra", "und"])), F.col("contexts")
    link = evaluation.link_metrics(e, c)
    return rows.select(
        "relative_path",
        F.round(evaluation.context_recall(e, c), 6).alias("recall"),
        F.round(evaluation.context_precision(e, c), 6).alias("precision"),
        F.coalesce(evaluation.first_hit(e, c), F.lit(0)).alias("first_hit"),
        link["link_hits_3"].alias("hits_3"),
        link["link_hits_10"].alias("hits_10"),
        link["link_mrr"].alias("mrr"),
    )


def _document_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of each document, in order: its own text, so bounded by it."""
    rows = chunks(spark, sf_dir)
    return rows.groupBy("relative_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]).alias("contexts"))


def faithfulness_claims(spark, sf_dir):
    """Claims of each chunk after a document's first against the chunk before it."""
    rows = _document_contexts(spark, sf_dir).filter(F.size("contexts") > 1)
    follow = F.transform(F.slice("contexts", 2, F.size("contexts") - 1), lambda x, i: F.struct((i + 2).alias("chunk"), x.alias("answer"), F.element_at("contexts", i + 1).alias("seen")))
    rows = rows.select("relative_path", F.inline(follow))
    answer, contexts = F.col("answer"), F.array("seen")
    return rows.select("relative_path", "chunk", F.round(evaluation.claim_faithfulness(answer, contexts), 6).alias("faithfulness"), F.round(evaluation.token_faithfulness(answer, contexts), 6).alias("overlap"))


def precision_weighted(spark, sf_dir):
    rows = _document_contexts(spark, sf_dir)
    return rows.select("relative_path", F.round(evaluation.weighted_precision(F.lit("the and that with"), F.array(F.lit("the"), F.lit("and")), F.col("contexts")), 4).alias("precision"))


def eval_samples(spark, sf_dir):
    scored = evaluation.score_samples(eval_rows(spark, sf_dir))
    return scored.select("query_id", F.size("contexts").alias("n_contexts"), *[F.round(m, 4).alias(m) for m in evaluation.FAILURES], F.array_join("failure_reasons", "|").alias("failure_reasons"))


def eval_report(spark, sf_dir):
    return evaluation.report(evaluation.score_samples(eval_rows(spark, sf_dir)))


def contrastive_deltas(spark, sf_dir):
    """Two days' event series as reports: which metrics the later one improves."""
    days = _daily(spark, sf_dir)
    first = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    base = days.join(first, F.col("day") == F.col("a"), "left_semi").groupBy().agg(*[F.avg(m).alias(m) for m in DAY_METRICS])
    last = days.join(first, F.col("day") == F.col("b"), "left_semi").groupBy().agg(*[F.avg(m).alias(m) for m in DAY_METRICS])
    return evaluation.contrast(base, last).select("metric", F.round("delta", 4).alias("delta"), "verdict")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per event type and day."""
    n = F.count("*")
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day"))
    share = lambda cond: F.round(F.sum(F.when(cond, 1).otherwise(0)) / n, 6)
    return rows.agg(share(F.col("user_id") % 3 > 0).alias("answer_faithfulness"), share(F.col("user_id") % 2 == 0).alias("grounding"), (n * 100.0).alias("avg_latency_ms"), F.round(n * 0.0005, 6).alias("estimated_cost_usd"))


def trend_lag_drift(spark, sf_dir):
    rows = governance.trend(_daily(spark, sf_dir), "event_type", "day", DAY_METRICS)
    return rows.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.col(f"delta_{m}") for m in DAY_METRICS], governance.drift(rows.columns).alias("drift_flagged"))


def regression_gate(spark, sf_dir):
    rows = governance.gate(_daily(spark, sf_dir), {"answer_faithfulness": 0.6, "grounding": 0.45}, {"avg_latency_ms": 2000.0, "estimated_cost_usd": 0.012})
    return rows.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.array_join("failures", "|").alias("failures"), "passed")


def slo_report(spark, sf_dir):
    days = _daily(spark, sf_dir).withColumn("last_updated", F.col("day").cast("timestamp")).withColumn("drift_score", F.round(1 - F.col("grounding"), 6))
    rows = governance.service_levels(days, F.to_timestamp(F.lit("2024-03-01 00:00:00")), 0.5, 24.0 * 45)
    return rows.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("freshness_hours", 1).alias("freshness_hours"), "drift_met", "freshness_met", "grounding_met", "status")


def route_rules(spark, sf_dir):
    """The rule signal of every conversation turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.rule_signal(F.coalesce("text", F.lit(""))).alias("r"))
    return turns.select("conv_id", "turn", F.col("r.mode").alias("mode"), F.col("r.score").alias("score"), F.col("r.reason").alias("reason"))


def route_modes(spark, sf_dir):
    """Every conversation turn's mode by rules and prototypes."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), "text")
    return routing.route(turns).groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def guard_decisions(spark, sf_dir):
    """The guard's decision on every turn, and on count and mention questions made from roles."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), "role")
    made = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Count chunk for "), F.col("role"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("who mentions "), F.col("role"), F.lit("?"))).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", governance.guard(made).alias("d")).select("conv_id", "turn", "d.status", "d.reason", "d.label", "d.entity")


def agent_plan(spark, sf_dir):
    """Sub-questions of every conversation turn."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
    return agent.plan(turns).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def agent_answers(spark, sf_dir):
    """The whole workflow over the questions: routed retrieval, template answer, check."""
    rows, names, sources = prepared(spark, sf_dir)
    retriever = lambda q: retrieval.retrieve(rows, names, sources, common_edges(spark), q, lx.COMMON, K)
    out = agent.answer(questions(spark).select("query_id", "text"), retriever)
    return out.select("query_id", F.size("sub_questions").alias("n_parts"), F.size("context").alias("n_context"), F.length("answer").alias("n_chars"), F.size("citations").alias("n_citations"), "attempts", "verified")


def question_terms(spark, sf_dir):
    """The search tokens of every conversation turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", question_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return turns.select("conv_id", "turn", F.array_join("t", " ").alias("tokens"))


NAMED = [
    corpus_summary, chunk_window, chunk_lines, section_chunks, token_freq, hash_embed_cells, sparse_topk, dense_topk, vector_knn, lexicon_mentions, mention_edges, related_to_pairs,
    graph_nodes, graph_stats, taxonomy_edges, graph_seed_topk, graph_hop_topk, hybrid_merge, graph_expand, hybrid_rerank, retrieve_modes, star_stats, query_subgraph, graph_view,
    edge_integrity, shacl_checks, shacl_report, triples, bgp_subclass, bgp_related, relation_axioms, er_groups, er_pairs, er_metrics, er_similar, er_greedy, context_metrics,
    faithfulness_claims, precision_weighted, eval_samples, eval_report, contrastive_deltas, trend_lag_drift, regression_gate, slo_report, route_rules, route_modes, guard_decisions,
    agent_plan, agent_answers, question_terms,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMED}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
