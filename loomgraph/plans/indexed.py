"""Queries over indexes of vectors and texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.text import question_tokens
from loomgraph.operators import graph, semantic, text_index, vector_index
from loomgraph.operators.tables import shared_folder
from loomgraph.plans import oracles as o
from loomgraph.plans.registry import K, Query, chunks, questions, star_edges, star_nodes, table
from loomgraph.sources.turtle import read_turtle, write_turtle


def vector_index_knn(spark, sf_dir):
    """Every vector whose id is divisible by 100 against all, visiting the lists that can hold a nearer row."""
    vectors = table(spark, sf_dir, "embeddings")
    near = vector_index.search(vector_index.build(vectors), vectors.filter("vec_id % 100 = 0"), K, exact=True)
    return near.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def vector_ann(spark, sf_dir):
    """The same queries against as many lists as give a recall of 0.95 on drawn rows."""
    vectors = table(spark, sf_dir, "embeddings")
    index = vector_index.build(vectors)
    near = vector_index.search(index, vectors.filter("vec_id % 100 = 0"), K, vector_index.probes_for(index, vectors, K))
    return near.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def sparse_index_topk(spark, sf_dir):
    """sparse_topk through the trigram index."""
    hits = text_index.search(text_index.build(chunks(spark, sf_dir)), questions(spark), K)
    return hits.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def turn_subgraphs(spark, sf_dir):
    """The subgraph of every conversation turn's search tokens in the star graph: its edges."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), question_tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    return graph.subgraphs(star_nodes(spark, sf_dir).filter("name <> ''"), star_edges(spark, sf_dir), turns, 1, 20, 60)[1].distinct()


def turtle_triples(spark, sf_dir):
    """The star graph written as Turtle and read back: its triples by predicate."""
    path = shared_folder(spark)
    write_turtle(semantic.instances(star_nodes(spark, sf_dir), star_edges(spark, sf_dir), repeats=True), path, {"g": semantic.NAMESPACE, "rdfs": semantic.RDFS})
    return read_turtle(spark, path).groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("n_subjects"), F.countDistinct("o").alias("n_objects"))


_TURNS = f"""WITH {o._STAR}, asked AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM (
    SELECT query_id, list(token ORDER BY i)[:12] AS terms FROM (
      SELECT query_id, token, min(i) AS i FROM (SELECT conv_id || '/' || turn AS query_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), {o._TOKEN}) AS ts FROM conversations)) GROUP BY ALL) GROUP BY query_id)),
  named AS (SELECT DISTINCT label, name FROM nodes WHERE name <> ''),
  hits AS (SELECT term, label, name FROM (SELECT DISTINCT term FROM asked) t JOIN named ON contains(lower(name), term)),
  seeds AS (SELECT query_id, label, name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY label, name) AS r FROM (SELECT DISTINCT query_id, label, name FROM hits JOIN asked USING (term))) WHERE r <= 20),
  both_ways AS (SELECT src_label AS label, src_name AS name, dst_label AS l, dst_name AS n FROM edges UNION ALL SELECT dst_label, dst_name, src_label, src_name FROM edges),
  near AS (SELECT DISTINCT query_id, b.l AS label, b.n AS name FROM seeds JOIN both_ways b USING (label, name) JOIN named k ON k.label = b.l AND k.name = b.n),
  kept AS (SELECT query_id, label, name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, label, name) AS r FROM (SELECT query_id, label, name, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM seeds UNION ALL SELECT *, 1 FROM near) GROUP BY ALL)) WHERE r <= 60)
SELECT DISTINCT a.query_id, e.* FROM edges e JOIN kept a ON e.src_label = a.label AND e.src_name = a.name JOIN kept b ON b.query_id = a.query_id AND e.dst_label = b.label AND e.dst_name = b.name"""

NAMED = [vector_index_knn, vector_ann, sparse_index_topk, turn_subgraphs, turtle_triples]
ORACLES = {"vector_index_knn": o.ORACLES["vector_knn"], "sparse_index_topk": o.ORACLES["sparse_topk"], "turn_subgraphs": _TURNS, "turtle_triples": o.ORACLES["triples"]}


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMED}
