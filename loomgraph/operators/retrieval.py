"""Batched retrieval: top-k chunks for many questions by dense, sparse, graph and hybrid scores.

questions: query_id, text (and mode); they are counted, and broadcast in batches of about QUESTIONS.
chunks: chunk_id, content (and more). mentions: chunk_id, name. has_chunk: src, chunk_id.
Hits: query_id, chunk_id, score, rank. Ties go to the smaller chunk_id. Content is joined back
after the cut, so scoring carries keys and scores only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.lexicon import Entry
from loomgraph.functions.text import embedding_cells, n_contained, question_tokens
from loomgraph.operators import vector_index
from loomgraph.operators.graph import top_per
from loomgraph.operators.tables import written

DENSE_SHARE, SPARSE_SHARE = 0.65, 0.35
MOST_ENTITIES, MOST_NEIGHBOURS = 20, 10


#: Questions of a batch that is broadcast: up to 12 tokens, or 256 cells, each.
QUESTIONS = 20_000


def by_batches(search: Callable[[DataFrame], DataFrame], questions: DataFrame) -> DataFrame:
    """search of all questions; more than QUESTIONS go in several batches, by a hash of their id."""
    n = -(-questions.count() // QUESTIONS)
    if n <= 1:
        return search(questions)
    return reduce(DataFrame.unionByName, [search(questions.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)) for i in range(n)])


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    return top_per(hits.select("query_id", "chunk_id", "score"), "query_id", k, F.desc("score"), "chunk_id")


def sparse_hits(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Score: the question's tokens that are substrings of the chunk."""
    return by_batches(lambda q: _sparse_hits(chunks, q, k), questions)


def _sparse_hits(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    asked = questions.select("query_id", question_tokens(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
    rows = chunks.select("chunk_id", F.lower("content").alias("content"))
    hit = F.exists("tokens", lambda t: F.contains("content", t))
    scored = rows.join(F.broadcast(asked), hit).select("query_id", "chunk_id", n_contained(F.col("tokens"), F.col("content")).cast("double").alias("score"))
    return top_hits(scored, k)


#: rows, key column, text column, dim -> key, idx, value, norm: a provider of embeddings as their non-zero cells.
Embedder = Callable[[DataFrame, str, str, int], DataFrame]


def dense_hits(chunks: DataFrame, questions: DataFrame, k: int, dim: int = 256, metric: str = "l2", embedder: Embedder = embedding_cells) -> DataFrame:
    """Score 1 / (1 + distance) of embeddings (hashed ones by default); metric l2, squared_l2 or cosine.

    Only cells that a question has can add to a product, so chunk cells meet the questions'
    (broadcast) cells by index; a chunk without a common cell is no hit.
    """
    return by_batches(lambda q: _dense_hits(chunks, q, k, dim, metric, embedder), questions)


def _dense_hits(chunks: DataFrame, questions: DataFrame, k: int, dim: int, metric: str, embedder: Embedder) -> DataFrame:
    cells = embedder(chunks, "chunk_id", "content", dim)
    asked = embedder(questions, "query_id", "text", dim).select("query_id", "idx", F.col("value").alias("q"), F.col("norm").alias("q_norm"))
    products = cells.join(F.broadcast(asked), "idx").groupBy("query_id", "chunk_id").agg(F.sum(F.col("value") * F.col("q")).alias("dot"), F.max("norm").alias("norm"), F.max("q_norm").alias("q_norm"))
    cosine = F.col("dot") / (F.col("norm") * F.col("q_norm"))
    return top_hits(products.select("query_id", "chunk_id", (1 / (1 + _distance(cosine, metric))).alias("score")), k)


def _distance(cosine, metric: str):
    squared = F.greatest(F.lit(0.0), 2 - 2 * cosine)
    return {"l2": F.sqrt(squared), "squared_l2": squared, "cosine": F.greatest(F.lit(0.0), 1 - cosine)}[metric]


def vector_neighbours(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact nearest neighbours of stored vectors (vec_id, embedding) by L2 distance, without themselves.

    A scan in blocks; vector_index.search visits fewer rows.
    """
    return vector_index.full_scan(vectors, queries, k)


def graph_seed_hits(mentions: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Chunks that mention an entity whose name holds a question token: the most tokens of one entity."""
    return by_batches(lambda q: _graph_seed_hits(mentions, q, k), questions)


def _graph_seed_hits(mentions: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    asked = questions.select("query_id", question_tokens(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
    names = mentions.select("name").distinct()
    n = n_contained(F.col("tokens"), F.col("name"))
    seeds = names.join(F.broadcast(asked), n > 0).select("query_id", "name", n.cast("double").alias("score"))
    return top_hits(mentions.join(seeds, "name").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)


def asked_concepts(questions: DataFrame, lexicon: list[Entry]) -> DataFrame:
    """query_id, name: canonical names that a question contains."""
    names = F.array(*[F.lit(e.canonical) for e in lexicon])
    return questions.select("query_id", F.explode(F.filter(names, lambda n: F.contains(F.lower("text"), F.lower(n)))).alias("name"))


def graph_hop_hits(mentions: DataFrame, edges: DataFrame, questions: DataFrame, lexicon: list[Entry], k: int) -> DataFrame:
    """Chunks that mention a parent, alternative or requirement of a concept in the question; score 1."""
    return by_batches(lambda q: _graph_hop_hits(mentions, edges, q, lexicon, k), questions)


def _graph_hop_hits(mentions: DataFrame, edges: DataFrame, questions: DataFrame, lexicon: list[Entry], k: int) -> DataFrame:
    up = edges.filter(F.col("rel").isin("IS_SUBTYPE_OF", "REQUIRES", "ALTERNATIVE_TO")).select(F.lower("src_name").alias("name"), F.col("dst_name").alias("related"))
    back = edges.filter("rel = 'ALTERNATIVE_TO'").select(F.lower("dst_name").alias("name"), F.col("src_name").alias("related"))
    asked = asked_concepts(questions, lexicon).select("query_id", F.lower("name").alias("name"))
    related = up.union(back).join(F.broadcast(asked), "name").select("query_id", F.col("related").alias("name")).distinct()
    return top_hits(mentions.join(related, "name").select("query_id", "chunk_id").distinct().withColumn("score", F.lit(1.0)), k)


def merge_hits(dense: DataFrame, sparse: DataFrame, k: int, normalize: bool = False) -> DataFrame:
    """Dense alone keeps its score; sparse alone has 0.35 of it; both 0.65 and 0.35.

    normalize: sparse scores are first divided by the question's largest.
    """
    d, s = dense.select("query_id", "chunk_id", F.col("score").alias("d")), sparse.select("query_id", "chunk_id", F.col("score").alias("s"))
    if normalize:
        s = s.withColumn("s", F.col("s") / F.max("s").over(Window.partitionBy("query_id")))
    score = F.when(F.col("s").isNull(), F.col("d")).otherwise(DENSE_SHARE * F.coalesce("d", F.lit(0.0)) + SPARSE_SHARE * F.col("s"))
    return top_hits(d.join(s, ["query_id", "chunk_id"], "full_outer").withColumn("score", score), k)


def expand(hits: DataFrame, mentions: DataFrame, has_chunk: DataFrame) -> DataFrame:
    """Hits with entities, neighbour chunks and neighbours; score + 0.05 and 0.02 for each of the first two.

    A source's neighbour list is its first chunks by name, so a source of any size adds a bounded row.
    """
    keys = hits.select("chunk_id").distinct()
    named = top_per(mentions.join(keys, "chunk_id", "left_semi").select("chunk_id", "name").distinct(), "chunk_id", MOST_ENTITIES, "name")
    entities = named.groupBy("chunk_id").agg(F.array_sort(F.collect_list("name")).alias("entities"))
    sources = has_chunk.select("src", "chunk_id").distinct()
    own = sources.join(keys, "chunk_id", "left_semi")
    first = top_per(sources.join(own.select("src").distinct(), "src", "left_semi"), "src", MOST_NEIGHBOURS + 1, "chunk_id")
    lists = first.groupBy("src").agg(F.array_sort(F.collect_list("chunk_id")).alias("siblings"))
    near = own.join(lists, "src").groupBy("chunk_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("siblings")))).alias("siblings"))
    none = F.array().cast("array<string>")
    out = hits.join(entities, "chunk_id", "left").join(near, "chunk_id", "left")
    out = out.withColumn("entities", F.coalesce("entities", none))
    out = out.withColumn("neighbour_chunks", F.slice(F.filter(F.coalesce("siblings", none), lambda x: x != F.col("chunk_id")), 1, MOST_NEIGHBOURS))
    out = out.withColumn("neighbours", F.array_sort(F.array_union("entities", "neighbour_chunks")))
    score = F.col("score") + 0.05 * F.size("entities") + 0.02 * F.size("neighbour_chunks")
    return out.withColumn("score", score).select("query_id", "chunk_id", "score", "entities", "neighbour_chunks", "neighbours")


def rerank(expanded: DataFrame) -> DataFrame:
    """The hybrid mode's boost for graph context."""
    return expanded.withColumn("score", F.round(F.col("score") + 0.03 * F.size("entities") + 0.015 * F.size("neighbours"), 6))


def retrieve(chunks: DataFrame, mentions: DataFrame, has_chunk: DataFrame, edges: DataFrame, questions: DataFrame, lexicon: list[Entry], k: int = 5, dim: int = 256, dense: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Expanded hits of every question by its mode (dense, sparse, graph or hybrid_rerank), ranked.

    dense: the store that answers dense questions, dense_hits by default; sparse_hits makes it a
    lexical store.
    """
    dense = dense or (lambda rows, asked, most: dense_hits(rows, asked, most, dim))
    mode = F.coalesce("mode", F.lit(""))
    kinds = questions.select("query_id", F.when(mode.isin("dense", "sparse", "graph"), mode).otherwise("hybrid").alias("kind"))
    asked = questions.join(kinds, "query_id")
    of = lambda *names: asked.filter(F.col("kind").isin(*names)).drop("kind")
    # Each score is computed once for all modes that use it; what it leaves, k rows a question, is written.
    scored = {name: written(found.join(kinds, "query_id")) for name, found in (("dense", dense(chunks, of("dense", "hybrid"), k)), ("sparse", sparse_hits(chunks, of("sparse", "hybrid"), k)))}
    part = lambda name, kind: scored[name].filter(F.col("kind") == kind).drop("kind")
    seeds, hops = graph_seed_hits(mentions, of("graph"), k), graph_hop_hits(mentions, edges, of("graph"), lexicon, k)
    hits = part("dense", "dense").unionByName(part("sparse", "sparse"))
    hits = hits.unionByName(top_hits(merge_hits(seeds, hops, 2 * k), k)).unionByName(merge_hits(part("dense", "hybrid"), part("sparse", "hybrid"), k))
    out = expand(written(hits), mentions, has_chunk).join(kinds, "query_id")
    out = rerank(out.withColumn("plain", F.col("score"))).withColumn("score", F.when(F.col("kind") == "hybrid", F.col("score")).otherwise(F.col("plain"))).drop("kind", "plain")
    ranked = written(top_per(out, "query_id", k, F.desc("score"), "chunk_id"))
    return chunks.select("chunk_id", "content", "relative_path", "section", "chunk_index", "line_start", "line_end").join(F.broadcast(ranked), "chunk_id")


def upsert_chunks(old: DataFrame, new: DataFrame, sequence: str | None = None) -> DataFrame:
    """Chunks by id, a new one in place of an old one; of new ones with one id the latest by `sequence`, else the greatest row, so that a rerun gives the same.

    versioned.chunk_table keeps a stored table up to date without reading all of it.
    """
    rest = sorted((c for c in new.columns if c != "chunk_id"), key=lambda c: (c != sequence, new.columns.index(c)))
    last = new.groupBy("chunk_id").agg(F.max(F.struct(*rest)).alias("last")).select("chunk_id", "last.*").select(*new.columns)
    return old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(last)
