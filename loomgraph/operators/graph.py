"""Property graph tables: upsert, integrity, statistics, subgraphs.

nodes: label, name (and props). edges: src_label, src_name, rel, dst_label, dst_name (and props).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import n_contained, trigrams
from loomgraph.operators.tables import written

EDGE_KEY = ["src_label", "src_name", "rel", "dst_label", "dst_name"]
# Labels that a graph view leaves out, and labels that it shows first.
VIEW_LEFT_OUT = ["Chunk", "DocPage", "ExampleNotebook", "TestCase"]
VIEW_FIRST = ["PortfolioMethod", "RiskMeasure", "ConstraintType", "Estimator", "PythonClass", "Concept"]


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New keys are added; of equal keys the new properties go over the old ones."""
    a, b = old.select(*key, F.col("props").alias("was")), new.select(*key, F.col("props").alias("now"))
    none = F.create_map().cast("map<string,string>")
    keep = F.map_filter(F.coalesce("was", none), lambda k, _: ~F.map_contains_key(F.coalesce("now", none), k))
    return a.join(b, key, "full_outer").select(*key, F.map_concat(keep, F.coalesce("now", none)).alias("props"))


def write_nodes(nodes: DataFrame, path: str) -> None:
    """One folder per label, so that readers of a label prune the rest."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(path)


def duplicates(nodes: DataFrame) -> DataFrame:
    """Keys that break the uniqueness of (label, name)."""
    return nodes.groupBy("label", "name").agg(F.count("*").alias("n")).filter("n > 1")


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with src_ok and dst_ok: both ends exist, by label and name."""
    known = nodes.select("label", "name").distinct().withColumn("_ok", F.lit(True))
    at = lambda side: known.select(F.col("label").alias(f"{side}_label"), F.col("name").alias(f"{side}_name"), F.col("_ok").alias(f"{side}_ok"))
    out = edges.join(at("src"), ["src_label", "src_name"], "left").join(at("dst"), ["dst_label", "dst_name"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("src_ok", "dst_ok")})


def edge_integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges, skipped ones, the limit max(1, 5 %) and whether it is kept."""
    out = with_endpoints(edges, nodes).agg(F.count("*").alias("n_edges"), F.sum(F.when(F.col("src_ok") & F.col("dst_ok"), 0).otherwise(1)).alias("n_skipped"))
    limit = F.greatest(F.lit(1), F.floor(F.col("n_edges") * 0.05)).cast("long")
    return out.select("n_edges", F.coalesce("n_skipped", F.lit(0)).cast("long").alias("n_skipped"), limit.alias("limit")).withColumn("ok", F.col("n_skipped") <= F.col("limit"))


def require_integrity(edges: DataFrame, nodes: DataFrame) -> None:
    row = edge_integrity(edges, nodes).first()
    if not row.ok:
        raise RuntimeError(f"{row.n_skipped} of {row.n_edges} edges lack an end; the limit is {row.limit}")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name, n: totals, nodes by label and edges by relation, each from one pass."""

    def counted(rows: DataFrame, total: str, kind: str, column: str) -> DataFrame:
        whole = F.grouping(column) == 1
        out = rows.rollup(column).agg(F.when(whole, "total").otherwise(kind).alias("kind"), F.when(whole, total).otherwise(F.col(column)).alias("_name"), F.count("*").alias("n"))
        return out.select("kind", F.col("_name").alias("name"), "n")

    return counted(nodes, "nodes", "label", "label").unionByName(counted(edges, "edges", "relation", "rel"))


NODE_KEY = ["label", "name"]


def _node_text(nodes: DataFrame) -> Column:
    """What terms are looked up in: the name, and where nodes have properties their content and path."""
    parts = [F.col("name"), *[F.col("props")[k] for k in ("content", "relative_path")]] if "props" in nodes.columns else [F.col("name")]
    return F.lower(F.concat_ws("\n", *parts))


def query_subgraph(nodes: DataFrame, edges: DataFrame, terms: list[str], most_seeds: int = 60, most_nodes: int = 300) -> tuple[DataFrame, DataFrame]:
    """Nodes within one hop of those that a term occurs in, and the edges among them.

    Seeds come first, then neighbours, each by (label, name); both limits are part of the query.
    """
    array = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    found = nodes.filter(n_contained(array, _node_text(nodes)) > 0).select(F.lit(0).alias("query_id"), *NODE_KEY).distinct()
    kept, inner = expanded(found, nodes, edges, 1, most_seeds, most_nodes)
    return kept.drop("query_id"), inner.select(*EDGE_KEY)


#: Terms of a batch that is broadcast; more go in batches of about that size.
TERMS = 100_000


def subgraphs(nodes: DataFrame, edges: DataFrame, questions: DataFrame, hops: int = 1, most_seeds: int = 60, most_nodes: int = 300) -> tuple[DataFrame, DataFrame]:
    """The subgraph of every question (query_id, terms), many at once: kept nodes with their hop, and edges among them.

    Terms are of three characters or more, others are left out. A term meets only the nodes that
    hold its rarest trigram, and goes on with its first `most_seeds` nodes: a question's seeds are
    the first of all its terms' nodes, so they are among these.
    """
    asked = questions.select("query_id", F.explode("terms").alias("term")).filter(F.length("term") >= 3).withColumn("term", F.lower("term")).distinct()
    texts = written(nodes.select(*NODE_KEY, _node_text(nodes).alias("text")))
    held = texts.select(*NODE_KEY, "text", F.explode(trigrams(F.col("text"))).alias("gram"))
    n_held = held.groupBy("gram").agg(F.count("*").alias("n"))
    own = asked.select("term").distinct().select("term", F.explode(trigrams(F.col("term"))).alias("gram"))
    # A term with a trigram that no node has is dropped here.
    rare = written(own.join(n_held, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0").select("term", "r.gram"))
    batches = max(1, math.ceil(rare.count() / TERMS))
    hits = None
    for i in range(batches):
        met = held.join(F.broadcast(rare.filter(F.pmod(F.xxhash64("term"), F.lit(batches)) == i)), "gram").filter(F.contains("text", F.col("term")))
        # A node may be there with several texts, so equal nodes take one rank.
        place = F.dense_rank().over(Window.partitionBy("term").orderBy(*NODE_KEY))
        first = met.withColumn("place", place).filter(F.col("place") <= max(1, most_seeds)).select("term", *NODE_KEY).distinct()
        hits = first if hits is None else hits.unionByName(first)
    return expanded(written(hits).join(asked, "term").select("query_id", *NODE_KEY).distinct(), nodes, edges, hops, most_seeds, most_nodes)


def expanded(found: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int, most_seeds: int, most_nodes: int) -> tuple[DataFrame, DataFrame]:
    """kept (query_id, label, name, hop) and edges among kept, from found (query_id, label, name).

    Questions with the same seeds are one group and are expanded once. The frontier is a table: every
    round joins the nodes of the last hop with their first neighbours, cuts each group to its limit and
    is written, so that the plan stays as small after any number of hops.
    """
    most, key = max(1, most_nodes), ["group_id", *NODE_KEY]
    seeds = top_per(found, "query_id", max(1, most_seeds), *NODE_KEY).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*NODE_KEY))).alias("seeds"))
    chosen = written(seeds)
    groups = written(chosen.select("seeds").distinct().withColumn("group_id", F.monotonically_increasing_id()))
    members = written(chosen.join(groups, "seeds").select("query_id", "group_id"))
    frontier = kept = written(groups.select("group_id", F.inline("seeds")).select(*key, F.lit(0).alias("hop")))
    for hop in range(1, hops + 1):
        near = frontier.join(first_neighbours(frontier, nodes, edges, most), NODE_KEY).select("group_id", F.col("n_label").alias("label"), F.col("n_name").alias("name")).distinct()
        near = near.join(kept.select(*key), key, "left_anti")
        room = F.lit(most) - F.coalesce("n", F.lit(0))
        ranked = top_per(near, "group_id", most, *NODE_KEY).join(kept.groupBy("group_id").agg(F.count("*").alias("n")), "group_id", "left")
        frontier = written(ranked.filter(F.col("rank") <= room).select(*key, F.lit(hop).alias("hop")))
        kept = written(kept.unionByName(frontier))
    kept = top_per(kept, "group_id", most, "hop", *NODE_KEY).drop("rank")
    kept = written(kept)
    among = written(kept.select(*NODE_KEY).distinct())
    side = lambda rows, s, *more: rows.select(*more, F.col("label").alias(f"{s}_label"), F.col("name").alias(f"{s}_name"))
    inner = edges.select(*EDGE_KEY)
    for s in ("src", "dst"):
        inner = inner.join(side(among, s), [f"{s}_label", f"{s}_name"], "left_semi")
    inner = written(inner.join(side(kept, "src", "group_id"), ["src_label", "src_name"]).join(side(kept, "dst", "group_id"), ["group_id", "dst_label", "dst_name"]).select("group_id", *EDGE_KEY))
    return members.join(kept, "group_id").select("query_id", *NODE_KEY, "hop"), members.join(inner, "group_id").select("query_id", *EDGE_KEY)


def first_neighbours(frontier: DataFrame, nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """label, name, n_label, n_name: the first `most` neighbours, of those that are nodes, of each node of the frontier.

    Later ones are never needed: a group with n kept nodes takes `most` - n more at most, and of a
    node's first `most` neighbours no more than n are kept already.
    """
    ends = lambda a, b: edges.select(F.col(f"{a}_label").alias("label"), F.col(f"{a}_name").alias("name"), F.col(f"{b}_label").alias("n_label"), F.col(f"{b}_name").alias("n_name"))
    at = written(frontier.select(*NODE_KEY).distinct())
    near = ends("src", "dst").unionByName(ends("dst", "src")).join(at, NODE_KEY, "left_semi").distinct()
    near = near.join(nodes.select(F.col("label").alias("n_label"), F.col("name").alias("n_name")), ["n_label", "n_name"], "left_semi")
    return written(top_per(near, NODE_KEY, most, "n_label", "n_name").select(*NODE_KEY, "n_label", "n_name"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = lambda s: edges.select(F.col(f"{s}_label").alias("label"), F.col(f"{s}_name").alias("name"))
    loops = (F.col("src_label") == F.col("dst_label")) & (F.col("src_name") == F.col("dst_name"))
    return ends("src").unionByName(edges.filter(~loops).select(F.col("dst_label").alias("label"), F.col("dst_name").alias("name"))).groupBy("label", "name").agg(F.count("*").alias("degree"))


def view(nodes: DataFrame, edges: DataFrame, most: int = 35, left_out: list[str] = VIEW_LEFT_OUT, isolates: bool = True) -> tuple[DataFrame, DataFrame]:
    """At most `most` nodes for display, first by label priority and degree; edges among them without loops."""
    rows = nodes.select("label", "name").filter(~F.col("label").isin(left_out)).join(degrees(edges), ["label", "name"], "left" if isolates else "inner")
    rows = rows.withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("first", F.col("label").isin(VIEW_FIRST))
    kept = rows.orderBy(F.desc("first"), F.desc("degree"), "label", "name").limit(most)
    side = lambda s: F.broadcast(kept.select(F.col("label").alias(f"{s}_label"), F.col("name").alias(f"{s}_name")))
    inner = edges.filter(~((F.col("src_label") == F.col("dst_label")) & (F.col("src_name") == F.col("dst_name"))))
    return kept, inner.join(side("src"), ["src_label", "src_name"], "left_semi").join(side("dst"), ["dst_label", "dst_name"], "left_semi").select(*EDGE_KEY)


def top_per(rows: DataFrame, group: str | list[str], k: int, *order) -> DataFrame:
    """The first k rows of each group; Spark cuts each task's groups to k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)
