"""Queries that return an operator's rows themselves (routes, sub-questions, guarded answers, exports, costs), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import safe_name
from loomgraph.operators import agent, evaluation, governance, routing, semantic
from loomgraph.plans import oracles as o
from loomgraph.plans.registry import Query, _document_contexts, chunks, prepared, star_edges, star_nodes, table

STAR_LABELS = ["Customer", "Order", "Part", "Supplier", "Nation", "Region", "Planet"]
ASKED = ["the", "with", "DEMON", "zebra"]
TERMS = ["the", "with this", "zebra", "und"]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", "role", F.concat_ws("/", "conv_id", "turn").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


def agent_sub_questions(spark, sf_dir):
    """Every sub-question of every conversation turn."""
    return agent.plan(_turns(spark, sf_dir)).select("question_id", "part", "text")


def route_turns(spark, sf_dir):
    """Every turn's route: mode, confidence, the rule behind it and the label that a reader sees."""
    rows = routing.route(_turns(spark, sf_dir).select("query_id", "text"))
    rule = F.element_at(F.split("reason", ";"), 1)
    return rows.select("query_id", "mode", F.round("confidence", 6).alias("confidence"), F.when(rule.startswith("embedding"), "embedding").otherwise(rule).alias("rule"), routing.signal_label(F.round("confidence", 6), F.col("reason")).alias("label"))


def guarded_counts(spark, sf_dir):
    """Count questions about the star graph's labels, as far as the guard lets them through."""
    label = F.element_at(F.array(*map(F.lit, STAR_LABELS)), (F.col("turn") % len(STAR_LABELS) + 1).cast("int"))
    asked = _turns(spark, sf_dir).select("query_id", governance.guard(F.concat(F.lit("Please count "), F.lower(label)), STAR_LABELS[:-1]).alias("d"))
    return governance.guarded_counts(asked, star_nodes(spark, sf_dir))


def guarded_mentions(spark, sf_dir):
    """Mention questions about words, as far as the guard lets them through: the first 25 chunks of each."""
    word = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("turn") % len(ASKED) + 1).cast("int"))
    asked = _turns(spark, sf_dir).select("query_id", governance.guard(F.concat(F.lit("What mentions "), word)).alias("d"))
    return governance.guarded_mentions(asked, prepared(spark, sf_dir)[1])


def audit_log(spark, sf_dir):
    """The log's row of every turn, at a fixed time."""
    rows = _turns(spark, sf_dir).select(F.coalesce("role", F.lit("none")).alias("tenant_id"), F.col("query_id").alias("request_id"), "text")
    out = governance.audit_rows(rows, F.to_timestamp(F.lit("2024-03-01 12:30:00")))
    return out.select("tenant_id", "request_id", F.md5("question").alias("digest"), "decision.status", "decision.reason", "decision.needs_review", "timestamp_utc")


def graph_snapshot(spark, sf_dir):
    """The bounded export of the star graph: its nodes and edges in order of name."""
    nodes, edges = semantic.snapshot(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))
    return nodes.select(F.lit("node").alias("kind"), "label", "name", F.lit("").alias("rel"), F.lit("").alias("target")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src_label").alias("label"), F.col("src_name").alias("name"), "rel", F.col("dst_name").alias("target")))


def label_scan(spark, sf_dir):
    """The pattern {?s label ?name . ?s type ?class} over the star graph, by class and first word of the name."""
    rows = semantic.instances(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))
    found = semantic.labelled_nodes(rows)
    return found.groupBy("class", F.substring("name", 1, 3).alias("start")).agg(F.count("*").alias("n"))


def safe_names(spark, sf_dir):
    """Names that an identifier may have, of every customer's and part's comment."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", safe_name(F.concat_ws(" ", "p_name", "p_type")).alias("name"), safe_name(F.lit("#-! ")).alias("empty"))


def answer_costs(spark, sf_dir):
    """The estimated cost of each document's last chunk as an answer over all its chunks, and its label."""
    rows = _document_contexts(spark, sf_dir)
    cost = evaluation.estimated_cost(F.lit("the and that with"), F.element_at("contexts", -1), F.col("contexts"))
    return rows.select("relative_path", cost.alias("cost"), routing.cost_label(cost).alias("label"))


def sample_changes(spark, sf_dir):
    """Each document's recall with its first chunk only (baseline) and with all of them (candidate)."""
    rows = _document_contexts(spark, sf_dir)
    e = F.array(*map(F.lit, TERMS))
    of = lambda contexts: rows.select(F.col("relative_path").alias("question"), evaluation.context_recall(e, contexts).alias("context_recall"))
    return evaluation.sample_deltas(of(F.slice("contexts", 1, 1)), of(F.col("contexts")), ["context_recall"])


def multi_hop_scores(spark, sf_dir):
    """Multi-hop accuracy of every conversation: its turns as results of its first one, roles as entities."""
    rows = _turns(spark, sf_dir)
    item = F.struct("turn", F.col("text").alias("content"), F.array_compact(F.array("role")).alias("entities"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    roles = F.array_sort(F.array_distinct(F.flatten(F.transform("items", lambda x: x["entities"]))))
    convs = convs.withColumn("roles", roles)
    results = F.transform("items", lambda x: F.struct(x["content"].alias("content"), x["entities"].alias("entities"), F.col("roles").alias("neighbours")))
    return convs.select("conv_id", evaluation.multi_hop(F.element_at("items", 1)["content"], results).alias("accuracy"))


def chunk_preview(spark, sf_dir):
    """The evidence line of every document's first chunk, as a generator's prompt shows it."""
    first = chunks(spark, sf_dir).filter("chunk_index = 0")
    context = F.array(F.struct("chunk_id", "relative_path", F.lit("part").alias("section"), "content"))
    return first.select("relative_path", agent.context_preview(context).alias("preview"))


def definitions(spark, sf_dir):
    """Which turns, and questions made of them, ask for a definition."""
    made = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("  What is "), "text")).when(F.col("turn") % 4 == 1, F.concat(F.lit("Define "), "text")).when(F.col("turn") % 4 == 2, F.lit("What does it mean?")).otherwise(F.col("text"))
    return _turns(spark, sf_dir).select("query_id", agent.is_definition(made).alias("asks"))


_PLANNED = o.ORACLES["agent_plan"].rsplit("SELECT (part - 1)", 1)[0].replace("given AS (SELECT ", "given AS (SELECT conv_id, turn, ")
_ROUTED = o.ORACLES["route_modes"].rsplit("chosen AS (", 1)[0]
_BLANK = f"{o._STRIP('text')} = ''"
_ROUTES = f"""{_ROUTED} chosen AS (SELECT query_id, CASE WHEN {_BLANK} OR score < 0.2 THEN 'hybrid_rerank' ELSE mode END AS mode, round(CASE WHEN {_BLANK} THEN 0.0::DOUBLE ELSE score END, 6) AS confidence,
  CASE WHEN {_BLANK} THEN 'empty_query_fallback' WHEN score < 0.2 THEN 'low_confidence_fallback' WHEN mode = rule_mode THEN rule ELSE 'embedding' END AS rule FROM best JOIN (SELECT query_id, r.mode AS rule_mode, r.reason AS rule FROM ruled) USING (query_id))
SELECT *, CASE WHEN rule = 'low_confidence_fallback' THEN 'Broad fallback' WHEN confidence >= 0.75 THEN 'High match' WHEN confidence >= 0.5 THEN 'Targeted match' ELSE 'Heuristic match' END AS label FROM chosen"""
_GUARDED = o.ORACLES["guard_decisions"].replace("CASE WHEN turn % 3 = 0 THEN 'Count chunk for ' || role WHEN turn % 3 = 1 THEN 'who mentions ' || role || '?' ELSE coalesce(text, '') END", "coalesce(text, '')")
_T = o._TOKENS_OF
_JOINED = lambda xs: f"array_to_string({xs}, chr(10))"
_JACCARD = "(len(list_intersect(a.en, b.al)) / len(list_distinct(list_concat(a.en, b.al))))"
_HOPS = f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS content, CASE WHEN role IS NULL THEN []::VARCHAR[] ELSE [role] END AS ents FROM conversations),
n AS (SELECT conv_id, list_sort(list_distinct(flatten(list(ents)))) AS nb, arg_min(content, turn) AS q FROM t GROUP BY conv_id),
s AS (SELECT conv_id, turn, {_T("q")} AS asked, {_T(_JOINED("list_concat([content], ents, nb)"))} AS al, {_T(_JOINED("ents"))} AS en, {_T(_JOINED("list_filter(nb, lambda x: NOT list_contains(ents, x))"))} AS gr FROM t JOIN n USING (conv_id)),
g AS (SELECT a.conv_id, a.turn, max({_JACCARD}) AS bridge FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND len(b.al) > 0 AND len(a.en) > 0 GROUP BY ALL),
p AS (SELECT conv_id, CASE WHEN len(al) = 0 THEN 0.0::DOUBLE ELSE round(0.45::DOUBLE * CASE WHEN len(asked) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(asked, al)) / len(asked) END + 0.35::DOUBLE * coalesce(bridge, 0.0::DOUBLE)
  + 0.20::DOUBLE * CASE WHEN len(en) > 0 AND len(gr) > 0 THEN 1.0::DOUBLE WHEN len(en) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 4) END AS score FROM s LEFT JOIN g USING (conv_id, turn))
SELECT conv_id, round(avg(score), 4) AS accuracy FROM p GROUP BY conv_id"""
_RECALL = lambda seen: f"(len(list_filter({TERMS!r}, lambda t: contains(lower({seen}), t))) / {len(TERMS)}.0::DOUBLE)"
_COUNT = lambda x: f"len(regexp_extract_all(lower({x}), {o._TOKEN}))"

_ONE_SPACE = r"regexp_replace(content, '\s+', ' ', 'g')"

ORACLES = {
    "agent_sub_questions": f"{_PLANNED} SELECT conv_id || '/' || turn AS question_id, (part - 1)::INTEGER AS part, t AS text FROM (SELECT conv_id, turn, unnest(parts) AS t, generate_subscripts(parts, 1) AS part FROM given)",
    "route_turns": _ROUTES,
    "guarded_counts": f"""WITH {o._STAR}, q AS (SELECT conv_id || '/' || turn AS query_id, {STAR_LABELS!r}[CAST(turn % {len(STAR_LABELS)} AS INTEGER) + 1] AS label FROM conversations)
SELECT query_id, q.label, (SELECT count(*) FROM nodes WHERE nodes.label = q.label) AS n FROM q WHERE q.label <> 'Planet'""",
    "guarded_mentions": f"""WITH {o._CORPUS}, {o._MENTIONS}, q AS (SELECT conv_id || '/' || turn AS query_id, lower({ASKED!r}[CAST(turn % {len(ASKED)} AS INTEGER) + 1]) AS entity FROM conversations),
hits AS (SELECT entity, chunk_id, name, row_number() OVER (PARTITION BY entity ORDER BY chunk_id, name) AS rank FROM (SELECT DISTINCT chunk_id, canonical AS name FROM mentions) JOIN (SELECT DISTINCT entity FROM q) ON contains(lower(name), entity))
SELECT query_id, chunk_id, name, rank::INTEGER AS rank FROM q JOIN hits USING (entity) WHERE rank <= 25""",
    "audit_log": f"""SELECT coalesce(c.role, 'none') AS tenant_id, c.conv_id || '/' || c.turn AS request_id, md5(coalesce(c.text, '')) AS digest, g.status, g.reason, g.status <> 'safe' AS needs_review, '2024-03-01T12:30:00.000000+00:00' AS timestamp_utc
FROM conversations c JOIN ({_GUARDED}) g USING (conv_id, turn)""",
    "graph_snapshot": f"""WITH {o._STAR} SELECT * FROM (SELECT 'node' AS kind, label, name, '' AS rel, '' AS target FROM nodes WHERE name IS NOT NULL ORDER BY label, name LIMIT 300)
UNION ALL SELECT * FROM (SELECT 'edge', src_label, src_name, rel, dst_name FROM edges WHERE src_name IS NOT NULL AND dst_name IS NOT NULL ORDER BY src_name, rel, dst_name, src_label LIMIT 600)""",
    "label_scan": f"WITH {o._STAR} SELECT label AS class, substring(name, 1, 3) AS start, count(*) AS n FROM (SELECT DISTINCT label, name FROM nodes WHERE name <> '') GROUP BY ALL",
    "safe_names": "SELECT p_partkey, CASE WHEN regexp_replace(concat_ws(' ', p_name, p_type), '[^A-Za-z0-9_]', '', 'g') = '' THEN 'Entity' ELSE regexp_replace(concat_ws(' ', p_name, p_type), '[^A-Za-z0-9_]', '', 'g') END AS name, 'Entity' AS empty FROM part",
    "answer_costs": f"""WITH {o._CONTEXTS}, c AS (SELECT relative_path, round((4 + {_COUNT("contexts[-1]")} + {_COUNT(_JOINED("contexts"))}) * 0.0000005::DOUBLE, 6) AS cost FROM ctx)
SELECT *, CASE WHEN cost <= 0 THEN 'Low' WHEN cost < 0.001 THEN '<$0.001 / query' ELSE '$' || printf('%.4f', cost) || ' / query' END AS label FROM c""",
    "sample_changes": f"""WITH {o._CONTEXTS} SELECT relative_path AS question, {_RECALL("contexts[1]")} AS baseline_context_recall, {_RECALL(_JOINED("contexts"))} AS candidate_context_recall,
round({_RECALL(_JOINED("contexts"))} - {_RECALL("contexts[1]")}, 4) AS delta_context_recall FROM ctx""",
    "multi_hop_scores": _HOPS,
    "chunk_preview": f"WITH {o._CORPUS} SELECT path AS relative_path, '[1] source=' || path || ' section=part evidence=' || substring({o._STRIP(_ONE_SPACE)}, 1, 500) AS preview FROM chunks WHERE chunk_index = 0",
    "definitions": f"""WITH m AS (SELECT conv_id || '/' || turn AS query_id, {o._STRIP("CASE turn % 4 WHEN 0 THEN '  What is ' || coalesce(text, '') WHEN 1 THEN 'Define ' || coalesce(text, '') WHEN 2 THEN 'What does it mean?' ELSE coalesce(text, '') END")} AS q FROM conversations)
SELECT query_id, regexp_matches(lower(q), '^what\\s+is\\s+|^define\\s+|^what\\s+does\\s+.*\\s+mean\\??$|^meaning\\s+of\\s+') AS asks FROM m""",
}
NAMED = [agent_sub_questions, route_turns, guarded_counts, guarded_mentions, audit_log, graph_snapshot, label_scan, safe_names, answer_costs, sample_changes, multi_hop_scores, chunk_preview, definitions]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMED}
