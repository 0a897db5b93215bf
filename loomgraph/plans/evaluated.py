"""Queries of answers and evaluations in one plan for many modes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import lexicon as lx
from loomgraph.operators import evaluation, retrieval
from loomgraph.plans import oracles as o
from loomgraph.plans.registry import EVALUATED, K, Query, _document_contexts, chunks, common_edges, prepared

MODES = ["dense", "sparse", "graph", "hybrid_rerank"]
ASKED = "the and that with"


def eval_modes(spark, sf_dir):
    """Every evaluated question by every mode: one report per mode."""
    samples = spark.createDataFrame([(f"e{i}", *s) for i, s in enumerate(EVALUATED)], "query_id string, question string, reference_answer string, expected array<string>")
    tables = prepared(spark, sf_dir)
    retriever = lambda q: retrieval.retrieve(*tables, common_edges(spark), q, lx.COMMON, K)
    scored = evaluation.score_samples(evaluation.answer_samples(samples, retriever, MODES), "heuristic")
    return evaluation.report(scored, "mode").select("mode", "num_samples", "context_recall", "context_precision", "link_mrr", "link_hits_3")


def answer_metrics(spark, sf_dir):
    """Relevance and grounding of each document's last chunk as an answer over all its chunks."""
    rows = _document_contexts(spark, sf_dir).withColumn("answer", F.element_at("contexts", -1))
    return rows.select("relative_path", evaluation.weighted_relevance(F.lit(ASKED), F.col("answer")).alias("relevance"), evaluation.grounding(F.col("answer"), F.col("contexts")).alias("grounding"))


def template_answers(spark, sf_dir):
    """The template answer over each document's first chunk."""
    first = chunks(spark, sf_dir).filter("chunk_index = 0").select("relative_path", F.array(F.struct("content", F.array().cast("array<string>").alias("entities"), "relative_path")).alias("results"))
    return first.select("relative_path", evaluation.synthesize(F.lit(ASKED), F.col("results")).alias("answer"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EVALUATED = ", ".join(f"('e{i}/{m}', '{m}', {_quote(q)})" for i, (q, _, _) in enumerate(EVALUATED) for m in MODES)
_TERMS = ", ".join(f"('e{i}', [{', '.join(map(_quote, terms))}]::VARCHAR[])" for i, (_, _, terms) in enumerate(EVALUATED))
_QUESTIONS = f"questions(query_id, mode, text) AS (VALUES {_EVALUATED})," + o._QUESTIONS.split("q6', 'sparse', 'With with THE the Demonstrative FOR')),", 1)[1]
_MERGED = "(SELECT query_id, chunk_id, CASE WHEN h.score IS NULL THEN s.score ELSE 0.65::DOUBLE * coalesce(s.score, 0) + 0.35::DOUBLE * h.score END AS score FROM seed s FULL JOIN hop h USING (query_id, chunk_id))"
_EVAL = f"""WITH {o._CORPUS}, {_QUESTIONS}, {o._MENTIONS}, {o._TAXONOMY}, {o._SPARSE}, {o._DENSE}, {o._HYBRID}, {o._EXPAND},
seed AS {o._top(o._SEED_ALL)}, hop AS {o._top(o._HOP_ALL)}, graph AS {o._top(_MERGED)}, wanted(sample, terms) AS (VALUES {_TERMS}),
hits AS (SELECT 'sparse' AS mode, * FROM sparse UNION ALL SELECT 'dense', * FROM dense UNION ALL SELECT 'graph', * FROM graph UNION ALL SELECT 'hybrid_rerank', * FROM hybrid),
ended AS (SELECT query_id, chunk_id, content, CASE WHEN mode = 'hybrid_rerank' THEN round({o._EXPANDED} {o._BOOST}, 6) ELSE {o._EXPANDED} END AS score FROM hits JOIN questions USING (query_id, mode) JOIN plus USING (chunk_id) JOIN (SELECT chunk_id, content FROM chunks) USING (chunk_id)),
ctx AS (SELECT query_id, list(lower(content) ORDER BY score DESC, chunk_id) AS seen FROM ended GROUP BY query_id),
per AS (SELECT q.mode, terms, coalesce(seen, []) AS seen FROM questions q JOIN wanted ON sample = split_part(q.query_id, '/', 1) LEFT JOIN ctx USING (query_id)),
hit AS (SELECT *, list_filter(range(1, len(seen) + 1), lambda i: len(list_filter(terms, lambda t: contains(seen[i], t))) > 0) AS ranks FROM per)
SELECT mode, count(*) AS num_samples, round(avg(CASE WHEN len(terms) = 0 THEN 0 ELSE len(list_filter(terms, lambda t: contains(array_to_string(seen, chr(10)), t))) / len(terms) END), 4) AS context_recall,
  round(avg(CASE WHEN len(seen) = 0 THEN 0 ELSE len(ranks) / len(seen) END), 4) AS context_precision, round(avg(CASE WHEN len(ranks) = 0 THEN 0 ELSE round(1.0::DOUBLE / ranks[1], 4) END), 4) AS link_mrr,
  round(avg(CASE WHEN ranks[1] <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS link_hits_3 FROM hit GROUP BY mode"""

_T = o._TOKENS_OF
_COVER = lambda c, seen: f"(CASE WHEN len({c}) = 0 OR len({seen}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({c}, {seen})) / len({c}) END)"
_ANSWERS = f"""WITH {o._CONTEXTS}, a AS (SELECT relative_path, contexts[-1] AS answer, {_T("array_to_string(contexts, chr(10))")} AS everything, {_T("array_to_string(contexts[1:3], chr(10))")} AS top, {_T("contexts[-1]")} AS said, {_T(_quote(ASKED))} AS q FROM ctx),
b AS (SELECT *, list_filter(list_transform(regexp_split_to_array(answer, '[.!?]\\s+|\\n+'), lambda x: {o._STRIP('x')}), lambda x: len(regexp_extract_all(lower(x), {o._TOKEN})) >= 3) AS claims FROM a),
c AS (SELECT *, list_filter(list_transform(CASE WHEN len(claims) = 0 THEN [answer] ELSE claims END, lambda x: {_T('x')}), lambda s: len(s) > 0) AS sets FROM b),
e AS (SELECT *, list_transform(sets, lambda s: 0.75::DOUBLE * {_COVER('s', 'top')} + 0.25::DOUBLE * CASE WHEN {_COVER('s', 'everything')} > 0 THEN {_COVER('s', 'top')} / {_COVER('s', 'everything')} ELSE 0 END) AS scores FROM c)
SELECT relative_path, CASE WHEN len(said) = 0 THEN 0.0::DOUBLE ELSE round(0.2::DOUBLE * (len(list_intersect(q, said)) / len(list_distinct(list_concat(q, said)))) + 0.8::DOUBLE * {_COVER('q', 'said')}, 4) END AS relevance,
  CASE WHEN len(scores) = 0 OR len(everything) = 0 OR len(top) = 0 THEN 0.0::DOUBLE ELSE round(list_sum(scores) / len(scores), 4) END AS grounding FROM e"""
_CUT = lambda end: f"nullif({o._STRIP(f"regexp_extract(raw, '(?s)^(.{{80,}}){end}', 1)")}, '')"
_TEMPLATES = f"""WITH {o._CORPUS}, r AS (SELECT path, substring(content, 1, 220) AS raw FROM chunks WHERE chunk_index = 0),
p AS (SELECT path, regexp_replace(coalesce({_CUT(chr(92) + '. ')}, {_CUT(chr(92) + 'n')}, {_CUT(' ')}, {o._STRIP('raw')}), '[''"]', '', 'g') AS part FROM r)
SELECT path AS relative_path, CASE WHEN part <> '' THEN 'Regarding {ASKED}: ' || part || '.' ELSE 'Regarding {ASKED}: see source ' || path || '.' END AS answer FROM p"""

NAMED = [eval_modes, answer_metrics, template_answers]
ORACLES = {"eval_modes": _EVAL, "answer_metrics": _ANSWERS, "template_answers": _TEMPLATES}


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMED}
