"""DuckDB SQL twins of the registered queries."""

from __future__ import annotations

_CORPUS = r"""
corpus AS (
  SELECT 'documents/' || doc_id AS path, coalesce(text, '') AS text, ['python','docs','example','test'][CAST(doc_id % 4 AS INTEGER) + 1] AS kind FROM documents),
win AS (
  SELECT path, kind, text, length(text) AS n, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE CAST(ceil((length(text) - 1000) / 900.0) AS BIGINT) + 1 END)) AS k
  FROM corpus WHERE length(text) > 0),
chunks AS (
  SELECT *, path || '::chunk:' || chunk_index AS chunk_id, lower(content) AS low FROM (
    SELECT path, kind, n, k, content, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS chunk_index, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines
    FROM (SELECT *, regexp_replace(substring(text, k * 900 + 1, 1000), '^\s+|\s+$', '', 'g') AS content FROM win) WHERE content <> ''))
"""

_TOKEN = "'[a-z][a-z0-9_-]{2,}'"
_QUESTIONS = f"""
questions(query_id, mode, text) AS (VALUES
  ('q1', 'sparse', 'the and that with'), ('q2', 'graph', 'relationship between the and for'), ('q3', 'hybrid_rerank', 'compare that and this'), ('q4', 'sparse', ''),
  ('q5', 'dense', 'explain the meaning of that which was with from this and for are their than then'), ('q6', 'sparse', 'With with THE the Demonstrative FOR')),
raw AS (SELECT query_id, token, min(i) AS i FROM (SELECT query_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM (SELECT query_id, regexp_extract_all(lower(text), {_TOKEN}) AS ts FROM questions)) GROUP BY ALL),
asked AS (SELECT query_id, list(token ORDER BY i)[:12] AS tokens FROM raw GROUP BY query_id)
"""


def _top(source: str, k: int = 5) -> str:
    """Ranked hits (query_id, chunk_id, score, rank) of a subquery."""
    return f"(SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {k})"


_SPARSE_ALL = "(SELECT query_id, chunk_id, CAST(len(list_filter(tokens, lambda t: contains(low, t))) AS DOUBLE) AS score FROM chunks, asked WHERE len(list_filter(tokens, lambda t: contains(low, t))) > 0)"
_SPARSE = f"sparse AS {_top(_SPARSE_ALL)}"


def _cells(source: str, key: str, text: str, dim: int = 256) -> str:
    return f"""(SELECT *, sqrt(sum(value * value) OVER (PARTITION BY {key})) AS norm FROM (
      SELECT {key}, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % {dim} AS idx, sum(CASE WHEN CAST(('0x' || substr(h, 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS value
      FROM (SELECT {key}, sha256(unnest(regexp_extract_all(lower({text}), {_TOKEN}))) AS h FROM {source}) GROUP BY ALL HAVING value <> 0))"""


_DENSE = f"""
cells AS {_cells("chunks", "chunk_id", "content")},
qcells AS {_cells("questions", "query_id", "text")},
dots AS (SELECT q.query_id, c.chunk_id, sum(c.value * q.value) / (max(c.norm) * max(q.norm)) AS cosine FROM cells c JOIN qcells q USING (idx) GROUP BY ALL),
dense AS {_top("(SELECT query_id, chunk_id, 1 / (1 + sqrt(greatest(0.0, 2 - 2 * cosine))) AS score FROM dots)")}
"""
_HYBRID = f"""
hybrid AS {_top("(SELECT query_id, chunk_id, CASE WHEN s.score IS NULL THEN d.score ELSE 0.65::DOUBLE * coalesce(d.score, 0) + 0.35::DOUBLE * s.score END AS score FROM dense d FULL JOIN sparse s USING (query_id, chunk_id))")}
"""

_LEXICON = [
    ("Determiner", "The", "the"), ("Determiner", "Demonstrative", "that|this"), ("Conjunction", "And", "and"), ("Preposition", "For", "for"),
    ("Preposition", "With", r"with|from|with[\s\-_]+this"), ("Copula", "Be", "was|are"),
]
_MENTIONS = "mentions AS (" + " UNION ALL ".join(f"SELECT chunk_id, path, kind, '{a}' AS label, '{b}' AS canonical FROM chunks WHERE regexp_matches(low, '(^|[^a-z0-9])({p})([^a-z0-9]|$)')" for a, b, p in _LEXICON) + ")"
_TAXONOMY = """tax(src_label, src_name, rel, dst_label, dst_name) AS (VALUES
  ('Determiner','The','IS_SUBTYPE_OF','Determiner','Determiner'), ('Determiner','Demonstrative','IS_SUBTYPE_OF','Determiner','Determiner'), ('Conjunction','And','IS_SUBTYPE_OF','Conjunction','Conjunction'),
  ('Preposition','For','IS_SUBTYPE_OF','Preposition','Preposition'), ('Preposition','With','IS_SUBTYPE_OF','Preposition','Preposition'), ('Copula','Be','IS_SUBTYPE_OF','Copula','Copula'),
  ('Determiner','The','ALTERNATIVE_TO','Determiner','Demonstrative'), ('Determiner','Demonstrative','ALTERNATIVE_TO','Determiner','The'),
  ('Preposition','For','ALTERNATIVE_TO','Preposition','With'), ('Preposition','With','ALTERNATIVE_TO','Preposition','For'))"""
_SEED_ALL = """(SELECT query_id, chunk_id, max(score) AS score FROM (
  SELECT query_id, canonical, CAST(len(list_filter(tokens, lambda t: contains(lower(canonical), t))) AS DOUBLE) AS score FROM (SELECT DISTINCT canonical FROM mentions), asked)
  JOIN mentions USING (canonical) WHERE score > 0 GROUP BY ALL)"""
_HOP_ALL = """(SELECT DISTINCT query_id, chunk_id, 1.0::DOUBLE AS score FROM (
  SELECT DISTINCT query_id, t.dst_name AS canonical FROM questions q JOIN (SELECT DISTINCT src_name AS name FROM tax) n ON contains(lower(q.text), lower(n.name)) JOIN tax t ON t.src_name = n.name)
  JOIN mentions USING (canonical))"""
_EXPAND = """
ents AS (SELECT chunk_id, list(canonical ORDER BY canonical)[:20] AS entities FROM (SELECT DISTINCT chunk_id, canonical FROM mentions) GROUP BY chunk_id),
sibs AS (SELECT a.chunk_id, list(b.chunk_id ORDER BY b.chunk_id)[:10] AS near FROM chunks a JOIN chunks b ON a.path = b.path AND a.chunk_id <> b.chunk_id GROUP BY a.chunk_id),
plus AS (SELECT chunk_id, coalesce(entities, []) AS entities, coalesce(near, []) AS near FROM chunks LEFT JOIN ents USING (chunk_id) LEFT JOIN sibs USING (chunk_id))
"""
_EXPANDED = "score + 0.05::DOUBLE * len(entities) + 0.02::DOUBLE * len(near)"
_BOOST = "+ 0.03::DOUBLE * len(entities) + 0.015::DOUBLE * (len(entities) + len(near))"

_SOURCE_LABEL = "CASE kind WHEN 'docs' THEN 'DocPage' WHEN 'example' THEN 'ExampleNotebook' WHEN 'test' THEN 'TestCase' ELSE 'PythonModule' END"
_SOURCE_NAME = "CASE WHEN kind = 'python' THEN replace(path, '/', '.') ELSE path END"
_CONCEPT_REL = "CASE kind WHEN 'docs' THEN 'DESCRIBES' WHEN 'example' THEN 'DEMONSTRATES' WHEN 'test' THEN 'VALIDATES' ELSE 'IMPLEMENTS' END"
_KEYWORDS = [
    "assert", "print", "len", "range", "list", "dict", "set", "tuple", "int", "float", "str", "bool", "enumerate", "zip", "False", "None", "True",
    "and", "as", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global", "if",
    "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
]
_SYMBOLS = rf"""
code AS (SELECT * FROM chunks WHERE kind IN ('python', 'test')),
classes AS (SELECT DISTINCT chunk_id, path, kind, 'PythonClass' AS label, unnest(regexp_extract_all(content, '(?m)^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\b', 1)) AS name FROM code),
funcs AS (SELECT DISTINCT chunk_id, path, kind, 'PythonFunction' AS label, unnest(regexp_extract_all(content, '(?m)^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)) AS name FROM code),
targets AS (SELECT DISTINCT path, name FROM (SELECT path, unnest(regexp_extract_all(content, '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)) AS name FROM chunks WHERE kind = 'test')
  WHERE NOT starts_with(name, 'test_') AND name NOT IN ({", ".join(f"'{k}'" for k in _KEYWORDS)})),
pairs AS (SELECT a.chunk_id, a.label AS src_label, a.canonical AS src_name, b.label AS dst_label, b.canonical AS dst_name FROM mentions a JOIN mentions b ON a.chunk_id = b.chunk_id AND (a.label, a.canonical) < (b.label, b.canonical)),
edges AS (
  SELECT 'Chunk' AS src_label, chunk_id AS src_name, 'MENTIONS' AS rel, label AS dst_label, canonical AS dst_name FROM mentions
  UNION SELECT 'Chunk', chunk_id, 'MENTIONS', 'Concept', lower(canonical) FROM mentions
  UNION SELECT {_SOURCE_LABEL}, {_SOURCE_NAME}, {_CONCEPT_REL}, label, canonical FROM mentions
  UNION SELECT {_SOURCE_LABEL}, {_SOURCE_NAME}, 'DECLARES', label, name FROM (SELECT * FROM classes UNION ALL SELECT * FROM funcs)
  UNION SELECT 'Chunk', chunk_id, 'MENTIONS', label, name FROM (SELECT * FROM classes UNION ALL SELECT * FROM funcs)
  UNION SELECT 'TestCase', path, 'VALIDATES', 'PythonFunction', name FROM targets),
alledges AS (SELECT * FROM edges UNION SELECT {_SOURCE_LABEL}, {_SOURCE_NAME}, 'HAS_CHUNK', 'Chunk', chunk_id FROM chunks UNION SELECT src_label, src_name, 'RELATED_TO', dst_label, dst_name FROM pairs),
nodes AS (
  SELECT DISTINCT {_SOURCE_LABEL} AS label, {_SOURCE_NAME} AS name, 3 AS n_props FROM chunks
  UNION SELECT 'Chunk', chunk_id, 7 FROM chunks UNION SELECT label, name, 0 FROM classes UNION SELECT label, name, 0 FROM funcs UNION SELECT 'PythonFunction', name, 0 FROM targets
  UNION SELECT label, canonical, 0 FROM mentions UNION SELECT 'Concept', lower(canonical), 1 FROM mentions)
"""

_STAR = """
nodes AS (
  SELECT 'Customer' AS label, CASE WHEN c_custkey % 101 = 0 THEN '' ELSE c_name END AS name FROM customer
  UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT 'Part', 'part-' || p_partkey FROM part
  UNION ALL SELECT 'Supplier', s_name FROM supplier UNION ALL SELECT 'Nation', n_name FROM nation UNION ALL SELECT 'Region', r_name FROM region),
edges AS (
  SELECT 'Customer' AS src_label, c_name AS src_name, 'PRECEDES' AS rel, 'Order' AS dst_label, CAST(o_orderkey AS VARCHAR) AS dst_name FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'Order', CAST(l_orderkey AS VARCHAR), 'REQUIRES', 'Part', CASE WHEN l_partkey % 97 = 0 THEN 'missing-' ELSE 'part-' END || l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
  UNION ALL SELECT 'Part', 'part-' || l_partkey, 'SUPPLIED_BY', 'Supplier', s_name FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT 'Customer', c_name, 'RELATED_TO', 'Nation', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Supplier', s_name, 'RELATED_TO', 'Nation', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'Nation', n_name, 'IS_SUBTYPE_OF', 'Region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
"""
_NS = "urn:graph:v1#"
_TRIPLES = f"""
triples AS (
  SELECT '{_NS}node/' || replace(name, ' ', '_') AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, name AS o, 'literal' AS k FROM nodes WHERE name <> ''
  UNION SELECT '{_NS}node/' || replace(name, ' ', '_'), 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{_NS}' || label, 'iri' FROM nodes WHERE name <> ''
  UNION SELECT '{_NS}node/' || replace(src_name, ' ', '_'), '{_NS}' || rel, '{_NS}node/' || replace(dst_name, ' ', '_'), 'iri' FROM edges),
labels AS (SELECT s, o AS name FROM triples WHERE p = 'http://www.w3.org/2000/01/rdf-schema#label')
"""
_RELATIONS = "'HAS_CHUNK','MENTIONS','DESCRIBES','DEMONSTRATES','VALIDATES','IMPLEMENTS','DECLARES','HAS_PARAMETER','USES','SUPPORTS_RISK_MEASURE','SUPPORTS_CONSTRAINT','USES_ESTIMATOR','PRODUCES_REPORT','RELATED_TO','IS_SUBTYPE_OF','ALTERNATIVE_TO','REQUIRES','PARAMETERIZED_BY','BENCHMARKED_ON','CALIBRATED_ON','PRECEDES','HAS_CONSTRAINT','VALIDATED_AGAINST'"
_CHECKS = f"""
names AS (SELECT DISTINCT name FROM nodes WHERE name <> ''),
checks AS (
  SELECT 'node_has_name' AS "check", count(*) FILTER (name <> '') AS n_pass, count(*) FILTER (name = '') AS n_fail FROM nodes
  UNION ALL SELECT 'allowed_relation_type', count(*) FILTER (rel IN ({_RELATIONS})), count(*) FILTER (rel NOT IN ({_RELATIONS})) FROM edges
  UNION ALL SELECT 'edge_endpoints_exist', count(*) FILTER (ok), count(*) FILTER (NOT ok) FROM (SELECT src_name IN (SELECT name FROM names) AND dst_name IN (SELECT name FROM names) AS ok FROM edges))
"""
_STATS = """
SELECT 'total' AS kind, 'nodes' AS name, count(*) AS n FROM {nodes} UNION ALL SELECT 'total', 'edges', count(*) FROM {edges}
UNION ALL SELECT 'label', label, count(*) FROM {nodes} GROUP BY label UNION ALL SELECT 'relation', rel, count(*) FROM {edges} GROUP BY rel"""

_ENTITIES = r"""
ents AS (
  SELECT p_partkey AS entity_id, p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' !' WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS name, lower(p_name) || '/' || p_type AS gold FROM part),
keyed AS (SELECT *, replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' ', '_') AS cluster FROM ents)
"""
_NAMES = """
sets AS (SELECT name, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS ws FROM (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS name FROM part)),
alike AS (SELECT a.name AS a, b.name AS b FROM sets a JOIN sets b ON a.name < b.name AND len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) >= 0.7)
"""

_CONTEXTS = f"{_CORPUS}, ctx AS (SELECT path AS relative_path, list(content ORDER BY chunk_index) AS contexts FROM chunks GROUP BY path)"
_TERMS = "['the', 'with this', 'zebra', 'und']"
_HAS_TERM = f"len(list_filter({_TERMS}, lambda t: contains(lower(c), t))) > 0"
_TOKENS_OF = lambda c: f"list_distinct(regexp_extract_all(lower({c}), {_TOKEN}))"

_DAILY = """
daily AS (
  SELECT event_type, CAST(ts AS DATE) AS day, round(count(*) FILTER (user_id % 3 > 0) / count(*), 6) AS answer_faithfulness, round(count(*) FILTER (user_id % 2 = 0) / count(*), 6) AS grounding,
    count(*) * 100.0::DOUBLE AS avg_latency_ms, round(count(*) * 0.0005::DOUBLE, 6) AS estimated_cost_usd FROM events GROUP BY ALL)
"""
_DAY_METRICS = ["answer_faithfulness", "grounding", "avg_latency_ms", "estimated_cost_usd"]
_DELTA = lambda m: f"coalesce(round({m} - lag({m}) OVER (PARTITION BY event_type ORDER BY day), 6), 0)"

_RULES = [
    ("graph", 1.0, "rule_graph_intent", [r"\b(relationship|related|connected|dependenc|neighbou?r|graph|mention)\w*\b", r"\bbetween\b.*\band\b", r"\b(which|what uses|how does .+ relate|dependencies of|connected to)\b"]),
    ("sparse", 0.95, "rule_sparse_intent", [r"\b(line|lines|path|file|section|exact|regex|keyword|parameter|signature)\b", r"\b(test_|def\s+|class\s+)\b", r"rp\.", r"rf\.", r"\b(optimize|to_pandas|plot_|show_)\b", r"\b(docstring|__init__|args:|returns:|attributes:)\b", r"\b[A-Za-z_][A-Za-z0-9_]*\s*\([^)]*\)"]),
    ("hybrid_rerank", 0.9, "rule_hybrid_intent", [r"\b(compare|trade[- ]?off|versus|vs\.?|multi[- ]?hop|end[- ]?to[- ]?end)\b", r"\b(difference between|pros and cons|better than|worse than)\b"]),
    ("dense", 0.85, "rule_dense_intent", [r"\b(define|definition|what is|meaning|overview|explain)\b"]),
]
_RULE_CASE = " ".join(f"WHEN regexp_matches(low, '{'|'.join(f'(?:{p})' for p in ps)}') THEN {{{'mode'!r}: '{m}', 'score': {s}::DOUBLE, 'reason': '{r}'}}" for m, s, r, ps in _RULES)
# The modes' prototype texts, in order.
_PROTOTYPE_TEXTS = {
    "dense": ["explain concept definition and overview", "summarize method and rationale", "what does this term mean"],
    "sparse": ["exact function name parameter signature", "file path section line range", "specific keyword search in code", "api parameter default value signature", "python function class method module"],
    "graph": ["relationship between entities dependencies", "which components mention concept", "connected nodes and neighbourhood"],
    "hybrid_rerank": ["compare methods and evidence from docs and code", "multi-hop question with entities and details", "retrieve broad context and rerank"],
}
_PROTOTYPES = ", ".join(f"('{m}', {i}, '{m}{j}', '{t}')" for i, (m, ts) in enumerate(_PROTOTYPE_TEXTS.items()) for j, t in enumerate(ts))
_LABELS = [
    "Chunk", "DocPage", "ExampleNotebook", "TestCase", "PythonModule", "PythonClass", "PythonFunction", "Parameter", "PortfolioMethod",
    "RiskMeasure", "ConstraintType", "Estimator", "ReportType", "PlotType", "Solver", "Concept", "AssetClass", "FactorModel", "MarketRegime",
    "BenchmarkIndex", "BacktestScenario", "OptimizationProblem",
]
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"

ORACLES = {
    "corpus_summary": f"WITH {_CORPUS} SELECT kind AS source_type, count(DISTINCT path) AS n_files, count(*) AS n_chunks FROM chunks GROUP BY kind",
    "chunk_window": f"WITH {_CORPUS} SELECT chunk_id, chunk_index, length(content) AS n_chars, md5(content) AS digest FROM chunks",
    "chunk_lines": f"""WITH {_CORPUS}, a AS (SELECT *, 1 + CAST(floor(n_lines * (k * 900) / n) AS INTEGER) AS ls, 1 + CAST(floor(n_lines * least(n, k * 900 + 1000) / n) AS INTEGER) AS le FROM chunks)
      SELECT chunk_id, ls AS line_start, least(n_lines, greatest(ls, le)) AS line_end, 'fallback' AS section FROM a""",
    "token_freq": f"WITH {_CORPUS} SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), {_TOKEN})) AS token FROM corpus) GROUP BY token",
    "hash_embed_cells": f"WITH {_CORPUS} SELECT path AS relative_path, idx, value, round(norm, 9) AS norm FROM {_cells('corpus', 'path', 'text')}",
    "sparse_topk": f"WITH {_CORPUS}, {_QUESTIONS}, {_SPARSE} SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM sparse",
    "dense_topk": f"WITH {_CORPUS}, {_QUESTIONS}, {_DENSE} SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM dense",
    "vector_knn": """WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2))) AS distance FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
      SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank FROM d) WHERE rank <= 5""",
    "lexicon_mentions": f"WITH {_CORPUS}, {_MENTIONS} SELECT chunk_id, label, canonical FROM mentions",
    "mention_edges": f"WITH {_CORPUS}, {_MENTIONS}, {_SYMBOLS} SELECT * FROM edges",
    "related_to_pairs": f"WITH {_CORPUS}, {_MENTIONS}, {_SYMBOLS} SELECT src_label, src_name, dst_label, dst_name, count(*) AS n_chunks FROM pairs GROUP BY ALL",
    "graph_nodes": f"WITH {_CORPUS}, {_MENTIONS}, {_SYMBOLS} SELECT label, name, n_props FROM nodes",
    "graph_stats": f"WITH {_CORPUS}, {_MENTIONS}, {_SYMBOLS} {_STATS.format(nodes='nodes', edges='alledges')}",
    "taxonomy_edges": f"WITH {_CORPUS}, {_MENTIONS}, {_TAXONOMY} SELECT * FROM tax WHERE src_name IN (SELECT canonical FROM mentions)",
    "graph_seed_topk": f"WITH {_CORPUS}, {_QUESTIONS}, {_MENTIONS} SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM {_top(_SEED_ALL)}",
    "graph_hop_topk": f"WITH {_CORPUS}, {_QUESTIONS}, {_MENTIONS}, {_TAXONOMY} SELECT query_id, chunk_id, score, rank FROM {_top(_HOP_ALL)}",
    "hybrid_merge": f"WITH {_CORPUS}, {_QUESTIONS}, {_SPARSE}, {_DENSE}, {_HYBRID} SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM hybrid",
    "graph_expand": f"WITH {_CORPUS}, {_QUESTIONS}, {_MENTIONS}, {_SPARSE}, {_EXPAND} SELECT query_id, chunk_id, round({_EXPANDED}, 9) AS score, array_to_string(entities, '|') AS entities, array_to_string(near, '|') AS neighbour_chunks FROM sparse JOIN plus USING (chunk_id)",
    "hybrid_rerank": f"WITH {_CORPUS}, {_QUESTIONS}, {_MENTIONS}, {_SPARSE}, {_DENSE}, {_HYBRID}, {_EXPAND} SELECT query_id, chunk_id, round(round({_EXPANDED} {_BOOST}, 6), 5) AS score FROM hybrid JOIN plus USING (chunk_id)",
    "retrieve_modes": f"""WITH {_CORPUS}, {_QUESTIONS}, {_MENTIONS}, {_TAXONOMY}, {_SPARSE}, {_DENSE}, {_HYBRID}, {_EXPAND},
      seed AS {_top(_SEED_ALL)}, hop AS {_top(_HOP_ALL)},
      graph AS {_top("(SELECT query_id, chunk_id, CASE WHEN h.score IS NULL THEN s.score ELSE 0.65::DOUBLE * coalesce(s.score, 0) + 0.35::DOUBLE * h.score END AS score FROM seed s FULL JOIN hop h USING (query_id, chunk_id))")},
      hits AS (SELECT 'sparse' AS mode, * FROM sparse UNION ALL SELECT 'dense', * FROM dense UNION ALL SELECT 'graph', * FROM graph UNION ALL SELECT 'hybrid_rerank', * FROM hybrid)
      SELECT query_id, chunk_id, round(CASE WHEN mode = 'hybrid_rerank' THEN round({_EXPANDED} {_BOOST}, 6) ELSE {_EXPANDED} END, 5) AS score, len(entities)::INTEGER AS n_entities, (len(entities) + len(near))::INTEGER AS n_neighbours
      FROM hits JOIN questions USING (query_id, mode) JOIN plus USING (chunk_id)""",
    "star_stats": f"WITH {_STAR} {_STATS.format(nodes='nodes', edges='edges')}",
    "query_subgraph": f"""WITH {_STAR}, seeds AS (SELECT label, name FROM nodes WHERE name <> '' AND (contains(lower(name), 'asia') OR contains(lower(name), 'europe') OR contains(lower(name), 'supplier#00000000')) ORDER BY label, name LIMIT 60),
      both_ways AS (SELECT src_label AS label, src_name AS name, dst_label AS l, dst_name AS n FROM edges UNION ALL SELECT dst_label, dst_name, src_label, src_name FROM edges),
      near AS (SELECT DISTINCT b.l AS label, b.n AS name FROM both_ways b JOIN seeds USING (label, name) JOIN (SELECT DISTINCT label AS l, name AS n FROM nodes WHERE name <> '') USING (l, n)),
      kept AS (SELECT label, name FROM (SELECT label, name, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM seeds UNION ALL SELECT *, 1 FROM near) GROUP BY ALL) ORDER BY hop, label, name LIMIT 300)
      SELECT e.* FROM edges e SEMI JOIN kept a ON e.src_label = a.label AND e.src_name = a.name SEMI JOIN kept b ON e.dst_label = b.label AND e.dst_name = b.name""",
    "section_chunks": f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, 'none') AS section, {_STRIP("regexp_replace('# ' || coalesce(role, 'none') || chr(10) || coalesce(text, ''), chr(13) || chr(10) || '?', chr(10), 'g')")} AS text FROM conversations),
      pieces AS (SELECT conv_id, turn, section, {_STRIP("substring(text, k * 900 + 1, 1000)")} AS content FROM (SELECT *, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE CAST(ceil((length(text) - 1000) / 900.0) AS BIGINT) + 1 END)) AS k FROM turns))
      SELECT section, count(*) AS n_chunks, count(DISTINCT conv_id || '/' || turn) AS n_turns, sum(length(content))::BIGINT AS n_chars FROM pieces WHERE content <> '' GROUP BY section""",
    "agent_plan": f"""WITH said AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
      toks AS (SELECT conv_id, turn, token, min(i) AS i FROM (SELECT conv_id, turn, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), {_TOKEN}) AS ts FROM said)) GROUP BY ALL),
      focus AS (SELECT conv_id, turn, 'Corpus details on ' || array_to_string(list(token ORDER BY i)[:4], ' ') AS about FROM toks WHERE token NOT IN ('what', 'how', 'why', 'when', 'where', 'which', 'does', 'portfolio', 'about', 'with', 'into') GROUP BY ALL),
      given AS (SELECT list_filter([{_STRIP("text")}, about, CASE WHEN regexp_matches(lower(text), 'how|why') THEN {_STRIP("'methodology evidence for: ' || text")} END], lambda x: x IS NOT NULL AND x <> '') AS parts FROM said LEFT JOIN focus USING (conv_id, turn))
      SELECT (part - 1)::INTEGER AS part, count(*) AS n, sum(length(t))::BIGINT AS n_chars FROM (SELECT unnest(parts) AS t, generate_subscripts(parts, 1) AS part FROM given) GROUP BY part""",
    "graph_view": f"""WITH {_STAR}, deg AS (SELECT label, name, count(*) AS degree FROM (SELECT src_label AS label, src_name AS name FROM edges UNION ALL SELECT dst_label, dst_name FROM edges) GROUP BY ALL)
      SELECT label, name, degree FROM nodes JOIN deg USING (label, name) WHERE name <> '' AND label <> 'Order' ORDER BY degree DESC, label, name LIMIT 35""",
    "edge_integrity": f"""WITH {_STAR}, keys AS (SELECT DISTINCT label, name FROM nodes), c AS (SELECT count(*) AS n_edges, count(*) FILTER (NOT ((src_label, src_name) IN (SELECT (label, name) FROM keys) AND (dst_label, dst_name) IN (SELECT (label, name) FROM keys))) AS n_skipped FROM edges)
      SELECT n_edges, n_skipped, greatest(1, CAST(floor(n_edges * 0.05) AS BIGINT)) AS "limit", n_skipped <= greatest(1, floor(n_edges * 0.05)) AS ok FROM c""",
    "shacl_checks": f'WITH {_STAR}, {_CHECKS} SELECT "check", n_pass, n_fail FROM checks',
    "shacl_report": f"WITH {_STAR}, {_CHECKS} SELECT CASE WHEN sum(n_fail) = 0 THEN 'pass' ELSE 'fail' END AS status, sum(n_pass)::BIGINT AS pass_count, sum(n_fail)::BIGINT AS fail_count, round(sum(n_pass) / greatest(1, sum(n_pass) + sum(n_fail)), 4) AS pass_rate FROM checks",
    "triples": f"WITH {_STAR}, {_TRIPLES} SELECT p, count(*) AS n, count(DISTINCT s) AS n_subjects, count(DISTINCT o) AS n_objects FROM triples GROUP BY p",
    "bgp_subclass": f"WITH {_STAR}, {_TRIPLES} SELECT a.name AS child, b.name AS parent FROM triples t JOIN labels a ON a.s = t.s JOIN labels b ON b.s = t.o WHERE t.p = '{_NS}IS_SUBTYPE_OF'",
    "bgp_related": f"WITH {_STAR}, {_TRIPLES} SELECT b.name AS target, count(*) AS n FROM triples t JOIN labels a ON a.s = t.s JOIN labels b ON b.s = t.o WHERE t.p = '{_NS}RELATED_TO' GROUP BY b.name",
    "relation_axioms": f"WITH {_STAR} SELECT rel AS relation, 'rf:' || rel AS predicate, 'owl:ObjectProperty' AS owl_type, 'owl:Thing' AS domain, 'owl:Thing' AS range, count(*) AS n FROM edges GROUP BY rel",
    "er_groups": f"""WITH {_ENTITIES}, g AS (SELECT cluster, list(DISTINCT name ORDER BY name) AS names, min((length(name), name)) AS best, count(DISTINCT entity_id) AS n FROM keyed GROUP BY cluster)
      SELECT cluster, best[2] AS canonical_name, array_to_string(list_filter(names, lambda x: x <> best[2]), '|') AS aliases, n::INTEGER AS n_ids FROM g""",
    "er_pairs": f"WITH {_ENTITIES} SELECT a.entity_id AS id_a, b.entity_id AS id_b FROM keyed a JOIN keyed b ON a.cluster = b.cluster AND a.p_brand = b.p_brand AND a.entity_id < b.entity_id",
    "er_metrics": f"""WITH {_ENTITIES}, n AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM keyed GROUP BY cluster))::BIGINT AS predicted, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM keyed GROUP BY gold))::BIGINT AS actual,
        (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM keyed GROUP BY cluster, gold))::BIGINT AS "both"),
      r AS (SELECT *, "both" / greatest(1, predicted) AS p, "both" / greatest(1, actual) AS q FROM n)
      SELECT predicted, actual, "both", round(p, 4) AS precision, round(q, 4) AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 4) AS f1 FROM r""",
    "er_similar": f"WITH {_NAMES} SELECT a, b FROM alike",
    "er_greedy": f"""WITH RECURSIVE {_NAMES.replace("sets AS (", "sets AS MATERIALIZED (").replace("alike AS (", "alike AS MATERIALIZED (")}, ids AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY name) AS i FROM (SELECT a AS name FROM alike UNION SELECT b FROM alike)),
      low AS MATERIALIZED (SELECT y.i, list(x.i ORDER BY x.i) AS prior FROM alike JOIN ids x ON x.name = a JOIN ids y ON y.name = b GROUP BY y.i),
      step(i, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT s.i + 1, CASE WHEN l.prior IS NOT NULL AND list_has_any(s.leaders, l.prior) THEN s.leaders ELSE list_append(s.leaders, s.i + 1) END FROM step s LEFT JOIN low l ON l.i = s.i + 1 WHERE s.i < (SELECT count(*) FROM ids)),
      done AS (SELECT leaders FROM step ORDER BY i DESC LIMIT 1),
      led AS (SELECT ids.name, CASE WHEN list_contains(leaders, ids.i) THEN ids.i ELSE list_min(list_intersect(leaders, prior)) END AS lead FROM ids LEFT JOIN low USING (i), done)
      SELECT leader, count(*) AS n FROM (SELECT x.name AS leader FROM led JOIN ids x ON x.i = lead UNION ALL SELECT name FROM sets WHERE name NOT IN (SELECT name FROM ids)) GROUP BY leader""",
    "context_metrics": f"""WITH {_CONTEXTS}, m AS (SELECT relative_path, contexts, list_filter(range(1, len(contexts) + 1), lambda i: len(list_filter({_TERMS}, lambda t: contains(lower(contexts[i]), t))) > 0)[1] AS hit FROM ctx)
      SELECT relative_path, round(len(list_filter({_TERMS}, lambda t: contains(lower(array_to_string(contexts, chr(10))), t))) / 4, 6) AS recall,
        round(len(list_filter(contexts, lambda c: {_HAS_TERM})) / len(contexts), 6) AS precision, coalesce(hit, 0)::INTEGER AS first_hit, CASE WHEN hit <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hits_3,
        CASE WHEN hit <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hits_10, CASE WHEN hit IS NULL THEN 0.0::DOUBLE ELSE round(1.0::DOUBLE / hit, 4) END AS mrr FROM m""",
    "faithfulness_claims": f"""WITH {_CORPUS}, pairs AS (SELECT path AS relative_path, (chunk_index + 1)::INTEGER AS chunk, content, lag(content) OVER (PARTITION BY path ORDER BY chunk_index) AS prior FROM chunks),
      a AS (SELECT relative_path, chunk, {_TOKENS_OF('content')} AS said, {_TOKENS_OF('prior')} AS seen,
        list_filter(list_transform(regexp_split_to_array(content, '[.!?]\\s+|\\n+'), lambda x: {_STRIP('x')}), lambda x: len(regexp_extract_all(lower(x), {_TOKEN})) >= 3) AS claims FROM pairs WHERE prior IS NOT NULL)
      SELECT relative_path, chunk, round(CASE WHEN len(claims) = 0 THEN 0.0 ELSE len(list_filter(claims, lambda c: len(list_intersect({_TOKENS_OF('c')}, seen)) / len({_TOKENS_OF('c')}) >= 0.25)) / len(claims) END, 6) AS faithfulness,
        round(CASE WHEN len(said) = 0 OR len(seen) = 0 THEN 0.0 ELSE len(list_intersect(said, seen)) / len(said) END, 6) AS overlap FROM a""",
    "precision_weighted": f"""WITH {_CONTEXTS}, s AS (SELECT relative_path, list_transform(contexts, lambda c: CASE WHEN len({_TOKENS_OF('c')}) = 0 THEN 0.0::DOUBLE ELSE 0.65::DOUBLE * (len(list_intersect(['the', 'and'], {_TOKENS_OF('c')})) / 2)
        + 0.35::DOUBLE * (len(list_intersect(['the', 'and', 'that', 'with'], {_TOKENS_OF('c')})) / len(list_distinct(list_concat(['the', 'and', 'that', 'with'], {_TOKENS_OF('c')})))) END) AS scores FROM ctx)
      SELECT relative_path, round(list_sum(scores) / len(scores), 4) AS precision FROM s""",
    "contrastive_deltas": f"""WITH {_DAILY}, a AS (SELECT {', '.join(f'avg({m}) AS {m}' for m in _DAY_METRICS)} FROM daily WHERE day = (SELECT min(day) FROM daily)), b AS (SELECT {', '.join(f'avg({m}) AS {m}' for m in _DAY_METRICS)} FROM daily WHERE day = (SELECT max(day) FROM daily)),
      d AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, round(b.{m} - a.{m}, 6) AS delta, {'TRUE' if i > 1 else 'FALSE'} AS low FROM a, b" for i, m in enumerate(_DAY_METRICS))})
      SELECT metric, round(delta, 4) AS delta, CASE WHEN abs(delta) < 0.0001 THEN 'unchanged' WHEN (delta < 0) = low THEN 'improved' ELSE 'regressed' END AS verdict FROM d""",
    "trend_lag_drift": f"""WITH {_DAILY}, t AS (SELECT event_type, day, {', '.join(f'{_DELTA(m)} AS d_{i}' for i, m in enumerate(_DAY_METRICS))}, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r FROM daily)
      SELECT event_type, strftime(day, '%Y-%m-%d') AS day, {', '.join(f'd_{i} AS delta_{m}' for i, m in enumerate(_DAY_METRICS))}, d_0 <= -0.15 OR d_1 <= -0.15 OR d_2 >= 500 OR d_3 >= 0.005 AS drift_flagged FROM t WHERE r <= 30""",
    "regression_gate": f"""WITH {_DAILY}, f AS (SELECT *, list_filter([CASE WHEN answer_faithfulness < 0.6 THEN 'answer_faithfulness' END, CASE WHEN grounding < 0.45 THEN 'grounding' END, CASE WHEN avg_latency_ms > 2000 THEN 'avg_latency_ms' END, CASE WHEN estimated_cost_usd > 0.012 THEN 'estimated_cost_usd' END], lambda x: x IS NOT NULL) AS fs FROM daily)
      SELECT event_type, strftime(day, '%Y-%m-%d') AS day, array_to_string(fs, '|') AS failures, len(fs) = 0 AS passed FROM f""",
    "slo_report": f"""WITH {_DAILY}, s AS (SELECT *, epoch(TIMESTAMP '2024-03-01' - CAST(day AS TIMESTAMP)) / 3600.0 AS age FROM daily)
      SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(age, 1) AS freshness_hours, round(1 - grounding, 6) <= 0.5 AS drift_met, age <= 1080 AS freshness_met, grounding >= 0.4 AS grounding_met,
        CASE WHEN round(1 - grounding, 6) <= 0.5 AND age <= 1080 AND grounding >= 0.4 AND answer_faithfulness >= 0.4 AND avg_latency_ms <= 3000 AND estimated_cost_usd <= 0.02 THEN 'healthy' ELSE 'degraded' END AS status FROM s""",
    "route_rules": f"""SELECT conv_id, turn, r.mode AS mode, r.score AS score, r.reason AS reason FROM (SELECT conv_id, turn, CASE {_RULE_CASE} ELSE {{'mode': 'sparse', 'score': 0.55::DOUBLE, 'reason': 'rule_default'}} END AS r FROM (SELECT *, lower(coalesce(text, '')) AS low FROM conversations))""",
    "route_modes": f"""WITH turns AS (SELECT conv_id || '/' || turn AS query_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM conversations),
      protos(mode, ord, pid, text) AS (VALUES {_PROTOTYPES}), pc AS {_cells("protos", "pid", "text", 128)}, tc AS {_cells("turns", "query_id", "text", 128)},
      mean AS (SELECT mode, idx, sum(value / norm) / max(nt) AS p FROM pc JOIN protos USING (pid) JOIN (SELECT mode, count(*) AS nt FROM protos GROUP BY mode) USING (mode) GROUP BY mode, idx),
      dots AS (SELECT query_id, mode, sum(value * p) / (max(norm) * max(pnorm)) AS c FROM tc JOIN (SELECT *, sqrt(sum(p * p) OVER (PARTITION BY mode)) AS pnorm FROM mean) USING (idx) GROUP BY ALL),
      ruled AS (SELECT query_id, text, CASE {_RULE_CASE} ELSE {{'mode': 'sparse', 'score': 0.55::DOUBLE, 'reason': 'rule_default'}} END AS r FROM turns),
      options AS (SELECT query_id, text, m.mode, ord, 0.65::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(c, 0.0::DOUBLE))) + 0.35::DOUBLE * CASE WHEN r.mode = m.mode THEN r.score ELSE 0.0::DOUBLE END AS score FROM ruled CROSS JOIN (SELECT DISTINCT mode, ord FROM protos) m LEFT JOIN dots USING (query_id, mode)),
      best AS (SELECT * FROM options QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) = 1),
      chosen AS (SELECT CASE WHEN {_STRIP("text")} = '' OR score < 0.2 THEN 'hybrid_rerank' ELSE mode END AS mode, CASE WHEN {_STRIP("text")} = '' THEN 0.0::DOUBLE ELSE score END AS confidence FROM best)
      SELECT mode, count(*) AS n, round(avg(confidence), 6) AS confidence FROM chosen GROUP BY mode""",
    "guard_decisions": f"""WITH made AS (SELECT conv_id, turn, {_STRIP("lower(CASE WHEN turn % 3 = 0 THEN 'Count chunk for ' || role WHEN turn % 3 = 1 THEN 'who mentions ' || role || '?' ELSE coalesce(text, '') END)")} AS q FROM conversations),
      p AS (SELECT *, list_filter([{', '.join(f"'{x}'" for x in _LABELS)}], lambda l: lower(l) = regexp_extract(q, 'count\\s+(\\w+)', 1))[1] AS lab, {_STRIP("regexp_extract(q, 'mentions?\\s+([a-zA-Z0-9_\\-\\s]+)', 1)")} AS ent,
        {' OR '.join(f"contains(q, '{w}')" for w in ('create', 'merge', 'delete', 'set ', 'remove', 'drop', 'call dbms', 'load csv'))} AS bad FROM made),
      c AS (SELECT *, CASE WHEN q = '' THEN 0 WHEN bad THEN 1 WHEN lab IS NOT NULL THEN 2 WHEN ent <> '' THEN 3 ELSE 4 END AS k FROM p)
      SELECT conv_id, turn, ['blocked', 'blocked', 'safe', 'safe', 'escalate'][k + 1] AS status, ['empty_question', 'unsafe_intent_detected', 'allowlisted_count_template', 'allowlisted_mentions_template', 'ambiguous_query'][k + 1] AS reason,
        CASE WHEN k = 2 THEN lab END AS label, CASE WHEN k = 3 THEN ent END AS entity FROM c""",
    "question_terms": f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), {_TOKEN}) AS ts FROM conversations),
      f AS (SELECT conv_id, turn, token, min(i) AS i FROM (SELECT conv_id, turn, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM t) GROUP BY ALL),
      g AS (SELECT conv_id, turn, array_to_string(list(token ORDER BY i)[:12], ' ') AS tokens FROM f GROUP BY ALL)
      SELECT conv_id, turn, coalesce(tokens, '') AS tokens FROM t LEFT JOIN g USING (conv_id, turn)""",
}
