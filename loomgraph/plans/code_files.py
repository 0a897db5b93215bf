"""Queries over source files of every kind, made by rule from the documents table, and their SQL.

A document's id and length choose its file: a Python module, a page with headings, a notebook or a
test module. The twins state what each file must give, so they share no step with the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import lexicon as lx
from loomgraph.operators import chunking, extraction, graph, semantic
from loomgraph.operators.resolution import cut
from loomgraph.operators.tables import written
from loomgraph.plans import oracles
from loomgraph.plans.registry import Query, corpus, table
from loomgraph.sources import files as fs

#: Words put before a document's text, by doc_id % 6, so that relations to concepts occur.
CONCEPT_WORDS = ["cvar", "ewma", "oas and var", "ledoit-wolf", "", "mosek"]
CONCEPT_LABELS = ["RiskMeasure", "Estimator", "PortfolioMethod"]
CONCEPT_RELATIONS = ["SUPPORTS_RISK_MEASURE", "USES_ESTIMATOR", "ALTERNATIVE_TO"]


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relative_path, text and file columns, one file per document."""
    i, lit = F.col("doc_id").cast("string"), F.lit
    filler = F.repeat(lit("x = 1\n"), (F.coalesce("n_chars", lit(0)) % 5).cast("int"))
    short = (F.col("doc_id") % 7).cast("string")
    module = F.concat(lit('"""Doc."""\nimport os\n\nclass C'), i, lit("(Base):\n    def run(self, first, second=2, *rest):\n        return first\n\n"), filler, lit("def f"), short, lit("(a):\n    return os\n"))
    page = F.concat(lit("####\nRisk\n####\nIntro.\n\nPart Two\n--------\nBody "), i, lit(".\n"))
    book = F.concat(lit('{"cells": [{"cell_type": "markdown", "source": ["# T\\n", "part '), i, lit('"]}, {"cell_type": "code", "source": "y = '), i, lit('"}, {"cell_type": "code", "source": []}]}'))
    test = F.concat(lit("def helper():\n    pass\n\ndef test_b():\n    assert run("), i, lit(")\n\ndef test_a():\n    make_"), short, lit("(2)\n"))
    kind = F.col("doc_id") % 4
    path = F.when(kind == 0, F.concat(lit("pkg/m"), i, lit(".py"))).when(kind == 1, F.concat(lit("docs/source/p"), i, lit(".rst"))).when(kind == 2, F.concat(lit("examples/e"), i, lit(".ipynb"))).otherwise(F.concat(lit("tests/test_"), i, lit(".py")))
    rows = table(spark, sf_dir, "documents").select(path.alias("relative_path"), F.when(kind == 0, module).when(kind == 1, page).when(kind == 2, book).otherwise(test).alias("text"))
    return rows.withColumns({"extension": F.regexp_extract("relative_path", "(\\.[^.]+)$", 1), "source_type": fs.source_type(F.col("relative_path")), "module_name": fs.module_name(F.col("relative_path"))})


def file_chunks(spark, sf_dir):
    """Chunks of every kind of file, with lines and content hash."""
    rows = chunking.chunk_files(source_files(spark, sf_dir))
    return rows.select("chunk_id", "source_type", "chunk_kind", "section", "line_start", "line_end", "content_hash")


def symbol_edges(spark, sf_dir):
    """Declared classes and functions, their parameters, and what tests call."""
    # Chunks are written once: each kind of edge is a pass over them.
    edges = extraction.extract(cut(chunking.chunk_files(source_files(spark, sf_dir))), lx.DOMAIN)[1]
    edges = edges.filter(F.col("rel").isin("DECLARES", "HAS_PARAMETER", "VALIDATES") & F.col("dst_label").isin("PythonClass", "PythonFunction", "Parameter"))
    return extraction.merge_edges(edges).select(*graph.EDGE_KEY)


def concept_links(spark, sf_dir):
    """Three triple patterns over the domain dictionary's graph of the documents, by target."""
    word = F.element_at(F.array(*map(F.lit, CONCEPT_WORDS)), (F.col("doc_id") % 6 + 1).cast("int"))
    words = table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("relative_path"), word.alias("word"))
    files = corpus(spark, sf_dir).join(words, "relative_path").withColumn("text", F.concat_ws("\n", "word", "text")).drop("word")
    nodes, edges = extraction.extract(chunking.window_chunks(files), lx.DOMAIN)
    nodes = nodes.filter(F.col("label").isin(*CONCEPT_LABELS, "PythonModule", "DocPage", "ExampleNotebook", "TestCase")).select("label", "name").distinct()
    links = edges.filter(F.col("rel").isin(CONCEPT_RELATIONS)).select(*graph.EDGE_KEY).distinct()
    rows = written(semantic.instances(nodes, links.unionByName(lx.taxonomy(spark, lx.DOMAIN, lx.SIBLINGS)[1].filter("rel = 'ALTERNATIVE_TO'"))))
    out = None
    for relation in CONCEPT_RELATIONS:
        found = semantic.labelled_links(rows, semantic.NAMESPACE + relation, "source", "target").groupBy(F.lit(relation).alias("relation"), "target").agg(F.count("*").alias("n"))
        out = found if out is None else out.unionByName(found)
    return out


_CHUNKS = r"""
d AS (SELECT doc_id AS i, doc_id % 7 AS j, coalesce(n_chars, 0) % 5 AS k, doc_id % 4 AS kind FROM documents),
parts(kind, n, chunk_kind, section, a, b, text) AS (
  SELECT 0, 0, 'module_docstring', 'module_docstring', 1, 1, repeat('"', 3) || 'Doc.' || repeat('"', 3)
  UNION ALL SELECT 1, 0, 'section', 'Risk', 2, 5, E'Risk\n####\nIntro.' UNION ALL SELECT 1, 1, 'section', 'Part Two', 6, 8, E'Part Two\n--------\nBody <i>.'
  UNION ALL SELECT 2, 0, 'example_section', 'example_section', 1, 1, E'# T\npart <i>' UNION ALL SELECT 2, 1, 'example_cell', 'example_cell', 2, 2, 'y = <i>'
  UNION ALL SELECT 3, 0, 'test_function', 'test_b', 4, 5, E'def test_b():\n    assert run(<i>)' UNION ALL SELECT 3, 1, 'test_function', 'test_a', 7, 8, E'def test_a():\n    make_<j>(2)'
  UNION ALL SELECT 0, 1, 'class', 'C<i>', 4, 6, E'class C<i>(Base):\n    def run(self, first, second=2, *rest):\n        return first'
  UNION ALL SELECT 0, 2, 'function', 'f<j>', 8, 9, E'def f<j>(a):\n    return os' UNION ALL SELECT 0, 3, 'function', 'run', 5, 6, E'def run(self, first, second=2, *rest):\n        return first'
  UNION ALL SELECT 0, 4, 'fallback', 'fallback', 2, 3, 'import os' UNION ALL SELECT 0, 5, 'fallback', 'fallback', 7, 7, ''),
f AS (
  SELECT ['pkg/m', 'docs/source/p', 'examples/e', 'tests/test_'][CAST(d.kind AS INTEGER) + 1] || i || ['.py', '.rst', '.ipynb', '.py'][CAST(d.kind AS INTEGER) + 1] AS path, ['python', 'docs', 'example', 'test'][CAST(d.kind AS INTEGER) + 1] AS source_type, n, chunk_kind,
    replace(replace(section, '<i>', CAST(i AS VARCHAR)), '<j>', CAST(j AS VARCHAR)) AS section, (CASE WHEN d.kind = 0 AND n = 2 THEN a + k ELSE a END)::INTEGER AS ls, (CASE WHEN d.kind = 0 AND n IN (2, 5) THEN b + k ELSE b END)::INTEGER AS le,
    CASE WHEN d.kind = 0 AND n = 5 THEN rtrim(repeat(E'x = 1\n', CAST(k AS INTEGER)), chr(10)) ELSE replace(replace(text, '<i>', CAST(i AS VARCHAR)), '<j>', CAST(j AS VARCHAR)) END AS text
  FROM d JOIN parts p ON d.kind = p.kind)
SELECT path || '::chunk:' || n AS chunk_id, source_type, chunk_kind, section, ls AS line_start, le AS line_end, sha256(path || '|' || section || '|' || ls || '|' || le || '|' || text) AS content_hash FROM f WHERE text <> ''"""
_SYMBOL_EDGES = """
WITH d AS (SELECT doc_id AS i, doc_id % 7 AS j, doc_id % 4 AS kind FROM documents)
SELECT 'PythonModule' AS src_label, 'pkg.m' || i AS src_name, 'DECLARES' AS rel, 'PythonClass' AS dst_label, 'C' || i AS dst_name FROM d WHERE kind = 0
UNION SELECT 'PythonModule', 'pkg.m' || i, 'DECLARES', 'PythonFunction', unnest(['run', 'f' || j]) FROM d WHERE kind = 0
UNION SELECT 'PythonFunction', 'run', 'HAS_PARAMETER', 'Parameter', unnest(['run:first', 'run:second', 'run:rest']) FROM d WHERE kind = 0
UNION SELECT 'PythonFunction', 'f' || j, 'HAS_PARAMETER', 'Parameter', 'f' || j || ':a' FROM d WHERE kind = 0
UNION SELECT 'TestCase', 'tests/test_' || i || '.py', 'DECLARES', 'PythonFunction', unnest(['test_a', 'test_b']) FROM d WHERE kind = 3
UNION SELECT 'TestCase', 'tests/test_' || i || '.py', 'VALIDATES', 'PythonFunction', unnest(['run', 'make_' || j]) FROM d WHERE kind = 3"""


def _said(entry: lx.Entry) -> str:
    words = "|".join(a.replace("-", r"\-").replace(" ", r"[\s\-_]+") for a in entry.aliases)
    return f"SELECT DISTINCT path, '{entry.label}' AS label, '{entry.canonical}' AS name FROM chunks WHERE regexp_matches(low, '(^|[^a-z0-9])({words})([^a-z0-9]|$)')"


_WORDS = ", ".join(f"'{w}'" for w in CONCEPT_WORDS)
_LINKED = oracles._CORPUS.replace("coalesce(text, '') AS text", f"[{_WORDS}][CAST(doc_id % 6 AS INTEGER) + 1] || chr(10) || coalesce(text, '') AS text")
_SIBLINGS = ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for _, a, b in lx.SIBLINGS)
_CONCEPTS = f"""WITH {_LINKED}, said AS ({" UNION ALL ".join(_said(e) for e in lx.DOMAIN if e.label in CONCEPT_LABELS)}), sib(a, b) AS (VALUES {_SIBLINGS})
SELECT CASE label WHEN 'RiskMeasure' THEN 'SUPPORTS_RISK_MEASURE' ELSE 'USES_ESTIMATOR' END AS relation, name AS target, count(*) AS n FROM said WHERE label <> 'PortfolioMethod' GROUP BY ALL
UNION ALL SELECT 'ALTERNATIVE_TO', b, count(*) FROM sib WHERE a IN (SELECT name FROM said) AND b IN (SELECT name FROM said) GROUP BY b"""

NAMED = [file_chunks, symbol_edges, concept_links]
ORACLES = {"file_chunks": f"WITH {_CHUNKS}", "symbol_edges": _SYMBOL_EDGES, "concept_links": _CONCEPTS}


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMED}
