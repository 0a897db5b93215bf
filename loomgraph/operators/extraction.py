"""From chunks to a typed property graph: nodes and edges, one select per kind, then a union.

chunks: chunk_id, relative_path, source_type, module_name, chunk_kind, chunk_index, line_start,
line_end, content. nodes: label, name, props, ord. edges: src_label, src_name, rel, dst_label,
dst_name, props, ord. `ord` says which of two equal keys was written last.
"""

from __future__ import annotations

import keyword
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.lexicon import NODE_LABELS, RELATION_TYPES, Entry, mentions
from loomgraph.functions.text import strip

EDGE_KEY = ["src_label", "src_name", "rel", "dst_label", "dst_name"]
# Call-like names that are no API targets.
BUILTINS = ["assert", "print", "len", "range", "list", "dict", "set", "tuple", "int", "float", "str", "bool", "enumerate", "zip"]
NAME = "[A-Za-z_][A-Za-z0-9_]*"


def source_label(kind: Column) -> Column:
    return F.when(kind == "docs", "DocPage").when(kind == "example", "ExampleNotebook").when(kind == "test", "TestCase").otherwise("PythonModule")


def concept_relation(kind: Column, label: Column) -> Column:
    """How a source relates to a concept: by the concept's label first, then the source's kind."""
    by_label = {"RiskMeasure": "SUPPORTS_RISK_MEASURE", "ConstraintType": "SUPPORTS_CONSTRAINT", "Estimator": "USES_ESTIMATOR", "ReportType": "PRODUCES_REPORT", "Solver": "USES"}
    by_kind = {"docs": "DESCRIBES", "example": "DEMONSTRATES", "test": "VALIDATES"}
    out = F.when(F.lit(False), "")
    for name, rel in by_label.items():
        out = out.when(label == name, rel)
    for name, rel in by_kind.items():
        out = out.when(kind == name, rel)
    return out.otherwise("IMPLEMENTS")


def concept_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), "(?U)\\s+", " ")


def class_names(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?m)^\\s*class\\s+({NAME})\\b"), F.lit(1))))


def function_names(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?m)^\\s*(?:async\\s+)?def\\s+({NAME})\\s*\\("), F.lit(1))))


def signatures(text: Column) -> Column:
    """array<struct<func, params>> of one-line signatures that end in "):", where any parameter is left.

    Annotated parameters do not count as names, so they are left out.
    """
    pattern = F.lit(f"(?m)^\\s*(?:async\\s+)?def\\s+({NAME})\\s*\\((.*?)\\)\\s*:")
    bare = lambda p: F.regexp_replace(strip(F.element_at(F.split(strip(p), "="), 1)), "^\\*+", "")
    names = lambda blob: F.filter(F.transform(F.split(blob, ","), bare), lambda p: p.rlike(f"^{NAME}$") & ~p.isin("self", "cls"))
    both = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda f, p: F.struct(f.alias("func"), names(p).alias("params")))
    return F.filter(both, lambda d: F.size(d["params"]) > 0)


def api_targets(text: Column) -> Column:
    """Called names that are no builtins, keywords or tests."""
    called = F.array_distinct(F.regexp_extract_all(text, F.lit(f"\\b({NAME})\\s*\\("), F.lit(1)))
    blocked = F.array(*map(F.lit, sorted({*BUILTINS, *keyword.kwlist})))
    return F.array_sort(F.filter(F.array_except(called, blocked), lambda x: ~x.startswith("test_")))


def _props(**values: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())


def _no_props() -> Column:
    return F.create_map().cast("map<string,string>")


def _node(label: Column, name: Column, props: Column | None = None) -> Column:
    return F.struct(label.alias("label"), name.alias("name"), (_no_props() if props is None else props).alias("props"))


def _edge(src_label: Column, src: Column, rel: Column, dst_label: Column, dst: Column) -> Column:
    return F.struct(src_label.alias("src_label"), src.alias("src_name"), rel.alias("rel"), dst_label.alias("dst_label"), dst.alias("dst_name"))


def _to(rel: str, kind: str, ends: tuple[Column, Column]) -> Callable[[Column], Column]:
    return lambda x: _edge(*ends, F.lit(rel), F.lit(kind), x)


def chunk_mentions(chunks: DataFrame, lexicon: list[Entry]) -> DataFrame:
    """chunk_id, label, canonical."""
    found = chunks.select("chunk_id", mentions(F.col("content"), lexicon).alias("m"))
    return found.select("chunk_id", F.inline("m"))


def related_pairs(chunks: DataFrame, lexicon: list[Entry]) -> DataFrame:
    """Concepts that one chunk mentions together, each pair once a chunk, by (label, name).

    Pairs are made inside the row from its bounded list of mentions: no join, no shuffle.
    """
    found = chunks.select("chunk_id", mentions(F.col("content"), lexicon).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b > a), lambda b: F.struct(a["label"].alias("src_label"), a["canonical"].alias("src_name"), b["label"].alias("dst_label"), b["canonical"].alias("dst_name")))))
    return found.select("chunk_id", F.inline(pairs))


def extract(chunks: DataFrame, lexicon: list[Entry]) -> tuple[DataFrame, DataFrame]:
    """All nodes and edges of the chunks, not yet merged.

    A chunk's nodes, and its edges, are made inside its row and unnested once: one pass over the
    chunks each, without joins or shuffles.
    """
    lit, col = F.lit, F.col
    label = source_label(col("source_type"))
    name = F.when((label == "PythonModule") & (F.coalesce("module_name", lit("")) != ""), col("module_name")).otherwise(col("relative_path"))
    code, test = col("source_type").isin("python", "test"), col("source_type") == "test"
    none = F.array().cast("array<string>")
    only = lambda cond, found: F.when(F.coalesce(cond, lit(False)), found).otherwise(none)
    rows = chunks.withColumns({"s_label": label, "s_name": name, "ord": F.struct("relative_path", "chunk_index"), "m": mentions(col("content"), lexicon)})
    rows = rows.withColumns({
        "classes": only(code, class_names(col("content"))),
        "functions": only(code, function_names(col("content"))),
        "targets": only(test, api_targets(col("content"))),
        "sigs": F.when(F.coalesce(code, lit(False)), signatures(col("content"))),
    })
    # A function that is defined twice in a chunk keeps its last parameters.
    last = F.filter("sigs", lambda d, i: ~F.exists(F.slice("sigs", i + 2, F.size("sigs")), lambda e: e["func"] == d["func"]))
    params = F.flatten(F.transform(last, lambda d: F.transform(d["params"], lambda p: F.struct(d["func"].alias("func"), p.alias("param"), F.concat_ws(":", d["func"], p).alias("full")))))
    rows = rows.withColumn("params", F.coalesce(params, F.array().cast("array<struct<func:string,param:string,full:string>>")))

    chunk = lambda: (lit("Chunk"), col("chunk_id"))
    source = lambda: (col("s_label"), col("s_name"))
    chunk_props = ("relative_path", "chunk_index", "chunk_kind", "line_start", "line_end", "content", "source_type")
    nodes = F.concat(
        F.array(_node(*source(), _props(**{c: col(c) for c in ("source_type", "relative_path", "module_name")})), _node(*chunk(), _props(**{c: col(c) for c in chunk_props}))),
        F.transform("classes", lambda x: _node(lit("PythonClass"), x)),
        F.transform(F.concat("functions", "targets"), lambda x: _node(lit("PythonFunction"), x)),
        F.transform("params", lambda x: _node(lit("Parameter"), x["full"], _props(function_name=x["func"], parameter_name=x["param"]))),
        F.transform("m", lambda x: _node(x["label"], x["canonical"])),
        F.transform("m", lambda x: _node(lit("Concept"), concept_name(x["canonical"]), _props(canonical=x["canonical"]))),
    )
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b > a), lambda b: _edge(a["label"], a["canonical"], lit("RELATED_TO"), b["label"], b["canonical"]))))
    named = lambda rel, ends: [F.transform(c, _to(rel, kind, ends)) for c, kind in (("classes", "PythonClass"), ("functions", "PythonFunction"))]
    edges = F.concat(
        F.array(_edge(*source(), lit("HAS_CHUNK"), *chunk())),
        *named("DECLARES", source()),
        *named("MENTIONS", chunk()),
        F.transform("params", lambda x: _edge(lit("PythonFunction"), x["func"], lit("HAS_PARAMETER"), lit("Parameter"), x["full"])),
        F.transform("targets", lambda x: _edge(lit("TestCase"), col("s_name"), lit("VALIDATES"), lit("PythonFunction"), x)),
        F.transform("m", lambda x: _edge(*chunk(), lit("MENTIONS"), x["label"], x["canonical"])),
        F.transform("m", lambda x: _edge(*chunk(), lit("MENTIONS"), lit("Concept"), concept_name(x["canonical"]))),
        F.transform("m", lambda x: _edge(*source(), concept_relation(col("source_type"), x["label"]), x["label"], x["canonical"])),
        pairs,
    )
    return rows.select(F.inline(nodes), "ord"), rows.select(F.inline(edges), _no_props().alias("props"), "ord")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _merged(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per key; of each property the value written last."""
    keys = rows.select(*key).distinct()
    entries = rows.filter(F.size("props") > 0).select(*key, "ord", F.explode("props").alias("k", "v"))
    last = entries.groupBy(*key, "k").agg(F.max_by("v", F.struct("ord", "v")).alias("v"))
    props = last.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    return keys.join(props, key, "left").withColumn("props", F.coalesce("props", _no_props()))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    return _merged(nodes, ["label", "name"])


def merge_edges(edges: DataFrame) -> DataFrame:
    return _merged(edges, EDGE_KEY)


Extractor = Callable[[str, str], dict]
PAYLOAD = "chunk_id string, nodes array<struct<label:string,name:string,properties:map<string,string>>>, edges array<struct<source_name:string,source_label:string,target_name:string,target_label:string,relation_type:string>>"


def model_payloads(chunks: DataFrame, extractor: Extractor) -> DataFrame:
    """Run a pluggable extractor(content, source_type) over the chunks; one that raises or
    returns no mapping gives nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for cid, content, kind in zip(batch.chunk_id, batch.content, batch.source_type, strict=True):
                try:
                    found = extractor(content, kind)
                except Exception:  # noqa: BLE001 - any failure of a model means no enrichment
                    found = None
                found = found if isinstance(found, dict) else {}
                text = lambda x, k: str(x.get(k, "") or "").strip()
                nodes = [{"label": text(n, "label"), "name": text(n, "name"), "properties": {k: str(v) for k, v in (n.get("properties") or {}).items() if isinstance(k, str) and isinstance(v, (str, int))}} for n in found.get("nodes", []) if isinstance(n, dict)]
                edges = [{k: text(e, k) for k in ("source_name", "source_label", "target_name", "target_label", "relation_type")} for e in found.get("edges", []) if isinstance(e, dict)]
                rows.append((cid, nodes, edges))
            yield pd.DataFrame(rows, columns=["chunk_id", "nodes", "edges"])

    return chunks.select("chunk_id", "content", "source_type").mapInPandas(run, PAYLOAD)


def model_graph(chunks: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the payloads that the registries allow."""
    lit, col = F.lit, F.col
    label = source_label(col("source_type"))
    name = F.when((label == "PythonModule") & (F.coalesce("module_name", lit("")) != ""), col("module_name")).otherwise(col("relative_path"))
    rows = payloads.join(chunks.select("chunk_id", label.alias("s_label"), name.alias("s_name"), F.struct("relative_path", "chunk_index").alias("ord")), "chunk_id")
    found = rows.select("chunk_id", "s_label", "s_name", "ord", F.inline("nodes")).filter(col("label").isin(NODE_LABELS) & (col("name") != ""))
    nodes = found.select("label", "name", col("properties").alias("props"), "ord")
    edge = lambda df, *ends: df.select(_edge(*ends).alias("e"), "ord").select("e.*", "ord")
    default = lambda c: F.when(col(c) == "", "Concept").otherwise(col(c))
    given = rows.select("ord", F.inline("edges")).withColumns({"a": default("source_label"), "b": default("target_label")})
    given = given.filter(col("relation_type").isin(RELATION_TYPES) & (col("source_name") != "") & (col("target_name") != "") & col("a").isin(NODE_LABELS) & col("b").isin(NODE_LABELS))
    anchors = found.filter(col("label").isin("PythonModule", "DocPage", "ExampleNotebook", "TestCase") & ~((col("label") == col("s_label")) & (col("name") == col("s_name"))))
    edges = _union([
        edge(found.filter("label <> 'Chunk'"), lit("Chunk"), col("chunk_id"), lit("MENTIONS"), col("label"), col("name")),
        edge(given, col("a"), col("source_name"), col("relation_type"), col("b"), col("target_name")),
        edge(anchors, col("s_label"), col("s_name"), lit("RELATED_TO"), col("label"), col("name")),
    ])
    return nodes, edges.withColumn("props", _props(origin=lit("llm")))
