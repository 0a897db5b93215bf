"""Adaptive routing: rules and prototype similarity choose a retrieval mode per question."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import TOKEN, embedding_cells, strip

DIM = 128
# Patterns of the rules, in order; texts are lower-cased before they are searched.
RULES: list[tuple[str, float, str, list[str]]] = [
    ("graph", 1.0, "rule_graph_intent", [
        r"\b(relationship|related|connected|dependenc|neighbou?r|graph|mention)\w*\b",
        r"\bbetween\b.*\band\b",
        r"\b(which|what uses|how does .+ relate|dependencies of|connected to)\b",
    ]),
    ("sparse", 0.95, "rule_sparse_intent", [
        r"\b(line|lines|path|file|section|exact|regex|keyword|parameter|signature)\b",
        r"\b(test_|def\s+|class\s+)\b",
        r"rp\.",
        r"rf\.",
        r"\b(optimize|to_pandas|plot_|show_)\b",
        r"\b(docstring|__init__|args:|returns:|attributes:)\b",
        r"\b[A-Za-z_][A-Za-z0-9_]*\s*\([^)]*\)",
    ]),
    ("hybrid_rerank", 0.9, "rule_hybrid_intent", [
        r"\b(compare|trade[- ]?off|versus|vs\.?|multi[- ]?hop|end[- ]?to[- ]?end)\b",
        r"\b(difference between|pros and cons|better than|worse than)\b",
    ]),
    ("dense", 0.85, "rule_dense_intent", [r"\b(define|definition|what is|meaning|overview|explain)\b"]),
]
DEFAULT_RULE = ("sparse", 0.55, "rule_default")
# Prototype texts of each mode, in the order that breaks ties.
PROTOTYPES: dict[str, list[str]] = {
    "dense": ["explain concept definition and overview", "summarize method and rationale", "what does this term mean"],
    "sparse": ["exact function name parameter signature", "file path section line range", "specific keyword search in code", "api parameter default value signature", "python function class method module"],
    "graph": ["relationship between entities dependencies", "which components mention concept", "connected nodes and neighbourhood"],
    "hybrid_rerank": ["compare methods and evidence from docs and code", "multi-hop question with entities and details", "retrieve broad context and rerank"],
}
EMBEDDING_SHARE, RULE_SHARE, LEAST_CONFIDENCE = 0.65, 0.35, 0.2


def rule_signal(text: Column) -> Column:
    """struct<mode, score, reason> of the first rule that fits."""
    lowered = F.lower(text)
    signal = lambda m, s, r: F.struct(F.lit(m).alias("mode"), F.lit(s).alias("score"), F.lit(r).alias("reason"))
    out = F.when(F.lit(False), signal(*DEFAULT_RULE))
    for mode, score, reason, patterns in RULES:
        out = out.when(lowered.rlike("|".join(f"(?:{p})" for p in patterns)), signal(mode, score, reason))
    return out.otherwise(signal(*DEFAULT_RULE))


def _vector(text: str, dim: int) -> dict[int, float]:
    """Normalised hash embedding of a prototype (a constant of the plan)."""
    cells: dict[int, float] = {}
    for token in re.findall(TOKEN, text.lower()):
        digest = hashlib.sha256(token.encode()).digest()
        i = int.from_bytes(digest[:4], "big") % dim
        cells[i] = cells.get(i, 0.0) + (1.0 if digest[4] % 2 == 0 else -1.0)
    norm = math.sqrt(sum(v * v for v in cells.values()))
    return {i: v / norm for i, v in cells.items()} if norm else cells


def prototype_cells(dim: int = DIM, prototypes: dict[str, list[str]] = PROTOTYPES) -> list[tuple[str, int, float, float]]:
    """mode, idx, value, norm of each mode's mean vector."""
    out = []
    for mode, texts in prototypes.items():
        mean: dict[int, float] = {}
        for text in texts:
            for i, v in _vector(text, dim).items():
                mean[i] = mean.get(i, 0.0) + v / len(texts)
        norm = math.sqrt(sum(v * v for v in mean.values()))
        out += [(mode, i, v, norm) for i, v in sorted(mean.items())]
    return out


def route(questions: DataFrame, least: float = LEAST_CONFIDENCE, dim: int = DIM, prototypes: dict[str, list[str]] = PROTOTYPES) -> DataFrame:
    """questions with mode, confidence and reason."""
    spark = questions.sparkSession
    asked = questions.withColumn("_rule", rule_signal(strip(F.col("text"))))
    table = F.broadcast(spark.createDataFrame(prototype_cells(dim, prototypes), "mode string, idx long, p double, p_norm double"))
    products = embedding_cells(questions, "query_id", "text", dim).join(table, "idx").groupBy("query_id", "mode").agg((F.sum(F.col("value") * F.col("p")) / (F.max("norm") * F.max("p_norm"))).alias("cosine"))
    per_question = products.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("mode", "cosine"))).alias("_cosines"))
    rows = asked.join(per_question, "query_id", "left")
    similarity = lambda m: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("_cosines")[m], F.lit(0.0))))
    option = lambda i, m: F.struct((EMBEDDING_SHARE * similarity(m) + RULE_SHARE * F.when(F.col("_rule.mode") == m, F.col("_rule.score")).otherwise(0.0)).alias("score"), F.lit(-i).alias("order"), F.lit(m).alias("mode"), similarity(m).alias("embedding"))
    rows = rows.withColumn("_best", F.array_max(F.array(*[option(i, m) for i, m in enumerate(prototypes)])))
    blank, weak = strip(F.coalesce("text", F.lit(""))) == "", F.col("_best.score") < least
    shown = F.format_string("embedding=%.3f", F.col("_best.score"))
    reason = F.when(F.col("_best.mode") == F.col("_rule.mode"), F.concat_ws("; ", F.col("_rule.reason"), shown)).otherwise(shown)
    return rows.withColumns({
        "mode": F.when(blank | weak, "hybrid_rerank").otherwise(F.col("_best.mode")),
        "confidence": F.when(blank, 0.0).otherwise(F.col("_best.score")),
        "reason": F.when(blank, "empty_query_fallback").when(weak, "low_confidence_fallback").otherwise(reason),
    }).drop("_rule", "_cosines", "_best")


# What a reason says to a reader.
REASONS = {
    "rule_graph_intent": "The question asked about relationships between concepts, so graph retrieval was prioritized.",
    "rule_sparse_intent": "The question looked like an exact API or keyword lookup, so exact match retrieval was prioritized.",
    "rule_hybrid_intent": "The question benefits from comparing multiple source types, so retrieval methods were combined.",
    "rule_dense_intent": "The question asked for an explanation or definition, so semantic retrieval was prioritized.",
    "rule_default": "No strong route-specific cue was present, so the default retrieval strategy was used.",
    "low_confidence_fallback": "Signals were mixed, so the system fell back to the broadest retrieval strategy.",
    "static_config (adaptive routing disabled)": "Adaptive selection is off, so the configured default retrieval strategy was used.",
    "empty_query_fallback": "No usable query text was available, so the broad fallback strategy was used.",
}


def signal_label(confidence: Column, reason: Column) -> Column:
    """How well a question matched its route."""
    first = strip(F.element_at(F.split(reason, ";"), 1))
    out = F.when(first == "static_config (adaptive routing disabled)", "Configured default").when(first == "low_confidence_fallback", "Broad fallback")
    return out.when(confidence >= 0.75, "High match").when(confidence >= 0.5, "Targeted match").otherwise("Heuristic match")


def reason_text(mode: Column, reason: Column) -> Column:
    """A reason as a sentence; one without a sentence of its own names the mode."""
    first = strip(F.element_at(F.split(reason, ";"), 1))
    known = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.coalesce(known[first], F.concat(F.lit("This question best matched the "), F.lower(F.replace(mode, F.lit("_"), F.lit(" "))), F.lit(" pattern.")))


def cost_label(cost: Column) -> Column:
    """Four places of the stored double, as C prints them; format_string rounds its shortest decimal digits (0.00165 to 0.0017)."""
    places = F.call_function("format_number", cost, F.lit("0.0000"))
    return F.when(cost <= 0, "Low").when(cost < 0.001, "<$0.001 / query").otherwise(F.concat(F.lit("$"), places, F.lit(" / query")))
