"""Deterministic retrieval and answer metrics, reports and comparisons.

A results row is one question: question, reference_answer, expected (terms), answer, contexts
(array of texts by rank), results (array of struct with content, entities, neighbours).
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import claims, coverage, jaccard, n_contained, strip, token_set, tokens
from loomgraph.operators.tables import written

log = logging.getLogger(__name__)

METRICS = ["context_recall", "context_precision", "answer_faithfulness", "answer_relevance", "grounding", "multi_hop_accuracy", "link_mrr", "link_hits_3", "link_hits_10", "avg_latency_ms", "estimated_cost_usd"]
LOWER_IS_BETTER = ["avg_latency_ms", "estimated_cost_usd"]
# Below these a sample is marked.
FAILURES = {"context_recall": 0.45, "context_precision": 0.4, "answer_faithfulness": 0.35, "answer_relevance": 0.7, "grounding": 0.35, "multi_hop_accuracy": 0.25}
COST_PER_TOKEN = 5e-7
SUPPORT = 0.25


def _rounded(value: Column, places: int) -> Column:
    """Scaled, rounded half away from zero and scaled back, all in doubles, as DuckDB does: F.round takes ties by a double's shortest decimal digits."""
    return F.round(value * F.lit(10.0**places)) / F.lit(10.0**places)


def _mean(values: Column) -> Column:
    """Mean of an array of doubles, to 4 places; 0 if empty."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(values) == 0, 0.0).otherwise(_rounded(total / F.size(values), 4))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: inside a lambda, an expression is worked out for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lower(terms: Column) -> Column:
    return F.transform(terms, F.lower)


def fallback_terms(question: Column, reference: Column) -> Column:
    return F.slice(tokens(F.concat_ws(" ", question, reference)), 1, 8)


def context_recall(expected: Column, contexts: Column) -> Column:
    """The part of the terms that occur in any context."""
    return F.when(F.size(expected) == 0, 0.0).otherwise(n_contained(_lower(expected), F.array_join(contexts, "\n")) / F.size(expected))


def context_precision(expected: Column, contexts: Column) -> Column:
    """The part of the contexts in which any term occurs."""
    hits = F.filter(contexts, lambda c: n_contained(_lower(expected), c) > 0)
    return F.when(F.size(contexts) == 0, 0.0).otherwise(F.size(hits) / F.size(contexts))


def weighted_precision(question: Column, expected: Column, contexts: Column) -> Column:
    """Mean over contexts of 0.65 of the terms that are its tokens and 0.35 Jaccard with the question."""
    terms, asked = F.array_distinct(_lower(expected)), token_set(question)

    def score(seen: Column) -> Column:
        return F.when(F.size(seen) == 0, 0.0).otherwise(0.65 * coverage(terms, seen) + 0.35 * jaccard(asked, seen))

    return _mean(F.transform(F.transform(contexts, token_set), score))


def token_faithfulness(answer: Column, contexts: Column) -> Column:
    return coverage(token_set(answer), token_set(F.array_join(contexts, " ")))


def claim_faithfulness(answer: Column, contexts: Column) -> Column:
    """The part of the answer's claims of which a quarter of the tokens are in the contexts together."""
    said = F.transform(claims(answer), token_set)

    def share(x: Column) -> Column:
        held = F.filter(x["said"], lambda c: coverage(c, x["seen"]) >= SUPPORT)
        return F.when(F.size(x["said"]) == 0, 0.0).otherwise(F.size(held) / F.size(x["said"]))

    return _once(F.struct(said.alias("said"), token_set(F.array_join(contexts, "\n")).alias("seen")), share)


def token_relevance(question: Column, answer: Column) -> Column:
    return coverage(token_set(question), token_set(answer))


def weighted_relevance(question: Column, answer: Column) -> Column:
    q, a = token_set(question), token_set(answer)
    none = (F.size(q) == 0) | (F.size(a) == 0)
    return F.when(none, 0.0).otherwise(F.round(0.2 * jaccard(q, a) + 0.8 * coverage(q, a), 4))


def grounding(answer: Column, contexts: Column, top: int = 3) -> Column:
    """Mean over claims of 0.75 of the support by the first contexts and 0.25 of its share in all support."""
    said = claims(answer)
    said = F.when((F.size(said) == 0) & (strip(answer) != ""), F.array(strip(answer))).otherwise(said)
    sets = F.filter(F.transform(said, token_set), lambda s: F.size(s) > 0)
    seen = lambda texts: token_set(F.array_join(texts, "\n"))

    def support(x: Column) -> Column:
        both = F.transform(x["sets"], lambda s: F.struct(coverage(s, x["all"]).alias("seen"), coverage(s, x["first"]).alias("high")))
        scores = F.transform(both, lambda b: 0.75 * b["high"] + 0.25 * F.when(b["seen"] > 0, b["high"] / b["seen"]).otherwise(0.0))
        return F.when((F.size(x["all"]) == 0) | (F.size(x["first"]) == 0), 0.0).otherwise(_once(scores, _mean))

    return _once(F.struct(sets.alias("sets"), seen(contexts).alias("all"), seen(F.slice(contexts, 1, max(1, top))).alias("first")), support)


def _all_tokens(texts: Column) -> Column:
    return token_set(F.array_join(texts, "\n"))


def multi_hop(question: Column, results: Column) -> Column:
    """0.45 query coverage, 0.35 best bridge to another result, 0.20 for entities with graph context."""
    asked = token_set(question)
    given = F.transform(results, lambda r: F.struct(
        _all_tokens(F.concat(F.array(r["content"]), r["entities"], r["neighbours"])).alias("all"),
        _all_tokens(r["entities"]).alias("entities"),
        _all_tokens(F.array_except(r["neighbours"], r["entities"])).alias("graph"),
    ))

    def score(support: Column, s: Column, i: Column) -> Column:
        others = F.filter(support, lambda o, j: (i != j) & (F.size(o["all"]) > 0))
        bridge = F.when(F.size(s["entities"]) == 0, 0.0).otherwise(F.coalesce(F.array_max(F.transform(others, lambda o: jaccard(s["entities"], o["all"]))), F.lit(0.0)))
        structure = F.when((F.size(s["entities"]) > 0) & (F.size(s["graph"]) > 0), 1.0).when(F.size(s["entities"]) > 0, 0.5).otherwise(0.0)
        full = _rounded(0.45 * coverage(asked, s["all"]) + 0.35 * bridge + 0.20 * structure, 4)
        return F.when(F.size(s["all"]) == 0, 0.0).otherwise(full)

    return _once(_once(given, lambda support: F.transform(support, lambda s, i: score(support, s, i))), _mean)


def first_hit(expected: Column, contexts: Column) -> Column:
    """Rank of the first context with any term; null if none."""
    ranks = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(contexts))), lambda i: n_contained(_lower(expected), F.coalesce(F.try_element_at(contexts, i), F.lit(""))) > 0)
    return F.try_element_at(ranks, F.lit(1))


def link_metrics(expected: Column, contexts: Column) -> dict[str, Column]:
    rank = first_hit(expected, contexts)
    within = lambda k: F.when(rank <= k, 1.0).otherwise(0.0)
    return {"link_mrr": F.coalesce(F.round(1.0 / rank, 4), F.lit(0.0)), "link_hits_3": within(3), "link_hits_10": within(10)}


def estimated_cost(question: Column, answer: Column, contexts: Column) -> Column:
    n = F.size(tokens(question)) + F.size(tokens(answer)) + F.size(tokens(F.array_join(contexts, "\n")))
    return _rounded(n * F.lit(COST_PER_TOKEN), 6)


def synthesize(question: Column, results: Column) -> Column:
    """An answer made of the first result's opening, cut at a sentence, line or word after 80 characters."""
    top = F.try_element_at(results, F.lit(1))
    raw = F.substring(strip(F.coalesce(top["content"], F.lit(""))), 1, 220)
    cut = lambda pattern: F.regexp_extract(raw, f"(?s)^(.{{80,}}){pattern}", 1)
    part = F.coalesce(*[F.nullif(strip(cut(p)), F.lit("")) for p in ("\\. ", "\n", " ")], strip(raw))
    part = F.regexp_replace(part, "['\"]", "")
    entities = F.array_join(F.slice(top["entities"], 1, 5), ", ")
    start = F.concat(F.lit("Regarding "), question, F.lit(": "))
    return (
        F.when(F.size(results) == 0, "No supporting contexts were retrieved.")
        .when((part != "") & (entities != ""), F.concat(start, part, F.lit(". Key entities: "), entities, F.lit(".")))
        .when(part != "", F.concat(start, part, F.lit(".")))
        .when(entities != "", F.concat(start, F.lit("key entities include "), entities, F.lit(". Source: "), top["relative_path"], F.lit(".")))
        .otherwise(F.concat(start, F.lit("see source "), top["relative_path"], F.lit(".")))
    )


def score_samples(rows: DataFrame, profile: str = "weighted") -> DataFrame:
    """rows with every metric and the failure reasons; profile "weighted" or "heuristic"."""
    q, a, c = F.col("question"), F.col("answer"), F.col("contexts")
    expected = F.when(F.size("expected") > 0, F.col("expected")).otherwise(fallback_terms(q, F.col("reference_answer")))
    rows = rows.withColumn("expected", expected)
    e = F.col("expected")
    plain = profile == "heuristic"
    out = {
        "context_recall": context_recall(e, c),
        "context_precision": context_precision(e, c) if plain else weighted_precision(q, e, c),
        "answer_faithfulness": token_faithfulness(a, c) if plain else claim_faithfulness(a, c),
        "answer_relevance": token_relevance(q, a) if plain else weighted_relevance(q, a),
        "grounding": grounding(a, c),
        "multi_hop_accuracy": multi_hop(q, F.col("results")),
        **link_metrics(e, c),
        "estimated_cost_usd": estimated_cost(q, a, c),
    }
    rows = rows.withColumns(out)
    return rows.withColumn("failure_reasons", failure_reasons())


def failure_reasons() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(m) < least, f"low_{m}") for m, least in FAILURES.items()]))


RESULT = "rank:int,content:string,relative_path:string,entities:array<string>,neighbours:array<string>"


def answer_samples(samples: DataFrame, retriever: Callable[[DataFrame], DataFrame], modes: list[str]) -> DataFrame:
    """Results rows of every sample (query_id, question, reference_answer, expected) by every mode, in one plan.

    retriever: questions (query_id, text, mode) -> ranked hits with content. A sample without hits
    has an empty context and the template's answer for it.
    """
    rows = samples.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).withColumn("query_id", F.concat_ws("/", "query_id", "mode"))
    hits = retriever(rows.select("query_id", F.col("question").alias("text"), "mode"))
    items = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content", "relative_path", "entities", "neighbours"))).alias("results"))
    rows = rows.join(items, "query_id", "left").withColumn("results", F.coalesce("results", F.array().cast(f"array<struct<{RESULT}>>")))
    rows = rows.withColumn("contexts", F.transform("results", lambda r: r["content"]))
    return rows.withColumn("answer", synthesize(F.col("question"), F.col("results")))


def measured(df: DataFrame, stage: str) -> tuple[DataFrame, dict[str, object]]:
    """df written, and what Spark observed while it was made: stage, n_rows and ms of wall clock."""
    seen = Observation(stage)
    started = time.perf_counter()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n_rows")))
    return out, {"stage": stage, "n_rows": seen.get["n_rows"], "ms": (time.perf_counter() - started) * 1000}


def run(samples: DataFrame, retriever: Callable[[DataFrame], DataFrame], modes: list[str], profile: str = "weighted", er: DataFrame | None = None, metadata: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, list[dict[str, object]]]:
    """report (a row per mode, with avg_latency_ms), samples (with latency_ms) and the stages' measures.

    Every mode retrieves on its own; its questions share its time, as they run as one batch. A mode
    whose retrieval fails is logged and has no results, so that its samples have empty contexts.
    """
    n, stages, found = samples.count(), [], []
    for mode in modes:
        asked = samples.select(F.concat_ws("/", "query_id", F.lit(mode)).alias("query_id"), F.col("question").alias("text"), F.lit(mode).alias("mode"))
        started = time.perf_counter()
        try:
            hits, seen = measured(retriever(asked).select("query_id", "rank", "content", "relative_path", "entities", "neighbours"), f"retrieve {mode}")
        except Exception as failure:  # noqa: BLE001 - a retriever is the caller's code
            log.warning("retrieval by %s failed: %s", mode, str(failure)[:500])
            hits, seen = None, {"stage": f"retrieve {mode}", "n_rows": 0, "ms": (time.perf_counter() - started) * 1000, "error": str(failure)[:500]}
        stages.append(seen)
        if hits is not None:
            found.append(hits)
    none = samples.sparkSession.createDataFrame([], "query_id string, rank int, content string, relative_path string, entities array<string>, neighbours array<string>")
    hits = reduce(DataFrame.unionByName, found, none)
    latency = {mode: seen["ms"] / max(1, n) for mode, seen in zip(modes, stages, strict=True)}
    rows = answer_samples(samples, lambda _: hits, modes)
    rows = rows.withColumn("latency_ms", F.create_map(*[F.lit(x) for pair in latency.items() for x in pair])[F.col("mode")])
    scored, seen = measured(score_samples(rows, profile), "score")
    return report(scored, "mode", er=er, metadata={"metric_profile": profile, **(metadata or {})}), scored, [*stages, seen]


def report(scored: DataFrame, *by: str, er: DataFrame | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """The mean of every metric that the samples have, to 4 places: one row, or one per group.

    A measured latency_ms column becomes avg_latency_ms. er: one row of precision, recall and f1,
    which joins every row with er_ before its names. metadata: constant columns (such as the mode).
    """
    if "latency_ms" in scored.columns and "avg_latency_ms" not in scored.columns:
        scored = scored.withColumnRenamed("latency_ms", "avg_latency_ms")
    out = scored.groupBy(*by).agg(F.count("*").alias("num_samples"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS if m in scored.columns])
    if er is not None:
        one = er.select(*[F.coalesce(m, F.lit(0.0)).alias(f"er_{m}") for m in ("precision", "recall", "f1")]).limit(1)
        out = out.join(F.broadcast(one), how="cross")
    return out.withColumns({k: F.lit(v) for k, v in (metadata or {}).items()})


def contrast(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """metric, delta, verdict of two one-row reports; lower latency and cost are better."""
    shared = [m for m in METRICS if m in baseline.columns and m in candidate.columns]
    tall = lambda df, name: df.unpivot([], shared, "metric", name)
    rows = tall(baseline, "base").join(tall(candidate, "cand"), "metric").withColumn("delta", F.round(F.col("cand") - F.col("base"), 6))
    better = F.when(F.col("metric").isin(LOWER_IS_BETTER), F.col("delta") < 0).otherwise(F.col("delta") > 0)
    verdict = F.when(F.abs("delta") < 0.0001, "unchanged").when(better, "improved").otherwise("regressed")
    return rows.select("metric", "delta", verdict.alias("verdict"))


def winner(contrasted: DataFrame) -> DataFrame:
    n = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0))
    counts = contrasted.agg(n("improved").alias("improved"), n("regressed").alias("regressed"))
    return counts.withColumn("winner", F.when(F.col("improved") > F.col("regressed"), "candidate").when(F.col("regressed") > F.col("improved"), "baseline").otherwise("tie"))


def sample_deltas(baseline: DataFrame, candidate: DataFrame, metrics: list[str] = ["context_recall", "answer_faithfulness"]) -> DataFrame:  # noqa: B006
    """Per question: both values and their difference; a missing candidate counts as 0."""
    a = baseline.select("question", *[F.col(m).alias(f"baseline_{m}") for m in metrics])
    b = candidate.select("question", *[F.col(m).alias(f"candidate_{m}") for m in metrics])
    out = a.join(b, "question", "left").na.fill(0.0)
    return out.withColumns({f"delta_{m}": F.round(F.col(f"candidate_{m}") - F.col(f"baseline_{m}"), 4) for m in metrics})


# Question, reference answer, expected terms.
SAMPLES = [
    ("What is Hierarchical Risk Parity (HRP)?", "HRP is a hierarchical portfolio allocation method based on clustering and risk budgeting.", ["hrp", "hierarchical risk parity", "clustering", "risk parity"]),
    ("How is CVaR-based optimization computed?", "CVaR is a risk measure and portfolios can be optimized under CVaR objectives and constraints.", ["cvar", "value at risk", "risk measure", "optimization"]),
    ("Which estimators are used for covariance?", "Several estimators are documented, including historical and shrinkage-style estimators.", ["historical", "ledoit", "shrinkage", "covariance"]),
    ("What constraints can be applied in optimization?", "Portfolio constraints such as budget, leverage, and risk-related constraints.", ["constraint", "budget", "leverage", "risk contribution"]),
    ("How do examples demonstrate portfolio reports and plots?", "Examples and docs show plotting and reporting workflows for frontier, allocations, and risk contributions.", ["examples", "report", "plot", "efficient frontier"]),
]


def default_samples(spark: SparkSession) -> DataFrame:
    """The built-in questions with their expected terms."""
    return spark.createDataFrame(SAMPLES, "question string, reference_answer string, expected array<string>")

