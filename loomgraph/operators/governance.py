"""Gates, trends, service levels and guarded questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.lexicon import NODE_LABELS
from loomgraph.functions.text import strip

# Limits of the gate and of the service levels, and words that no question may have.
GATE_LEAST = {"answer_faithfulness": 0.35, "answer_relevance": 0.8, "context_recall": 0.45, "grounding": 0.35, "multi_hop_accuracy": 0.25}
GATE_MOST = {"avg_latency_ms": 5000.0, "estimated_cost_usd": 0.02}
DRIFT_SCORES = ["context_recall", "answer_faithfulness", "answer_relevance", "grounding", "multi_hop_accuracy"]
DRIFT_SCORE, DRIFT_LATENCY, DRIFT_COST = -0.15, 500.0, 0.005
SLO_LEAST = {"answer_faithfulness": 0.4, "grounding": 0.4}
SLO_MOST = {"avg_latency_ms": 3000.0, "estimated_cost_usd": 0.02}
UNSAFE = ["create", "merge", "delete", "set ", "remove", "drop", "call dbms", "load csv"]
HISTORY = 30
GUARD_ROWS = 25


def gate(reports: DataFrame, least: dict[str, float] = GATE_LEAST, most: dict[str, float] = GATE_MOST) -> DataFrame:
    """reports with failures (the metrics beyond their limits) and passed."""
    bad = [F.when(F.col(m) < v, m) for m, v in least.items()] + [F.when(F.col(m) > v, m) for m, v in most.items()]
    return reports.withColumn("failures", F.array_compact(F.array(*bad))).withColumn("passed", F.size("failures") == 0)


def require_gate(reports: DataFrame, **limits) -> None:
    failed = gate(reports, **limits).filter("NOT passed").select("failures").first()
    if failed:
        raise RuntimeError("; ".join(failed.failures))


def trend(reports: DataFrame, by: str, order: str, metrics: list[str], keep: int = HISTORY) -> DataFrame:
    """Per series, the last `keep` reports with each metric's change from the one before (0 for the first)."""
    w = Window.partitionBy(by)
    rows = reports.withColumns({f"delta_{m}": F.coalesce(F.round(F.col(m) - F.lag(m).over(w.orderBy(order)), 6), F.lit(0.0)) for m in metrics})
    return rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc(order)))).filter(F.col("_r") <= keep).drop("_r")


def append_history(reports: DataFrame, path: str) -> None:
    """Adds reports to the history, a table in Parquet; readers cut it to the last ones (trend)."""
    reports.write.mode("append").parquet(path)


def history(spark: SparkSession, path: str, by: str, order: str, metrics: list[str], keep: int = HISTORY) -> DataFrame:
    """The kept history of every series with its changes and whether it drifted."""
    rows = trend(spark.read.parquet(path), by, order, metrics, keep)
    return rows.withColumn("drift_flagged", drift(rows.columns))


def read_only(statement: Column) -> Column:
    """A statement starts with match and has no unsafe word."""
    text = F.lower(strip(F.coalesce(statement, F.lit(""))))
    safe = text.startswith("match")
    for word in UNSAFE:
        safe = safe & ~F.contains(text, F.lit(word))
    return safe


def drift(columns: list[str]) -> Column:
    """Any score fell, or latency or cost rose, by its limit; of the delta columns that there are."""
    out = F.lit(False)
    for m in DRIFT_SCORES:
        if f"delta_{m}" in columns:
            out = out | (F.col(f"delta_{m}") <= DRIFT_SCORE)
    for m, limit in (("avg_latency_ms", DRIFT_LATENCY), ("estimated_cost_usd", DRIFT_COST)):
        if f"delta_{m}" in columns:
            out = out | (F.col(f"delta_{m}") >= limit)
    return out


def service_levels(reports: DataFrame, now: Column, drift_limit: float, freshness_hours: float, least: dict[str, float] = SLO_LEAST, most: dict[str, float] = SLO_MOST) -> DataFrame:
    """reports (metrics, drift_score, last_updated) with one boolean per level, age and status."""
    age = (F.unix_micros(now) - F.unix_micros("last_updated")) / 3.6e9
    met = {f"{m}_met": F.col(m) >= v for m, v in least.items()} | {f"{m}_met": F.col(m) <= v for m, v in most.items()}
    met |= {"drift_met": F.col("drift_score") <= drift_limit, "freshness_met": age <= freshness_hours}
    every = F.lit(True)
    for c in met.values():
        every = every & c
    return reports.withColumns({**met, "freshness_hours": F.round(age, 2), "status": F.when(every, "healthy").otherwise("degraded")})


def guard(question: Column, labels: list[str] = NODE_LABELS) -> Column:
    """struct<status, reason, label, entity, needs_review>: what a question may run.

    A count question names a registered label (in any case; another one is escalated).
    """
    text = F.lower(strip(F.coalesce(question, F.lit(""))))
    unsafe = F.lit(False)
    for word in UNSAFE:
        unsafe = unsafe | F.contains(text, F.lit(word))
    asked = F.regexp_extract(text, r"count\s+(\w+)", 1)
    label = F.try_element_at(F.filter(F.array(*map(F.lit, labels)), lambda x: F.lower(x) == asked), F.lit(1))
    entity = strip(F.regexp_extract(text, r"mentions?\s+([a-zA-Z0-9_\-\s]+)", 1))
    none = F.lit(None).cast("string")
    out = lambda status, reason, a=none, b=none: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"), a.alias("label"), b.alias("entity"), F.lit(status != "safe").alias("needs_review"))
    return (
        F.when(text == "", out("blocked", "empty_question"))
        .when(unsafe, out("blocked", "unsafe_intent_detected"))
        .when(label.isNotNull(), out("safe", "allowlisted_count_template", label))
        .when(entity != "", out("safe", "allowlisted_mentions_template", none, entity))
        .otherwise(out("escalate", "ambiguous_query"))
    )


def guarded_counts(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Safe count questions with their answer. decisions: query_id, d (from guard)."""
    asked = decisions.filter("d.reason = 'allowlisted_count_template'").select("query_id", "d.label")
    counts = nodes.groupBy("label").agg(F.count("*").alias("n"))
    return asked.join(counts, "label", "left").select("query_id", "label", F.coalesce("n", F.lit(0)).alias("n"))


def guarded_mentions(decisions: DataFrame, mentions: DataFrame, most: int = GUARD_ROWS) -> DataFrame:
    """Safe mention questions: at most `most` (chunk_id, name) whose name holds the asked entity.

    Distinct entities meet distinct names; each entity's first rows are cut once for all its questions.
    """
    asked = decisions.filter("d.reason = 'allowlisted_mentions_template'").select("query_id", F.lower("d.entity").alias("entity"))
    names = mentions.select("name").distinct()
    held = names.join(asked.select("entity").distinct(), F.contains(F.lower("name"), F.col("entity")))
    hits = mentions.select("chunk_id", "name").distinct().join(held, "name")
    rank = F.row_number().over(Window.partitionBy("entity").orderBy("chunk_id", "name"))
    first = hits.withColumn("rank", rank).filter(F.col("rank") <= most)
    return asked.join(first, "entity").select("query_id", "chunk_id", "name", "rank")


def audit_rows(questions: DataFrame, now: Column) -> DataFrame:
    """tenant_id, request_id, question, decision, timestamp_utc for the append-only log."""
    return questions.select("tenant_id", "request_id", F.col("text").alias("question"), guard(F.col("text")).alias("decision"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp_utc"))
