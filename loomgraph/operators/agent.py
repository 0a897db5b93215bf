"""Question answering in batches: plan, retrieve, reason, verify, one retry; a row per question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip, token_set
from loomgraph.operators.graph import top_per
from loomgraph.operators.routing import route

# Words that no sub-question is about.
STOP_WORDS = ["what", "how", "why", "when", "where", "which", "does", "portfolio", "about", "with", "into"]
MOST_SUBQUESTIONS, MOST_FOCUS, MOST_CONTEXT = 3, 4, 5
LEAST_OVERLAP = 0.25
NO_CONTEXT = "I could not find supporting context for that question yet."


def focus_terms(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    return F.array_except(token_set(text), F.array(*map(F.lit, stop_words)))


def sub_questions(text: Column, subject: str = "Corpus", stop_words: list[str] = STOP_WORDS) -> Column:
    """The question, what its focus terms are about, and its method if it asks how or why."""
    focus = focus_terms(text, stop_words)
    none = F.lit(None).cast("string")
    about = F.when(F.size(focus) > 0, F.concat(F.lit(f"{subject} details on "), F.array_join(F.slice(focus, 1, MOST_FOCUS), " "))).otherwise(none)
    method = F.when(F.lower(text).rlike("how|why"), F.concat(F.lit("methodology evidence for: "), text)).otherwise(none)
    given = F.filter(F.transform(F.array_compact(F.array(text, about, method)), strip), lambda q: q != "")
    new = F.filter(given, lambda q, i: ~F.exists(F.slice(given, 1, i), lambda p: F.lower(p) == F.lower(q)))
    return F.slice(new, 1, MOST_SUBQUESTIONS)


def plan(questions: DataFrame, subject: str = "Corpus") -> DataFrame:
    """question_id, query_id, text: a row per sub-question."""
    rows = questions.select(F.col("query_id").alias("question_id"), F.posexplode(sub_questions(F.col("text"), subject)).alias("part", "text"))
    return rows.select("question_id", F.concat_ws("/", "question_id", "part").alias("query_id"), "part", "text")


def merge_context(hits: DataFrame) -> DataFrame:
    """question_id, context: the best score of each chunk, the best chunks first."""
    best = top_per(hits.withColumn("_key", F.concat_ws("\0", "question_id", "chunk_id")), "_key", 1, F.desc("score"), "part").drop("rank", "_key")
    kept = top_per(best, "question_id", MOST_CONTEXT, F.desc("score"), "chunk_id")
    item = F.struct("rank", "chunk_id", "relative_path", "section", "content", "score", "entities", "neighbours", "chunk_index", "line_start", "line_end")
    return kept.groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("context"))


def draft(question: Column, context: Column) -> Column:
    """The template answer over the context."""
    top = F.try_element_at(context, F.lit(1))
    entities = F.array_join(F.slice(top["entities"], 1, 5), ", ")
    sections = F.slice(F.filter(F.transform(context, lambda c: F.coalesce(strip(c["section"]), F.lit(""))), lambda s: s != ""), 1, 3)
    answer = F.concat(F.lit("For '"), question, F.lit("', retrieved evidence indicates key concepts: "), F.when(entities == "", "no explicit entities").otherwise(entities), F.lit(". Primary source is "), top["relative_path"], F.lit("."))
    more = F.when(F.size(sections) > 0, F.concat(F.lit(" Relevant sections include: "), F.array_join(sections, ", "), F.lit("."))).otherwise("")
    return F.when(F.size(context) == 0, NO_CONTEXT).otherwise(F.concat(answer, more))


def supported(answer: Column, context: Column) -> Column:
    """The answer's tokens overlap with the evidence enough, and there is evidence."""
    parts = F.flatten(F.transform(context, lambda c: F.concat(F.array(c["content"], F.coalesce(c["section"], F.lit(""))), c["entities"])))
    said, seen = token_set(answer), token_set(F.array_join(parts, "\n"))
    overlap = F.size(F.array_intersect(said, seen)) / F.greatest(F.lit(1), F.size(said))
    return (F.size(context) > 0) & (answer != "") & (overlap >= LEAST_OVERLAP)


Retriever = Callable[[DataFrame], DataFrame]


def answer(questions: DataFrame, retriever: Retriever, generator: Callable[[Column, Column], Column] = draft, adaptive: bool = True, retry: bool = True, subject: str = "Corpus") -> DataFrame:
    """query_id, text, sub_questions, context, answer, citations, attempts, verified for each question.

    retriever: questions (query_id, text, mode) -> ranked hits with content. generator: a column
    expression or a pandas_udf of (question, context), marked asNondeterministic if it can say
    something else the second time. An answer that fails its check is generated once more, for
    which a verified row passes nulls, and checked again; without retry it becomes a caution.
    """
    parts = plan(questions, subject)
    asked = route(parts) if adaptive else parts.withColumn("mode", F.lit("hybrid_rerank"))
    hits = retriever(asked).join(parts.select("query_id", "question_id", "part"), "query_id")
    none = F.array().cast("array<struct<rank:int,chunk_id:string,relative_path:string,section:string,content:string,score:double,entities:array<string>,neighbours:array<string>,chunk_index:int,line_start:int,line_end:int>>")
    rows = questions.join(merge_context(hits).withColumnRenamed("question_id", "query_id"), "query_id", "left")
    rows = rows.withColumn("context", F.coalesce("context", none)).withColumn("sub_questions", sub_questions(F.col("text"), subject))
    rows = rows.withColumn("answer", generator(F.col("text"), F.col("context")))
    rows = rows.withColumn("verified", supported(F.col("answer"), F.col("context")))
    if not retry:
        caution = F.lit("The retrieved sources do not support a confident answer.")
        rows = rows.withColumn("answer", F.when(F.col("verified") | (F.size("context") == 0), F.col("answer")).otherwise(caution))
        rows = rows.withColumn("attempts", F.lit(1))
    else:
        failed = ~F.coalesce("verified", F.lit(False))
        again = generator(F.when(failed, F.col("text")), F.when(failed, F.col("context")))
        rows = rows.withColumn("attempts", F.when(failed, 2).otherwise(1)).withColumn("answer", F.when(failed, again).otherwise(F.col("answer")))
        rows = rows.withColumn("verified", supported(F.col("answer"), F.col("context")))
    return rows.withColumn("citations", citations(F.col("context"))).select("query_id", "text", "sub_questions", "context", "answer", "citations", "attempts", "verified")


def citations(context: Column) -> Column:
    """array<struct>: the place of each piece of evidence, in its order."""
    fields = ["chunk_id", "relative_path", "chunk_index", "section", "line_start", "line_end", "score"]
    return F.transform(context, lambda c: F.struct(*[c[f].alias(f) for f in fields], c["entities"].alias("matched_entities"), c["neighbours"].alias("graph_neighbours")))


def insights(answers: DataFrame) -> DataFrame:
    """query_id, support, n_citations, sources, entities of answered questions, for display."""
    distinct = lambda c: F.array_sort(F.array_distinct(c))
    return answers.select(
        "query_id",
        support_status(F.col("verified"), F.size("citations")).alias("support"),
        F.size("citations").alias("n_citations"),
        distinct(F.transform("citations", lambda c: c["relative_path"])).alias("sources"),
        distinct(F.flatten(F.transform("citations", lambda c: c["matched_entities"]))).alias("entities"),
    )


def context_preview(context: Column, most: int = 5, chars: int = 500) -> Column:
    """Numbered evidence lines for a generator's prompt."""
    line = lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] source="), c["relative_path"], F.lit(" section="), F.coalesce(F.nullif(strip(c["section"]), F.lit("")), F.nullif(c["chunk_id"], F.lit("")), c["relative_path"]), F.lit(" evidence="), F.substring(strip(F.regexp_replace(c["content"], "(?U)\\s+", " ")), 1, chars))
    return F.array_join(F.transform(F.slice(context, 1, most), line), "\n")


def is_definition(question: Column) -> Column:
    return F.lower(strip(question)).rlike(r"^what\s+is\s+|^define\s+|^what\s+does\s+.*\s+mean\??$|^meaning\s+of\s+")


def support_status(verified: Column, citations: Column) -> Column:
    return F.when(verified & (citations > 0), "Strong source support").when(citations > 0, "Partial source support").otherwise("Limited source support")
