"""Text as columns: tokens, set ratios, claims, hash embeddings. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.embedding import embedding

#: Fixed value: a token of questions, contexts and answers.
TOKEN = "[A-Za-z][A-Za-z0-9_-]{2,}"
#: Most distinct tokens that a question searches with.
QUESTION_TOKENS = 12
#: Claims split after sentence marks and at line breaks.
CLAIM_BREAK = "[.!?]\\s+|\\n+"


def strip(c: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def tokens(c: Column) -> Column:
    """All tokens of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def question_tokens(c: Column, most: int = QUESTION_TOKENS) -> Column:
    """The first distinct tokens of a question."""
    return F.slice(token_set(c), 1, most)


def n_contained(terms: Column, text: Column) -> Column:
    """How many of the terms are substrings of the lower-cased text."""
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t)))


def trigrams(c: Column) -> Column:
    """The distinct trigrams of a text; none of less than three characters."""
    found = F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))
    return F.array_distinct(F.coalesce(F.when(F.length(c) >= 3, found), F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def coverage(expected: Column, observed: Column) -> Column:
    """The part of `expected` that is in `observed`; 0 if either is empty."""
    none = (F.size(expected) == 0) | (F.size(observed) == 0)
    return F.when(none, 0.0).otherwise(F.size(F.array_intersect(expected, observed)) / F.size(expected))


def claims(c: Column) -> Column:
    """Sentences and lines of at least three tokens, stripped."""
    parts = F.transform(F.split(c, CLAIM_BREAK), strip)
    return F.filter(parts, lambda p: F.size(tokens(p)) >= 3)


def slug(c: Column) -> Column:
    return F.regexp_replace(strip(c), "[^A-Za-z0-9_]", "_")


def safe_name(c: Column) -> Column:
    kept = F.regexp_replace(c, "[^A-Za-z0-9_]", "")
    return F.when(kept == "", "Entity").otherwise(kept)


def embedding_cells(rows: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """key, idx, value (a signed count), norm: the non-zero cells of each row's hash embedding.

    A row's cells are counted inside the row, so nothing is shuffled.
    """
    own = rows.select(key, embedding(F.lower(text), TOKEN, max(8, dim)).alias("_e"))
    return own.select(key, F.col("_e.norm").alias("norm"), F.inline("_e.cells")).select(key, "idx", "value", "norm")
