"""Operator 4, mixing sources to target weights by iterative proportional fitting.

All documents' tokens are summed by source, language and topic. The cell sums are raked:
scaled to one margin's target weights after the other, until all three hold (as far as the
filled cells allow). A cell's sampling rate is proportional to raked over observed tokens; the
rates are scaled together so that the expected sample has the wanted share of all tokens, no
rate above 1. A document is sampled if a uniform number from a hash of its id and text is
below its cell's rate, which needs no state and gives repeated rows the same answer.

The topic is the one of `topics` most of whose terms a text has (ties: the first by name; no
term: "none"). Given targets name categories of their margins; all others count as "(other)".
Without given targets every category has its own: its observed share to a power. Up to
`IN_MEMORY` cells are raked as arrays, more by the same steps in Spark.

Defined results: null sources, languages and texts count as empty strings (an empty text has
0 tokens and its cell's rate); a null id is hashed as null; cells without tokens have rate 1;
an empty table gives an empty table; `mix` keeps other columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from loomgraph.llm.common import buffers, drop_tables, materialize, numbered, range_hashes, scratch_paths, slices, words

OTHER = "(other)"
MARGINS = ("source", "lang", "topic")
#: Cells that are raked on the driver; more are raked in Spark.
IN_MEMORY = 50_000
#: Rounds of raking at most, and the largest miss of a margin that ends it.
ROUNDS, TOLERANCE = 1000, 1e-10
#: Topics and their terms.
TOPICS = {
    "reference": ["this", "that", "these", "those", "it", "celui", "ceci", "esto", "ese", "dies", "jene"],
    "relation": ["of", "by", "with", "from", "for", "de", "avec", "pour", "par", "con", "para", "von", "mit", "für"],
    "state": ["is", "are", "was", "be", "been", "est", "sont", "es", "ser", "ist", "sind", "war"],
}
Targets = Mapping[str, Mapping[str, float]]


def with_topic(docs: DataFrame, topics: Mapping[str, list[str]] = TOPICS, text_col: str = "text") -> DataFrame:
    """docs with _topic and _tokens (words)."""
    names = sorted(topics)
    terms = {t.encode().lower(): i for i, name in reversed(list(enumerate(names))) for t in topics[name]}
    text = b"".join(terms)
    ends = np.cumsum([len(t) for t in terms])
    keys = range_hashes(np.frombuffer(text, np.uint8), ends - [len(t) for t in terms], ends, fold=True)
    order = np.argsort(keys)
    keys, topic_of = keys[order], np.array(list(terms.values()))[order]

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                data, at = buffers(part.column(part.schema.get_field_index(text_col)))
                starts, ends, row = words(data, at)
                h = range_hashes(data, starts, ends, fold=True)
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[place] == h
                counts = np.bincount(row[hit] * len(names) + topic_of[place[hit]], minlength=part.num_rows * len(names)).reshape(part.num_rows, -1)
                topic = [names[k] if c else "none" for k, c in zip(counts.argmax(axis=1), counts.max(axis=1), strict=True)]
                tokens = np.bincount(row, minlength=part.num_rows)
                yield part.append_column("_topic", pa.array(topic, pa.string())).append_column("_tokens", pa.array(tokens, pa.int64()))

    return docs.mapInArrow(told, StructType([*docs.schema.fields]).add("_topic", StringType()).add("_tokens", LongType()))


def _categories(rows: DataFrame, source_col: str, lang_col: str) -> DataFrame:
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return rows.withColumns({"_source": name(source_col), "_lang": name(lang_col)})


def observed(rows: DataFrame) -> DataFrame:
    """_source, _lang, _topic and their tokens."""
    return rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens"))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """category, target: each category's observed share of the tokens to a power."""
    own = cells.groupBy(F.col(f"_{margin}").alias("category")).agg(F.sum("tokens").cast("double").alias("t")).filter("t > 0")
    total = own.agg(F.sum("t").alias("total"))
    return own.crossJoin(F.broadcast(total)).select("category", F.pow(F.col("t") / F.col("total"), F.lit(power)).alias("target"))


def named(rows: DataFrame, targets: Targets) -> DataFrame:
    """Categories that the targets do not name become OTHER."""
    return rows.withColumns({f"_{m}": F.when(F.col(f"_{m}").isin([k for k in targets[m] if k != OTHER]), F.col(f"_{m}")).otherwise(OTHER) for m in MARGINS})


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The array scaled along each axis in turn to the axis's target shares (of the categories it has)."""
    return _rake_cells(tokens.ravel(), [x.ravel() for x in np.indices(tokens.shape)], targets, rounds, tolerance).reshape(tokens.shape)


def _rake_cells(tokens: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """rake of cells with their places on each axis; cells that are not there are empty."""
    out = tokens / tokens.sum() if tokens.sum() else tokens.astype(float)
    for _ in range(rounds):
        worst = 0.0
        for at, target in zip(places, targets, strict=True):
            have = np.bincount(at, out, len(target)).astype(float)
            want = np.where(have > 0, target, 0.0)
            want = want / want.sum() if want.sum() else want
            worst = max(worst, float(np.abs(have - want).max(initial=0)))
            out = out * np.divide(want, have, out=np.zeros_like(have), where=have > 0)[at]
        if worst < tolerance:
            break
    return out


def rates(cells: Mapping[tuple[str, str, str], float], targets: Targets, share: float) -> dict[tuple[str, str, str], float]:
    """Sampling rate of each cell: proportional to raked over observed, `share` of all tokens in all."""
    keys = sorted(cells)
    tokens = np.array([cells[k] for k in keys], float)
    axes = [{c: i for i, c in enumerate(sorted({k[axis] for k in keys}))} for axis in range(3)]
    places = [np.array([axes[axis][k[axis]] for k in keys], np.int64) for axis in range(3)]
    goal = [np.array([targets[m].get(c, 0.0) for c in own], float) for m, own in zip(MARGINS, axes, strict=True)]
    ratio = np.divide(_rake_cells(tokens, places, goal), tokens / max(tokens.sum(), 1), out=np.zeros_like(tokens), where=tokens > 0)
    scale = _scale(lambda scales: [float((np.minimum(1, x * ratio) * tokens).sum()) for x in scales], share * tokens[ratio > 0].sum())
    found = np.where(tokens > 0, np.minimum(1, scale * ratio), 1.0)
    return dict(zip(keys, found.tolist(), strict=True))


def _scale(sampled: Callable[[list[float]], list[float]], want: float) -> float:
    """The factor of all ratios at which the expected sample has the wanted tokens."""
    low, high = 0.0, 1.0
    while high < 2**60 and sampled([high])[0] < want:
        high *= 2
    for _ in range(20):  # each step leaves one of 32 parts
        scales = [low + (high - low) * i / 32 for i in range(1, 32)]
        under = sum(n < want for n in sampled(scales))
        low, high = [low, *scales][under], [*scales, high][under]
    return high


def rates_in_spark(cells: DataFrame, targets: Mapping[str, DataFrame], share: float) -> DataFrame:
    """What `rates` gives, for cells and targets (category, target) of any number: _source, _lang, _topic, _rate."""
    filled = cells.filter("tokens > 0")
    total = filled.agg(F.sum("tokens")).collect()[0][0] or 1
    x = materialize(filled.withColumn("x", F.col("tokens") / F.lit(float(total))))
    for _ in range(ROUNDS):
        worst, before, factors = 0.0, x, []
        for margin in MARGINS:
            have = x.groupBy(F.col(f"_{margin}").alias("category")).agg(F.sum("x").alias("have"))
            want = have.join(targets[margin], "category", "left").withColumn("want", F.when(F.col("have") > 0, F.coalesce("target", F.lit(0.0))).otherwise(0.0))
            want = materialize(want.select("category", "have", "want"))
            all_of = want.agg(F.sum("want")).collect()[0][0] or 1.0
            part = F.col("want") / F.lit(all_of)
            worst = max(worst, want.agg(F.max(F.abs(F.col("have") - part))).collect()[0][0] or 0.0)
            factor = want.select(F.col("category").alias(f"_{margin}"), F.when(F.col("have") > 0, part / F.col("have")).otherwise(0.0).alias("factor"))
            x = x.join(factor, f"_{margin}").withColumn("x", F.col("x") * F.col("factor")).drop("factor")
            factors.append(want)
        x = materialize(x)
        drop_tables(cells.sparkSession, [p for t in (before, *factors) for p in scratch_paths(t)])
        if worst < TOLERANCE:
            break
    ratio = x.withColumn("ratio", F.col("x") * float(total) / F.col("tokens"))
    least = lambda s: F.least(F.lit(1.0), F.col("ratio") * F.lit(float(s)))
    sampled = lambda scales: [n or 0.0 for n in ratio.agg(*[F.sum(least(s) * F.col("tokens")) for s in scales]).collect()[0]]
    scale = _scale(sampled, share * (ratio.filter("ratio > 0").agg(F.sum("tokens")).collect()[0][0] or 0))
    names = [f"_{m}" for m in MARGINS]
    return ratio.select(*names, least(scale).alias("_rate")).union(cells.filter("NOT coalesce(tokens, 0) > 0").select(*names, F.lit(1.0)))


#: The columns that `calibrated` adds.
OWN = ("_source", "_lang", "_topic", "_tokens", "_rate", "_kept")


def _calibrated(rows: DataFrame, at: Mapping[str, str], targets: Targets | None = None, topics: Mapping[str, list[str]] = TOPICS, share: float = 0.5, power: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = 1) -> DataFrame:
    """The numbered rows and OWN."""
    spark = rows.sparkSession
    ident, text, source, lang = (at[c] for c in (id_col, text_col, source_col, lang_col))
    cells = observed(_categories(with_topic(rows.select(*dict.fromkeys([source, lang, text])), topics, text), source, lang))
    rows = _categories(with_topic(rows, topics, text), source, lang)
    if targets:
        rows = named(rows, targets)
        cells = observed(named(cells, targets).withColumnRenamed("tokens", "_tokens"))
    cells = materialize(cells)
    names = [f"_{m}" for m in MARGINS]
    if cells.count() <= IN_MEMORY:
        summed = {(r._source, r._lang, r._topic): float(r.tokens or 0) for r in cells.collect()}
        goals = targets or {m: {r.category: r.target for r in tempered(cells, m, power).collect()} for m in MARGINS}
        table = spark.createDataFrame([(*k, v) for k, v in rates(summed, goals, share).items()], ", ".join(f"{n} string" for n in names) + ", _rate double")
        # At most IN_MEMORY rows, so it is broadcast.
        table = F.broadcast(table)
    else:
        goals = {m: spark.createDataFrame(list(targets[m].items()), "category string, target double") if targets else materialize(tempered(cells, m, power)) for m in MARGINS}
        table = materialize(rates_in_spark(cells, goals, share))
    out = rows.join(table, names, "left")
    number = F.xxhash64(F.lit(seed), F.col(ident), F.col(text)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return out.withColumn("_kept", number < F.coalesce("_rate", F.lit(1.0)))


def calibrated(docs: DataFrame, **options) -> DataFrame:
    """docs with _source, _lang, _topic, _tokens, _rate and _kept, which replace columns of their names."""
    rows, at = numbered(docs)
    return _calibrated(rows, at, **options).select(*[F.col(new).alias(old) for old, new in at.items() if old not in OWN], *OWN)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, with their own columns."""
    rows, at = numbered(docs)
    return _calibrated(rows, at, **options).filter("_kept").select(*[F.col(new).alias(old) for old, new in at.items()])
