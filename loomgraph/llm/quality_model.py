"""Operator 2, quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A logistic model of a document's shape (character classes, word lengths, repetition) gives a
log-likelihood ratio of good against poor. Documents are grouped by host and by path within
the host; the groups' rates of good documents are estimated by shrinkage: a host's towards
the global rate, a path's towards its host's, each with a prior weight fitted to the spread
of the rates over all groups by moments. A document's own evidence is left out of its groups'
rates (it is already in the ratio). The posterior combines the ratio with the path's rate;
documents below `CUT` are rejected.

`fit` reads at most `TRAIN_ROWS` labelled documents (those whose ids hash lowest); rates and
prior weights cover all documents.

Defined results: a null or empty text has the features of an empty one; null hosts and paths
form a group of their own; repeated rows count each time; without labels of both kinds the
model gives every document a ratio of 1 and the global rate 0.5, and all are kept; an empty
table gives an empty table; other columns of any name but ADDED pass through `classify` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import quality_rules
from loomgraph.llm.common import buffers, materialize, numbered, picked, range_hashes, slices, words

TRAIN_ROWS = 20_000
#: Least posterior of a kept document.
CUT = 0.5
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>@^~_=+\\", "bar": b"|", "shout": b"!?", "stop": b".,;:"}
_CLASS = {name: np.isin(np.arange(256), list(chars)) for name, chars in _CLASSES.items()} | {"wide": np.arange(256) >= 0x80}
FEATURES = [*_CLASS, "length", "word_length", "distinct_words", "symbol_words", "upper_words", "dup_lines", "repeats", "dup_5"]


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text, all within small ranges."""
    n = len(at) - 1
    size = np.diff(at)
    filled = size > 0
    out = []
    for chosen in _CLASS.values():
        counts = np.zeros(n, np.int64)
        if filled.any():
            counts[filled] = np.add.reduceat(chosen[data], at[:-1][filled], dtype=np.int64)
        out.append(counts / np.maximum(size, 1))
    found = quality_rules.measure(data, at)
    n_words, chars = np.maximum(found["n_words"], 1), np.maximum(found["word_chars"], 1)
    starts, ends, row = words(data, at)
    # The row above 44 bits of the word's hash: one sort gives each row's distinct words.
    keys = np.sort((row.astype(np.uint64) << np.uint64(44)) | (range_hashes(data, starts, ends, fold=True) >> np.uint64(20)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[new] >> np.uint64(44)).astype(np.int64), minlength=n)
    last = data[ends - 1] if len(ends) else data[:0]
    share = lambda mask: np.bincount(row[mask], minlength=n) / n_words
    out += [
        np.log1p(found["n_words"]) / 10,
        found["word_chars"] / n_words / 10,
        np.log1p(distinct) / np.log1p(n_words),
        share(_CLASS["symbol"][last]),
        share(_CLASS["upper"][last] | _CLASS["shout"][last]),
        found["dup_line_chars"] / chars,
        found["n_repeat_words"] / n_words,
        found["dup_chars_5"] / chars,
    ]
    return np.stack(out, axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the intercept
    rate: float  # of good documents among the training rows

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of good against poor."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[:-1] + self.weights[-1] - math.log(self.rate / (1 - self.rate)), -30, 30)


def fit_arrays(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Ridge logistic regression by Newton's method."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES) + 1), 0.5)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, w, float(y.mean()))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, y and the features of at most `most` labelled documents."""
    chosen = picked(labels, doc_id=id_col, y=label_col).dropna().dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = picked(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")

    def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(*buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(part.column("y").to_numpy().astype(float)), *(pa.array(c) for c in x.T)], ["doc_id", "y", *FEATURES])

    return rows.mapInArrow(described, "doc_id bigint, y double, " + ", ".join(f"{c} double" for c in FEATURES)).limit(most)


def fit(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    rows = np.array(sorted(map(tuple, training_rows(docs, labels, **columns).collect())), float).reshape(-1, len(FEATURES) + 2)
    return fit_arrays(rows[:, 2:], (rows[:, 1] > 0).astype(float))


def with_ratio(docs: DataFrame, model: Model, text_col: str = "text", ratio_col: str = "_ratio") -> DataFrame:
    """docs and each document's log-likelihood ratio."""
    from pyspark.sql.types import DoubleType, StructType

    def rated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                x = features(*buffers(part.column(part.schema.get_field_index(text_col))))
                yield part.append_column(ratio_col, pa.array(model.ratio(x), pa.float64()))

    return docs.mapInArrow(rated, StructType([*docs.schema.fields]).add(ratio_col, DoubleType()))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _prior_weight(groups: DataFrame, n: str, total: str, around: Column, rate: float) -> float:
    """The beta prior's weight whose spread matches that of the groups' rates, by moments.

    Between-group variance: the weighted mean square of (rate - around) less what sampling adds.
    """
    row = groups.agg(
        F.sum(F.col(n) * F.pow(F.col(total) / F.col(n) - around, 2)).alias("square"),
        F.sum(n).alias("rows"),
        F.count("*").alias("groups"),
    ).collect()[0]
    if not row["rows"]:
        return 1.0
    sampling = rate * (1 - rate) * row["groups"] / row["rows"]
    between = max(row["square"] / row["rows"] - sampling, 1e-6)
    return float(min(max(rate * (1 - rate) / between - 1, 1.0), 1e6))


def site_rates(rated: DataFrame, rate0: float) -> tuple[DataFrame, dict[str, float]]:
    """_host, _path and their counts and sums of good documents; the global rate and prior weights.

    rated: _host, _path, _ratio of all documents.
    """
    p = 1 / (1 + F.exp(-(F.col("_ratio") + math.log(rate0 / (1 - rate0)))))
    # Written: all below reads these sums, not the texts.
    paths = materialize(rated.groupBy("_host", "_path").agg(F.count("*").cast("double").alias("n_path"), F.sum(p).alias("good_path")))
    hosts = paths.groupBy("_host").agg(F.sum("n_path").alias("n_host"), F.sum("good_path").alias("good_host"))
    both = paths.join(hosts, "_host")
    total = hosts.agg(F.sum("n_host").alias("n"), F.sum("good_host").alias("good")).collect()[0]
    rate = min(max((total["good"] or 0.0) / total["n"], 1e-3), 1 - 1e-3) if total["n"] else rate0
    k_host = _prior_weight(hosts, "n_host", "good_host", F.lit(rate), rate)
    k_path = _prior_weight(both, "n_path", "good_path", F.col("good_host") / F.col("n_host"), rate)
    return both, {"rate": rate, "k_host": k_host, "k_path": k_path}


#: The columns that `classify` adds.
ADDED = ("log_ratio", "host_rate", "path_rate", "p_quality", "kept")


def classify(docs: DataFrame, model: Model, host_col: str = "source", path_cols: tuple[str, ...] = ("source", "lang"), text_col: str = "text", cut: float = CUT) -> DataFrame:
    """docs with log_ratio, host_rate, path_rate, p_quality and kept, which replace columns of their names.

    Two passes over the texts: one sums each path's documents, which are few rows and are written;
    the other judges each document by them.
    """
    rows, at = numbered(docs)
    site = lambda c: F.coalesce(F.col(at[c]).cast("string"), F.lit("\0"))
    host, path = site(host_col).alias("_host"), F.concat_ws("/", *[site(c) for c in path_cols]).alias("_path")
    first = with_ratio(rows.select(host, path, F.col(at[text_col]).alias("text")), model)
    rates, prior = site_rates(first.select("_host", "_path", "_ratio"), model.rate)
    own = 1 / (1 + F.exp(-(F.col("_ratio") + math.log(model.rate / (1 - model.rate)))))
    host_rate = (F.col("good_host") - own + prior["k_host"] * prior["rate"]) / (F.col("n_host") - 1 + prior["k_host"])
    path_rate = (F.col("good_path") - own + prior["k_path"] * F.col("host_rate")) / (F.col("n_path") - 1 + prior["k_path"])
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    out = with_ratio(rows.select("*", host, path), model, at[text_col]).join(rates, ["_host", "_path"])
    out = out.withColumn("host_rate", inside(host_rate)).withColumn("path_rate", inside(path_rate))
    out = out.withColumn("p_quality", 1 / (1 + F.exp(-(F.col("_ratio") + _logit(F.col("path_rate"))))))
    out = out.withColumn("kept", F.col("p_quality") >= cut).withColumnRenamed("_ratio", "log_ratio")
    return out.select(*[F.col(new).alias(old) for old, new in at.items() if old not in ADDED], *ADDED)
