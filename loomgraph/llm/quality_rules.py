"""Operator 1, quality rules: repetition coverage by rolling hashes in numpy.

Words are the runs of bytes other than space, \\t, \\n, \\v, \\f and \\r. For each n of `NGRAMS`
the operator marks the words inside n-word windows that occur twice or more in the text and
sums the code points of the marked words; for lines it sums the code points of the words on
lines that equal another line of the text. A text passes when each share of its word
characters is within its limit.

Defined results: a null or blank text has zeros and fails (too few words); a row is judged
by itself, so repeated rows give repeated results and a null id stays null; a text of any
length is read whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import buffers, mix, picked, range_hashes, slices, window_hashes, words

#: Words in a window, and the most per cent of word characters inside repeated windows.
NGRAMS = {5: 45, 8: 30, 10: 25}
#: The most per cent of word characters on lines that occur more than once.
LINE_LIMIT = 30
MIN_WORDS = 20
BASE_NGRAM, BASE_LIMIT = 8, 30
#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
_IS_POINT = (np.arange(256) & 0xC0) != 0x80

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup_chars_{n}" for n in NGRAMS)]
SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COLUMNS)


def _in_repeats(values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    ordered = np.sort(values)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(again, values), len(again) - 1)
    return again[at] == values


def _covered(h: np.ndarray, row: np.ndarray, salt: np.ndarray, n: int, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Words inside repeated n-word windows of their row; and the windows' starts.

    among: only these starts can begin a repeated window, as a shorter one repeats there.
    """
    own = window_hashes(h, n)
    starts = np.flatnonzero(row[: len(own)] == row[n - 1 : n - 1 + len(own)]) if among is None else among[among < len(own)]
    starts = starts[row[starts] == row[starts + n - 1]]
    starts = starts[_in_repeats(mix(own[starts] ^ salt[row[starts]]))]
    edges = np.zeros(len(h) + 1, np.int64)
    edges[starts] += 1
    edges[starts + n] -= 1  # starts are distinct, so are starts + n
    return np.cumsum(edges[:-1]) > 0, starts


def measure(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of a text buffer."""
    n_rows = len(at) - 1
    total = lambda row, value=None: np.bincount(row, value, n_rows).astype(np.int64)
    starts, ends, row = words(data, at)
    salt = mix(np.arange(1, n_rows + 1, dtype=np.uint64))
    points = np.concatenate([[0], np.cumsum(_IS_POINT[data])])
    chars = points[ends] - points[starts]
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])
    out = {"n_words": total(row), "word_chars": total(row, chars), "n_symbols": symbols[at[1:]] - symbols[at[:-1]]}

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([at[:-1], breaks + 1]))  # a break at a row's end opens an empty line there
    line_ends = np.sort(np.concatenate([at[1:], breaks]))
    before = np.searchsorted(starts, line_starts)
    after = np.searchsorted(starts, line_ends)
    full = after > before
    before, after = before[full], after[full]
    line_row = row[before] if len(before) else np.zeros(0, np.int64)
    word_sum = np.concatenate([[0], np.cumsum(chars)])
    line_chars = word_sum[after] - word_sum[before]
    key = mix(range_hashes(data, line_starts[full], line_ends[full]) ^ salt[line_row])
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = total(line_row, same)
    out["dup_line_chars"] = total(line_row, line_chars * _in_repeats(key))

    h = range_hashes(data, starts, ends)
    among = None
    for n in sorted({*NGRAMS, BASE_NGRAM}):
        marked, among = _covered(h, row, salt, n, among)
        if n == BASE_NGRAM:
            out["n_repeat_words"] = total(row, marked)
        if n in NGRAMS:
            out[f"dup_chars_{n}"] = total(row, chars * marked)
    return out


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = measure(*buffers(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in COLUMNS)], ["doc_id", *COLUMNS])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts, base_failed, kept."""
    counted = picked(docs, doc_id=id_col, text=text_col).mapInArrow(_measured, SCHEMA)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_LIMIT * F.col("n_words"))
    fits = 100 * F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")
    for n, limit in NGRAMS.items():
        fits &= 100 * F.col(f"dup_chars_{n}") <= limit * F.col("word_chars")
    return counted.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & fits)
