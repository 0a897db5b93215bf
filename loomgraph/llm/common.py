"""Shared helpers of the training-data operators: scratch tables and text buffers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space, \t, \n, \v, \f, \r.
SPACES = b" \t\n\x0b\x0c\r"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends there."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def scratch_paths(df: DataFrame) -> list[str]:
    """The folders that a materialized frame reads."""
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})


class Scratch:
    """Scratch tables of one job in the shared folder, and what removes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        out = materialize(df, compression)
        self.paths += scratch_paths(out)
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove the tables that df reads."""
        gone = scratch_paths(df)
        drop_tables(self.spark, gone)
        self.paths = [p for p in self.paths if p not in gone]

    def only(self, last: DataFrame, *others: DataFrame) -> DataFrame:
        """`last`, with all tables removed but what it and the others read."""
        wanted = {p for df in (last, *others) for p in scratch_paths(df)}
        drop_tables(self.spark, [p for p in self.paths if p not in wanted])
        self.paths = sorted(wanted)
        self.forget_shuffles()
        return last

    def clear(self) -> None:
        """Remove all tables: nothing reads them any more."""
        drop_tables(self.spark, self.paths)
        self.paths = []

    def forget_shuffles(self) -> None:
        """Let Spark remove the shuffle files of steps that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def picked(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra ones can't clash."""
    return docs.select(*[docs[old].alias(new) for new, old in columns.items()])


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ... and the new name of each old one: an operator's own columns can't clash with them."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*at.values()), at


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string or binary column; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about `most` bytes of text each (one long row may be more)."""
    column = batch.column(batch.schema.get_field_index(text))
    _, at = buffers(column)
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield batch.slice(start, min(end, n) - start)
        start = end


# Polynomial hashes of byte ranges modulo two primes below 2^31, by prefix sums. (A polynomial modulo
# 2^64 has known collisions: Thue-Morse sequences of 1,024 or more.)
_LOW = np.uint64((1 << 31) - 1)
_SHIFT = np.uint64(31)
#: Each prime is 2^31 - c.
_PRIMES = {1: (1 << 31) - 1, 19: (1 << 31) - 19}
_BASES = {1: 1_391_873_917, 19: 1_103_515_193}
_powers: dict[tuple[int, int], np.ndarray] = {}
_B = np.uint64(0x9E3779B97F4A7C15)


def _table(fold: bool, c: int) -> np.ndarray:
    """A random value for each byte; fold: A-Z count as a-z."""
    values = np.random.default_rng(20240229 + c).integers(1, _PRIMES[c], 256, dtype=np.uint64)
    if fold:
        values[65:91] = values[97:123]
    return values


_TABLES = {(fold, c): _table(fold, c) for fold in (False, True) for c in _PRIMES}


def _reduced(x: np.ndarray, c: int) -> np.ndarray:
    """x in place, below 2^62 before and 2^36 after, of the same residue modulo 2^31 - c."""
    high = x >> _SHIFT
    x &= _LOW
    high *= np.uint64(c)
    x += high
    return x


def powers(base: int, n: int, c: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo 2^31 - c."""
    p = _PRIMES[c]
    have = _powers.get((base, c), np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), p)) % np.uint64(p)])
    _powers[base, c] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """The 64-bit hash of each data[start:end]; equal bytes have equal hashes anywhere."""
    out = np.zeros(len(starts), np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    for c, p in _PRIMES.items():
        terms = _TABLES[fold, c][data]
        terms *= powers(_BASES[c], len(data), c)
        np.cumsum(_reduced(terms, c), out=sums[1:])
        back = powers(pow(_BASES[c], -1, p), len(data) + 1, c)[starts]
        out = (out << _SHIFT) | ((sums[ends] - sums[starts]) % np.uint64(p) * back % np.uint64(p))
    return mix(out + (ends - starts).astype(np.uint64) * _B)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of n consecutive values, len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= _B
        out += h[j : j + m]
    return out


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the row of each; a row's end also ends a word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begin = at[:-1][at[:-1] < len(data)]
    first[begin] = inside[begin]
    finish = at[1:][at[1:] > 0] - 1
    last[finish] = inside[finish]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1
