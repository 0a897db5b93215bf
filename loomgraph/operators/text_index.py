"""A trigram index of chunks: posting lists that say which chunks can hold a token, checked afterwards.

Chunks are dealt to blocks of 64 in the order of their partition; a posting is (gram, blocks, bits), for each
block of a run of up to 32 one bit for each chunk that holds the trigram, so that a trigram's list takes a row
per run. Only trigrams of the characters of tokens are indexed, as no other is ever looked up. A search
intersects the lists of a token's trigrams (bit_and per block), which leaves candidates; only the blocks
with candidates are read from the store, and `contains` decides. Grams and blocks are stored by folders
that a search prunes. A token's score does not depend on the index, which only leaves out chunks that
can't hold it; tokens of less than three characters have no trigrams and are not searched for.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import question_tokens, trigrams
from loomgraph.operators.graph import top_per
from loomgraph.operators.tables import shared_folder, written

#: Chunks of a block: bits of a long.
BLOCK = 64
#: Blocks of a posting, at most.
RUN = 32
#: Folders of the postings and of the store, at most.
FOLDERS = 64
#: Questions of a batch that is broadcast; more go in batches of about that size.
QUESTIONS = 5_000
#: The characters of lower-cased tokens.
CHARACTERS = string.ascii_lowercase + string.digits + "_-"


@dataclass
class TextIndex:
    """postings: gram, blocks, bits, folder. store: chunk_id, content (lower-cased), block, bit, folder."""

    postings: DataFrame
    store: DataFrame
    folders: int


def grams(text: Column) -> Column:
    """The trigrams of the characters of tokens."""
    return F.filter(trigrams(text), lambda g: g.rlike("^[a-z0-9_-]{3}$"))


def _folder(key: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, bit and content, blocks together -> gram, blocks and bits of each run of blocks.

    A gram is a number of three digits, a digit for each character; 0 stands for all other characters.
    """
    base = len(CHARACTERS) + 1
    digit = np.zeros(256, np.int32)
    digit[list(CHARACTERS.encode())] = np.arange(1, base)
    of = [" ", *CHARACTERS]
    names = pa.array([a + b + c for a in of for b in of for c in of])
    held, run = np.zeros((base**3, RUN), np.uint64), []

    def told() -> pa.RecordBatch:
        gram, place = np.nonzero(held)
        found, first = np.unique(gram, return_index=True)
        ends = pa.array(np.append(first, len(gram)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (np.array(run, np.int64)[place], held[gram, place].view(np.int64))]
        held[gram, place] = 0
        return pa.RecordBatch.from_arrays([names.take(pa.array(found)), *lists], ["gram", "blocks", "bits"])

    for batch in batches:
        texts = batch.column("content").cast(pa.binary())
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        d = digit[data]
        code = (d[:-2] * base + d[1:-1]) * base + d[2:]
        code[(d[:-2] == 0) | (d[1:-1] == 0) | (d[2:] == 0)] = 0
        ends = (at - at[0]).tolist()
        for i, (block, bit) in enumerate(zip(batch.column("block").to_pylist(), batch.column("bit").to_pylist(), strict=True)):
            if not run or run[-1] != block:
                if len(run) == RUN:
                    yield told()
                    run.clear()
                run.append(block)
            # A text's last two characters start no trigram.
            own = code[ends[i] : max(ends[i], ends[i + 1] - 2)]
            held[own, len(run) - 1] |= np.uint64(1 << bit)
            held[0, len(run) - 1] = 0
    if run:
        yield told()


def build(chunks: DataFrame, path: str | None = None, folders: int | None = None) -> TextIndex:
    """Index chunk_id, content. A chunk's bit is its place in its block; blocks hold 64 chunks at most."""
    spark = chunks.sparkSession
    path = path or shared_folder(spark)
    rows = written(chunks.select("chunk_id", F.lower("content").alias("content"), F.monotonically_increasing_id().alias("place")), f"{path}/rows")
    folders = folders or max(1, min(FOLDERS, math.ceil(rows.count() / 10_000)))
    placed = rows.select("chunk_id", "content", F.floor(F.col("place") / BLOCK).alias("block"), (F.col("place") % BLOCK).cast("int").alias("bit"))
    store = written(placed.withColumn("folder", _folder(F.col("block"), folders)).repartition("folder").sortWithinPartitions("block"), f"{path}/store", ["folder"])
    listed = store.select("block", "bit", "content").mapInArrow(_postings, "gram string, blocks array<bigint>, bits array<bigint>")
    postings = written(listed.withColumn("folder", _folder(F.col("gram"), folders)).repartition("folder").sortWithinPartitions("gram"), f"{path}/postings", ["folder"])
    written(spark.range(folders, folders + 1), f"{path}/folders")
    return TextIndex(postings, store, folders)


def load(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/store"), spark.read.parquet(f"{path}/folders").first()[0])


def pruned(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Only the folders (FOLDERS at most) that keys has."""
    return table.filter(F.col("folder").isin([r.folder for r in keys.select("folder").distinct().collect()]))


def candidates(index: TextIndex, asked: DataFrame) -> DataFrame:
    """token, block and bits of the chunks that hold all trigrams of each distinct token. asked: token."""
    tokens = asked.select("token").distinct().withColumn("grams", grams(F.col("token"))).filter(F.size("grams") > 0)
    wanted = tokens.select("token", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    wanted = wanted.withColumn("folder", _folder(F.col("gram"), index.folders))
    # The tokens are those of a counted batch of questions.
    met = pruned(index.postings, wanted).join(F.broadcast(wanted), ["folder", "gram"]).select("token", "gram", "n", F.inline(F.arrays_zip("blocks", "bits")))
    # A block whose rows went to two tasks has two postings of a gram.
    met = met.groupBy("token", "gram", F.col("blocks").alias("block")).agg(F.bit_or("bits").alias("bits"), F.first("n").alias("n"))
    return met.groupBy("token", "block").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("found"), F.first("n").alias("n")).filter("found = n AND bits <> 0").select("token", "block", "bits")


def search(index: TextIndex, questions: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score and rank: a chunk's score is the number of the question's tokens that it holds."""
    asked = questions.select("query_id", question_tokens(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
    batches = max(1, math.ceil(asked.count() / QUESTIONS))
    out = None
    for i in range(batches):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == i)
        tokens = own.select("query_id", "tokens", F.explode("tokens").alias("token"))
        found = written(candidates(index, tokens).withColumn("folder", _folder(F.col("block"), index.folders)))
        may = found.join(F.broadcast(tokens), "token").groupBy("folder", "query_id", "block").agg(F.bit_or("bits").alias("bits"), F.first("tokens").alias("tokens"))
        # Stored content is lower-cased.
        score = F.size(F.filter("tokens", lambda t: F.contains("content", t)))
        held = pruned(index.store, found).join(may, ["folder", "block"]).filter(F.expr("(shiftrightunsigned(bits, bit) & 1) = 1"))
        scored = held.select("query_id", "chunk_id", score.cast("double").alias("score")).filter("score > 0")
        hits = top_per(scored, "query_id", k, F.desc("score"), "chunk_id")
        out = hits if out is None else out.unionByName(hits)
    return out
