"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

#: Fixed value: a word is a run of anything but space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A side of a join is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 100_000
#: The same for a side that is nothing but a few fixed-width numbers a row.
NARROW_ROWS = 1_000_000


#: Scratch paths made so far, so that a caller can remove those of a step that is done.
MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    MADE.append(scratch_path(spark, name))
    return MADE[-1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder: lineage is cut, and a lost executor takes nothing with it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    table_ = df.sparkSession.read.schema(df.schema).parquet(path)
    table_.scratch_path = path
    return table_


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in MADE:
        MADE.remove(path)


def remove_since(spark: SparkSession, mark: int, keep: str) -> None:
    """Deletes the scratch paths made after the first `mark`, but for `keep`."""
    for path in [p for p in MADE[mark:] if p != keep]:
        remove(spark, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it is small; otherwise unchanged, so that the join shuffles (AQE splits skewed keys)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Texts that go to Python at once, and Spark's own limit that this one takes the place of.
BATCH_SETTING, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", 64 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of some 4 MB, unless the session has a limit of its own.

    10,000 whole texts, Spark's batch, are tens of MB, and an executor holds them several times: as rows in wait, in Arrow's
    buffers on either side, and as Python's strings, in each worker. The rows and results are the same.
    """
    if spark.conf.get(BATCH_SETTING).rstrip("b") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns, with the whole row in row_: what an operator adds can't clash with columns that it passes on."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row_"), *[docs[c] for c in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- blocked Bloom filters over 64-bit hashes: all bits of a key lie in one 64-bit block

BITS_A_KEY = 16
MOST_BLOCKS = 1 << 20  # 8 MB; a longer list has more false positives for the exact join to remove


def bloom_blocks(keys: int, most: int = MOST_BLOCKS) -> int:
    return min(most, 1 << max(0, math.ceil(math.log2(max(1, keys * BITS_A_KEY / 64)))))


def _block(h: str, blocks: int) -> str:
    return f"int(pmod(shiftright({h}, 24), {blocks}))"


def _mask(h: str) -> str:
    return "(" + " | ".join(f"shiftleft(1L, int(shiftrightunsigned({h}, {6 * i}) & 63L))" for i in range(4)) + ")"


def bloom(keys: DataFrame, h: str, blocks: int) -> DataFrame:
    """One row: words, the blocks of the filter of a column of hashes, in order."""
    own = keys.select(F.expr(_block(h, blocks)).alias("block"), F.expr(_mask(h)).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    filled = every.join(own, "block", "left").select("block", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "word"))), lambda s: s["word"]).alias("words"))


def bloom_hit(h: str, words: str, blocks: int) -> str:
    """SQL: may the filter in the array `words` have the hash? The one-element array names the hash, which is made once."""
    return f"exists(array({h}), x -> ({words}[{_block('x', blocks)}] & {_mask('x')}) = {_mask('x')})"


def literals(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table of fixed values, as one expression."""
    fields = [x.split() for x in ddl.split(", ")]
    structs = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)]) for row in rows]
    if not structs:
        return spark.createDataFrame([], ddl)
    return spark.range(1).select(F.inline(F.array(*structs)))
