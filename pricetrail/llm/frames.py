"""Small helpers on DataFrames that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A side is broadcast only if its counted rows times its widest row stay below this.
BROADCAST_BYTES = 32_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes that go to Python at a time, so that a task holds a few megabytes of text.
BATCH_BYTES = 3_000_000


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, after Arrow batches were limited to ``BATCH_BYTES`` bytes; the number of rows is left alone."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("b")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def small_or_not(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if it was counted small enough, else as it is for a shuffled join.

    ``row_bytes`` is the most one row can take; the rows are the same either way.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def unit(*parts: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the parts and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
