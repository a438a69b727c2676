"""Consecutive numbers for rows in the order of a key, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricetrail.session import cut

_PLACE = (1 << 33) - 1  # the row's place within its partition, in Spark's increasing ids


def ranked(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with ``name``: numbers from 0 that increase in ``order`` but leave gaps, without a write.

    Every evaluation may give other numbers: write what is made of them before it is used twice.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn(name, F.monotonically_increasing_id())


def with_places(df: DataFrame, ranks: DataFrame, rank: str, names: dict[str, str]) -> DataFrame:
    """``df`` with the place (0, 1, 2, ...) of each rank in the columns ``names`` (place column: rank column).

    ``ranks`` are written rows that hold every number of :func:`ranked` once, in ``rank``.
    """
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.broadcast(ranks.groupBy(F.shiftright(rank, 33).alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin")
    ))
    for place, number in names.items():
        met = df.withColumn("_part", F.shiftright(number, 33)).join(begins, "_part", "left")
        df = met.withColumn(place, F.col("_begin") + F.col(number).bitwiseAND(F.lit(_PLACE))).drop("_part", "_begin")
    return df


def numbered(rows: DataFrame, order: str | list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2, ... in ``order``, which should leave no ties.

    The rows are sorted into ranges and written; each range then starts where the counts of
    the ranges before it end. Only one count per range is looked at together.
    """
    by = [order] if isinstance(order, str) else order
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(
        rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin")
    )
    return placed.join(F.broadcast(begins), "_part").withColumn(
        name, F.col("_begin") + F.col("_at")
    ).drop("_part", "_at", "_begin")
