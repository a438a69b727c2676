"""Ordered analytics per key that stay parallel when one key is very large.

A window sends all rows of a key to one task. Keys with more than ``hot_rows`` rows are
therefore cut into consecutive segments first: range partitioning on (key, order) balances
them however the rows are spread, each segment is folded on its own, and the folded values
of the earlier segments (one small row per segment border) are carried into the later ones.
The number of segments follows the rows, not the limit: a low limit splits at more keys, not
into more tasks than the rows are worth.
Keys below the limit take the plain window, which needs one shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricetrail.session import cut

HOT_ROWS_SETTING = "spark.pricetrail.hotRows"
DEFAULT_HOT_ROWS = 5_000_000
# Beyond FEW_SEGMENTS, a segment has at least half of these rows.
SEGMENT_ROWS = 1_000_000
FEW_SEGMENTS = 32
MAX_BROADCAST_BYTES = 32_000_000
# What one carried row takes besides its keys.
_ROW_BYTES = 256
_SEGMENT = "_segment"


def hot_row_limit(df: DataFrame, hot_rows: int | None = None) -> int:
    if hot_rows:
        return hot_rows
    return int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(DEFAULT_HOT_ROWS)))


def segment_count(hot_total: int, limit: int) -> int:
    """Segments of about half the limit, but no more than the rows are worth."""
    wanted = 2 * math.ceil(hot_total / limit)
    return max(2, min(wanted, max(FEW_SEGMENTS, 2 * math.ceil(hot_total / SEGMENT_ROWS))))


def _small(df: DataFrame, rows: int, key_bytes: int) -> DataFrame:
    """Broadcast only below a measured size; otherwise the planner decides."""
    return F.broadcast(df) if rows * (_ROW_BYTES + key_bytes) <= MAX_BROADCAST_BYTES else df


class Ordered:
    """Rows of ``df`` per ``keys`` in ``order`` (names; together they identify a row)."""

    def __init__(
        self,
        df: DataFrame,
        keys: list[str],
        order: list[str],
        probe: DataFrame | None = None,
        hot_rows: int | None = None,
        sizes: DataFrame | None = None,
    ):
        self.keys, self.order = list(keys), list(order)
        limit = hot_row_limit(df, hot_rows)
        # ``sizes``: the rows of each key as ``_n``, where they are known without counting.
        counts = sizes if sizes is not None else (df if probe is None else probe).groupBy(*self.keys).agg(F.count("*").alias("_n"))
        # At most rows / limit keys can be hot; with a low limit that can be most keys.
        hot = counts.where(F.col("_n") > limit)
        widest = F.max(sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in self.keys), F.lit(0)))
        size = hot.agg(F.count("*").alias("k"), F.sum("_n").alias("n"), widest.alias("w")).first()
        self.key_bytes = size["w"] or 0
        self.segments = 0
        self.rows = df
        if size["k"]:
            self._split(cut(hot), size["k"], size["n"], limit)

    def _split(self, hot: DataFrame, hot_keys: int, hot_total: int, limit: int) -> None:
        df = self.rows
        self.segments = segment_count(hot_total, limit)
        marks = _small(hot.select(*self.keys), hot_keys, self.key_bytes).alias("_hot")
        on = reduce(
            lambda a, b: a & b,
            [F.col(f"_rows.{k}").eqNullSafe(F.col(f"_hot.{k}")) for k in self.keys],
        )
        rows = df.alias("_rows")
        cold = rows.join(marks, on, "left_anti").withColumn(_SEGMENT, F.lit(0))
        ranged = (
            rows.join(marks, on, "left_semi")
            .repartitionByRange(self.segments, *self.keys, *self.order)
            .withColumn(_SEGMENT, F.spark_partition_id() + 1)
        )
        # Written once, so that every later use sees the same segments.
        self.rows = cold.unionByName(cut(ranged))
        self.hot_keys = hot_keys

    def _with(self, rows: DataFrame) -> Ordered:
        out = object.__new__(Ordered)
        out.__dict__.update(self.__dict__)
        out.rows = rows
        return out

    def derive(self, columns: dict[str, Column]) -> Ordered:
        """Add plain row-wise columns."""
        return self._with(self.rows.withColumns(columns))

    def _groups(self) -> list[str]:
        return self.keys + ([_SEGMENT] if self.segments else [])

    def running(
        self,
        last: dict[str, Column] | None = None,
        high: dict[str, Column] | None = None,
        total: dict[str, Column] | None = None,
        inclusive: bool = False,
    ) -> Ordered:
        """Fold over earlier rows of the key (and the row itself when ``inclusive``).

        ``last``: newest non-null value, ``high``: maximum, ``total``: sum, 0 when empty.
        """
        last, high, total = last or {}, high or {}, total or {}
        frame = (
            Window.partitionBy(*self._groups()).orderBy(*self.order)
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        )
        folded = {n: F.last(c, ignorenulls=True).over(frame) for n, c in last.items()}
        folded |= {n: F.max(c).over(frame) for n, c in high.items()}
        folded |= {n: F.coalesce(F.sum(c).over(frame), F.lit(0)) for n, c in total.items()}
        rows = self.rows.withColumns(folded)
        if not self.segments:
            return self._with(rows)

        place = F.struct(*self.order)
        per_segment = [
            F.max_by(c, F.when(c.isNotNull(), place)).alias(n) for n, c in last.items()
        ]
        per_segment += [F.max(c).alias(n) for n, c in high.items()]
        per_segment += [F.sum(c).alias(n) for n, c in total.items()]
        parts = (
            self.rows.where(F.col(_SEGMENT) > 0).groupBy(*self.keys, _SEGMENT).agg(*per_segment)
        )
        earlier = (
            Window.partitionBy(*self.keys).orderBy(_SEGMENT)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = [F.count("*").over(earlier).alias("_k_earlier")]
        carried += [F.last(n, ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in last]
        carried += [F.max(n).over(earlier).alias(f"_c_{n}") for n in high]
        carried += [F.sum(n).over(earlier).alias(f"_c_{n}") for n in total]
        carry = parts.select(
            *[F.col(k).alias(f"_k_{k}") for k in self.keys],
            F.col(_SEGMENT).alias("_k_segment"),
            *carried,
        ).where("_k_earlier > 0")  # a border of two segments cuts at most one key
        on = reduce(
            lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys]
        ) & (F.col(_SEGMENT) == F.col("_k_segment"))
        joined = rows.join(_small(carry, self.segments, self.key_bytes), on, "left")
        merged = {n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in last}
        merged |= {n: F.greatest(F.col(n), F.col(f"_c_{n}")) for n in high}
        merged |= {n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in total}
        names = self.rows.columns + [n for n in folded if n not in self.rows.columns]
        return self._with(joined.withColumns(merged).select(*names))

    def whole(self, aggregates: dict[str, Column]) -> Ordered:
        """Add aggregates over all rows of the key."""
        if not self.segments:
            everything = Window.partitionBy(*self.keys)
            return self._with(
                self.rows.withColumns({n: c.over(everything) for n, c in aggregates.items()})
            )
        everything = Window.partitionBy(*self.keys)
        cold = self.rows.where(F.col(_SEGMENT) == 0).withColumns(
            {n: c.over(everything) for n, c in aggregates.items()}
        )
        hot = self.rows.where(F.col(_SEGMENT) > 0)
        sums = hot.groupBy(*[F.col(k).alias(f"_k_{k}") for k in self.keys]).agg(
            *[c.alias(n) for n, c in aggregates.items()]
        )
        on = reduce(
            lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys]
        )
        joined = hot.join(_small(sums, self.hot_keys, self.key_bytes), on, "left").select(*cold.columns)
        return self._with(cold.unionByName(joined))

    @property
    def result(self) -> DataFrame:
        return self.rows.drop(_SEGMENT) if self.segments else self.rows
