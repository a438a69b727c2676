"""Price history per product: previous prices, change points, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricetrail.functions import pricing
from pricetrail.operators.ordered import Ordered

STATE = ("price", "old_price", "promo_flag", "in_stock")
CAPTURE_ORDER = ["captured_at", "id"]


def state_of(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in names or STATE])


def history(
    snapshots: DataFrame, probe: DataFrame | None = None, hot_rows: int | None = None
) -> Ordered:
    return Ordered(snapshots, ["product_id"], CAPTURE_ORDER, probe, hot_rows)


def with_reference_prices(
    snapshots: DataFrame, probe: DataFrame | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Previous, first and latest non-null price with amount and percent changes."""
    place = F.when(F.col("price").isNotNull(), F.struct(*CAPTURE_ORDER))
    rows = (
        history(snapshots, probe, hot_rows)
        .running(last={"previous_price": F.col("price")})
        .whole(
            {
                "first_observed_price": F.min_by("price", place),
                "latest_observed_price": F.max_by("price", place),
            }
        )
        .result
    )
    price = F.col("price")
    return rows.withColumns(
        {
            "change_from_previous_amount": pricing.amount_delta(F.col("previous_price"), price),
            "change_from_previous_percent": pricing.price_change_percent(F.col("previous_price"), price),
            "change_from_first_amount": pricing.amount_delta(F.col("first_observed_price"), price),
            "change_from_first_percent": pricing.price_change_percent(F.col("first_observed_price"), price),
        }
    )


def change_points(
    snapshots: DataFrame, probe: DataFrame | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Rows whose state differs from the row before it (nulls compare as values).

    For rows in capture order the stored state always equals the previous valid row's
    state, so looking one row back is the same as looking at what was stored.
    """
    valid = snapshots.where(
        F.col("price").isNotNull() | F.col("old_price").isNotNull() | F.col("in_stock")
    )
    rows = history(valid, probe, hot_rows).running(last={"_before": state_of()}).result
    return rows.where(
        F.col("_before").isNull() | ~F.col("_before").eqNullSafe(state_of())
    ).drop("_before")


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per product; each task keeps one candidate before the shuffle."""
    newest = Window.partitionBy("product_id").orderBy(F.desc("captured_at"), F.desc("id"))
    return snapshots.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def distinct_on(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key under an explicit order."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def newest_capture(documents: DataFrame, key: Column) -> DataFrame:
    """One document per key: the one captured last, where ``captured_at`` is known.

    Without capture times, and for equal ones, the choice depends on the content only.
    """
    last = [F.desc_nulls_last("captured_at")] if "captured_at" in documents.columns else []
    rest = F.xxhash64(*[F.col(c) for c in documents.columns if c != "captured_at"])
    return distinct_on(documents, key, [*last, rest])


def first_wins(df: DataFrame, keys: list[Column], position: str, *columns: str) -> DataFrame:
    """Keep the first row per key by position, combined before the shuffle."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    kept = df.groupBy(*named).agg(
        F.min(position).alias(position), *[F.min_by(c, position).alias(c) for c in columns]
    )
    return kept.select(position, *columns)


def selected_series(points: DataFrame, selected_id: Column) -> DataFrame:
    """The price on the selected row only."""
    return points.withColumn("selected_price", F.when(F.col("id") == selected_id, F.col("price")))
