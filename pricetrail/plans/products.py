"""Product grid, card, history, analytics and the combined analysis (Q4-Q8).

Every query answers for all snapshots at once; ``selected`` (a table with ``snapshot_id``)
narrows it to some. A product's history is one series shared by all its snapshots, given
as rows or as pages of bounded length, never copied per snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricetrail import schemas as S
from pricetrail.functions import display, pricing
from pricetrail.operators.history import history

POINTS_PER_PAGE = 500
POINT_FIELDS = (
    "snapshot_id", "run_id", "captured_at", "price", "old_price", "discount_percent",
    "promo_flag", "in_stock", "source",
)


def _chosen(snapshots: DataFrame, selected: DataFrame | None) -> DataFrame:
    """the selected snapshots, or all of them."""
    if selected is None:
        return snapshots
    wanted = selected.select(F.col("snapshot_id").alias("id")).distinct()
    return snapshots.join(wanted, "id", "left_semi")


def _of_chosen_products(snapshots: DataFrame, selected: DataFrame | None) -> DataFrame:
    """All rows of the products the selected snapshots belong to."""
    if selected is None:
        return snapshots
    products = _chosen(snapshots, selected).select("product_id").distinct()
    return snapshots.join(products, "product_id", "left_semi")


def _shown_products(products: DataFrame) -> DataFrame:
    """Product columns as shown; formatted once per product, before any join."""
    return products.select(
        F.col("id").alias("p_id"), "name", "external_id", "url", "slug",
        display.format_unit(F.col("pack_value"), F.col("pack_unit")).alias("unit"),
        "updated_at",
    )


def products_grid(snapshots: DataFrame, products: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Q4."""
    s, p = _chosen(snapshots, selected).alias("s"), _shown_products(products)
    return s.join(p, F.col("s.product_id") == F.col("p_id")).select(
        F.col("s.id").alias("snapshot_id"),
        F.col("p_id").alias("id"),
        "name",
        display.sku_or_empty(F.col("external_id")).alias("sku"),
        "url",
        pricing.snapshot_price(F.col("s.price"), F.col("s.old_price")).alias("price"),
        "unit",
        "updated_at",
    )


def _cards(
    rows: DataFrame, products: DataFrame, runs: DataFrame, default_source: str,
    beside: DataFrame | None = None,
) -> tuple[DataFrame, list[Column]]:
    """``rows`` (snapshots, aliased ``s``) joined to products and runs, and the card columns.

    The run's source comes first: a shuffle by run then carries no product texts.
    """
    r = runs.select(F.col("id").alias("r_id"), F.col("source").alias("r_source"))
    shown = _shown_products(products)
    if beside is not None:
        shown = shown.join(beside, "url")
    joined = rows.alias("s").join(r, F.col("s.run_id") == F.col("r_id"), "left").join(
        shown, F.col("s.product_id") == F.col("p_id")
    )
    card = [
        F.col("p_id").alias("id"),
        F.col("s.id").alias("snapshot_id"),
        F.col("s.run_id").alias("run_id"),
        F.col("name"),
        F.col("external_id").alias("sku"),
        F.col("url"),
        F.col("slug"),
        F.col("unit"),
        F.col("s.price").alias("current_price"),
        F.col("s.old_price").alias("old_price"),
        pricing.discount_percent(F.col("s.price"), F.col("s.old_price")).alias("discount_percent"),
        F.col("s.promo_flag").alias("promo_flag"),
        F.col("s.in_stock").alias("in_stock"),
        F.col("updated_at"),
        F.col("s.captured_at").alias("captured_at"),
        pricing.run_source_or_default(F.col("r_source"), default_source).alias("source"),
        display.missing_text().alias("brand"),
        display.missing_text().alias("category"),
        display.missing_text().alias("image_url"),
    ]
    return joined, card


def product_details(
    snapshots: DataFrame, products: DataFrame, runs: DataFrame,
    selected: DataFrame | None = None, default_source: str = S.DEFAULT_SOURCE,
    beside: DataFrame | None = None,
) -> DataFrame:
    """Q5. The columns of ``beside`` are met by the product's url: once a product, not once a snapshot."""
    joined, card = _cards(_chosen(snapshots, selected), products, runs, default_source, beside)
    return joined.select(*card, *([] if beside is None else [c for c in beside.columns if c != "url"]))


def product_history(
    snapshots: DataFrame, runs: DataFrame, selected: DataFrame | None = None,
    default_source: str = S.DEFAULT_SOURCE,
) -> DataFrame:
    """Q6: the history rows of the selected snapshots' products, keyed by product."""
    h, r = _of_chosen_products(snapshots, selected).alias("h"), runs.alias("r")
    return h.join(r, F.col("h.run_id") == F.col("r.id"), "left").select(
        F.col("h.product_id").alias("product_id"),
        F.col("h.id").alias("id"),
        F.col("h.run_id").alias("run_id"),
        F.col("h.captured_at").alias("captured_at"),
        F.col("h.price").alias("price"),
        F.col("h.old_price").alias("old_price"),
        pricing.discount_percent(F.col("h.price"), F.col("h.old_price")).alias("discount_percent"),
        F.col("h.promo_flag").alias("promo_flag"),
        F.col("h.in_stock").alias("in_stock"),
        pricing.run_source_or_default(F.col("r.source"), default_source).alias("source"),
    )


def newest_first_order() -> list[Column]:
    """O2, with the id as tie-break."""
    return [F.col("product_id"), F.desc("captured_at"), F.desc("id")]


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*newest_first_order())


def _analytics_rows(
    rows: DataFrame, selected: DataFrame | None, probe: DataFrame | None, hot_rows: int | None
) -> DataFrame:
    """Snapshots with the aggregates and earlier prices of their product beside them."""
    price = F.col("price")
    place = F.when(price.isNotNull(), F.struct("captured_at", "id"))
    out = (
        history(rows, probe, hot_rows)
        .running(last={"previous_price": price})
        .whole(
            {
                "history_points_count": F.count("*"),
                "price_points_count": F.count(price),
                "promo_moments_count": F.count_if(F.col("promo_flag")),
                "in_stock_moments_count": F.count_if(F.col("in_stock")),
                "first_captured_at": F.min("captured_at"),
                "last_captured_at": F.max("captured_at"),
                "first_observed_price": F.min_by(price, place),
                "latest_observed_price": F.max_by(price, place),
                "min_price": F.min(price),
                "max_price": F.max(price),
                "_total": F.sum(price),
            }
        )
        .result
    )
    return out if selected is None else _chosen(out, selected)


def _analytics_columns(prefix: str = "") -> list[Column]:
    def at(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    price, previous, first = at("price"), at("previous_price"), at("first_observed_price")
    return [
        at("id").alias("snapshot_id"),
        *[at(n).alias(n) for n in (
            "history_points_count", "price_points_count", "promo_moments_count",
            "in_stock_moments_count",
        )],
        at("captured_at").alias("selected_captured_at"),
        at("first_captured_at").alias("first_captured_at"),
        at("last_captured_at").alias("last_captured_at"),
        price.alias("selected_price"),
        *[at(n).alias(n) for n in (
            "previous_price", "first_observed_price", "latest_observed_price", "min_price", "max_price",
        )],
        pricing.average_price(at("_total"), at("price_points_count")).alias("average_price"),
        pricing.amount_delta(at("min_price"), at("max_price")).alias("price_spread"),
        pricing.amount_delta(previous, price).alias("change_from_previous_amount"),
        pricing.price_change_percent(previous, price).alias("change_from_previous_percent"),
        pricing.amount_delta(first, price).alias("change_from_first_amount"),
        pricing.price_change_percent(first, price).alias("change_from_first_percent"),
    ]


def product_analytics(
    snapshots: DataFrame, selected: DataFrame | None = None,
    probe: DataFrame | None = None, hot_rows: int | None = None,
) -> DataFrame:
    """Q7: the analytics of every snapshot within its product's history, one shuffle."""
    base = _of_chosen_products(snapshots, selected).select(
        "id", "product_id", "captured_at", "price", "promo_flag", "in_stock"
    )
    rows = _analytics_rows(base, selected, probe, hot_rows)
    return rows.select(*_analytics_columns(), "product_id")


def price_points(
    snapshots: DataFrame, runs: DataFrame, selected: DataFrame | None = None,
    page_size: int = POINTS_PER_PAGE, default_source: str = S.DEFAULT_SOURCE,
    probe: DataFrame | None = None, hot_rows: int | None = None,
) -> DataFrame:
    """``product_id, page_no, points[]`` in capture order, ``page_size`` points a page."""
    rows = product_history(snapshots, runs, selected, default_source)
    placed = history(rows, probe, hot_rows).running(total={"_earlier": F.lit(1)}).result
    # The position leads, so sorting the page sorts by capture time.
    point = F.struct(
        F.col("_earlier").alias("position"),
        F.col("id").alias("snapshot_id"),
        *[F.col(n) for n in POINT_FIELDS[1:]],
    )
    paged = placed.groupBy(
        "product_id", F.floor(F.col("_earlier") / page_size).cast("bigint").alias("page_no")
    ).agg(F.array_sort(F.collect_list(point)).alias("_page"))
    return paged.select(
        "product_id", "page_no",
        F.transform(
            "_page", lambda p: F.struct(*[p[n].alias(n) for n in POINT_FIELDS])
        ).alias("points"),
    )


def product_analysis(
    snapshots: DataFrame, products: DataFrame, runs: DataFrame,
    selected: DataFrame | None = None, page_size: int = POINTS_PER_PAGE,
    default_source: str = S.DEFAULT_SOURCE,
    probe: DataFrame | None = None, hot_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Q8: (``snapshot_id, product_card, analytics, history_pages``, the history pages).

    Snapshots without a product are absent, as a missing card is. The history of a
    snapshot is the pages of its product.
    """
    base = _of_chosen_products(snapshots, selected).select(
        "id", "run_id", "product_id", "captured_at", "price", "old_price", "promo_flag", "in_stock"
    )
    # The rows stay partitioned by product from the windows through the product join.
    rows = _analytics_rows(base, selected, probe, hot_rows)
    joined, card = _cards(rows, products, runs, default_source)
    pages = F.ceil(F.col("s.history_points_count") / page_size).cast("bigint")
    head = joined.select(
        F.col("s.id").alias("snapshot_id"), F.col("p_id").alias("product_id"),
        F.struct(*card).alias("product_card"),
        F.struct(*_analytics_columns("s.")).alias("analytics"), pages.alias("history_pages"),
    )
    return head, price_points(
        snapshots, runs, selected, page_size, default_source, probe, hot_rows
    )


def point_text(point: Column) -> Column:
    """A compact text form of one point, used in reports."""
    cents = (point["price"] * 100).cast("bigint").cast("string")
    return F.concat_ws(
        ":", point["snapshot_id"].cast("string"), F.coalesce(cents, F.lit("-")),
        F.when(point["promo_flag"], "p").otherwise("n"), F.when(point["in_stock"], "s").otherwise("o"),
        point["source"],
    )
