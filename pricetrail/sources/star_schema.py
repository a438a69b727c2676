"""A retail star schema read as price observations.

Lets every operator run on order, line item, part, event and page tables: orders are runs,
parts are products, line items are snapshots and observations, returned line items are
crawl errors, events are queue transitions and the fetch log. All views are row-wise
except for one lookup of the part's list price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pricetrail import schemas as S
from pricetrail.session import UTC

SHOP = "shop.example"
PRODUCT_ROOT = f"https://{SHOP}/p/"


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table; its schema is read from the files once per process."""
    spark.conf.set("spark.sql.session.timeZone", UTC)
    path = f"{root.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def cents(value: Column) -> Column:
    """Amounts are written to the cent, so this only removes the noise of doubles."""
    return F.floor(value * 100 + 0.5)


def money(amount_cents: Column) -> Column:
    return (amount_cents.cast("decimal(18,0)") / 100).cast(S.MONEY)


def line_id() -> Column:
    """An id out of the row's own values, in plain integer arithmetic: no ranking, no hash.

    34 bits name the order and line, 28 bits mix part, supplier and price.
    """
    mixed = (
        F.col("l_partkey") * 1000003 + F.col("l_suppkey") * 10007 + cents(F.col("l_extendedprice"))
    ) % 268435456
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 268435456 + mixed


def runs(spark: SparkSession, root: str) -> DataFrame:
    code = F.col("o_orderstatus")
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("started_at"),
        F.when(code != "P", F.col("o_orderdate") + F.expr("INTERVAL 10 MINUTES")).alias("finished_at"),
        F.when(code == "F", "ok").when(code == "P", "running").otherwise("error").alias("status"),
        F.col("o_orderpriority").alias("source"),
        F.lit(None).cast("string").alias("note"),
    )


def products(spark: SparkSession, root: str) -> DataFrame:
    key, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    url = F.concat(F.lit(PRODUCT_ROOT), key.cast("string"))
    return table(spark, root, "part").select(
        key.alias("id"),
        F.concat(F.lit("SKU-"), key.cast("string")).alias("external_id"),
        F.col("p_name").alias("name"),
        url.alias("url"),
        key.cast("string").alias("slug"),
        F.when(size % 10 != 0, (size.cast("decimal(18,0)") / 8).cast(S.PACK)).alias("pack_value"),
        F.when(kind != "PROMO", F.lower(kind)).alias("pack_unit"),
        F.expr("timestamp_ntz '2020-01-01 00:00:00'").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def _priced_lines(spark: SparkSession, root: str, beside: DataFrame | None = None) -> DataFrame:
    """Line items with their list price; the planner decides how to join the parts.

    ``beside`` (l_partkey and more) is met on the same key, so that the lines are not shuffled again for it.
    """
    parts = table(spark, root, "part").select(
        F.col("p_partkey").alias("l_partkey"), cents(F.col("p_retailprice")).alias("_list")
    )
    lines = table(spark, root, "lineitem").withColumn("_off", cents(F.col("l_discount")))
    sold = F.floor((F.col("_list") * (100 - F.col("_off")) + 50) / 100).cast("bigint")
    priced = lines.join(parts, "l_partkey")
    if beside is not None:
        priced = priced.join(beside, "l_partkey", "left")
    return priced.withColumns(
        {
            "id": line_id(),
            "price": F.when(F.col("l_linenumber") != 7, money(sold)),
            "old_price": F.when(F.col("_off") > 0, money(F.col("_list"))),
            "promo_flag": F.col("_off") > 0,
            "in_stock": F.col("l_linestatus") == "O",
        }
    )


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    return _priced_lines(spark, root).select(
        "id",
        F.col("l_orderkey").alias("run_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").alias("captured_at"),
        "price", "old_price", "promo_flag", "in_stock",
        F.col("l_suppkey").alias("queue_id"),
    )


def product_probe(spark: SparkSession, root: str) -> DataFrame:
    """The product of every snapshot, for finding very large products without the join."""
    return table(spark, root, "lineitem").select(F.col("l_partkey").alias("product_id"))


def observations(spark: SparkSession, root: str, beside: DataFrame | None = None) -> DataFrame:
    """Untrimmed observations in capture order; some without an external id, and every
    fifth part sold under an address per even or odd supplier. ``beside``: further columns by ``l_partkey``."""
    part = F.col("l_partkey").cast("string")
    day = F.unix_date(F.to_date("l_shipdate")).cast("bigint")
    moved = F.when(
        (F.col("l_partkey") % 5 == 0) & (F.col("l_suppkey") % 2 == 1), "/alt"
    ).otherwise("")
    return _priced_lines(spark, root, beside).select(
        (day * F.lit(281474976710656) + F.col("id").bitwiseAND(281474976710655)).alias("seq"),
        F.col("l_orderkey").alias("run_id"),
        F.col("l_suppkey").alias("queue_id"),
        F.when(
            (F.col("l_linenumber") != 1) | (F.col("l_partkey") % 5 == 0),
            F.concat(F.lit(" SKU-"), part, F.lit(" ")),
        ).alias("external_id"),
        F.concat(F.lit(" part "), part, F.lit(" seen ")).alias("name"),
        F.concat(F.lit(f" {PRODUCT_ROOT}"), part, moved, F.lit("  ")).alias("url"),
        part.alias("slug"),
        F.lit(None).cast(S.PACK).alias("pack_value"),
        F.lit(" pcs ").alias("pack_unit"),
        "price", "old_price", "promo_flag", "in_stock",
        F.col("l_shipdate").alias("observed_at"),
        *([] if beside is None else [c for c in beside.columns if c != "l_partkey"]),
    )


def errors(spark: SparkSession, root: str) -> DataFrame:
    """Raw error rows of returned line items; line 6 has no product."""
    number = F.col("l_linenumber")
    code = (
        F.when(number == 1, "not_found").when(number == 2, " Timeout ").when(number == 3, "HTTP_5xx")
        .when(number == 4, "too_many_requests").when(number == 5, "  ").when(number == 6, "Odd_Code")
    )
    return table(spark, root, "lineitem").where("l_returnflag = 'R'").select(
        line_id().alias("id"),
        F.col("l_orderkey").alias("run_id"),
        F.col("l_suppkey").alias("queue_id"),
        F.when(number != 6, F.col("l_partkey")).alias("product_id"),
        F.concat(F.lit(f"  {PRODUCT_ROOT}"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("url"),
        code.alias("error_code"),
        F.when(number == 1, 404).when(number == 3, 503).when(number == 4, 429).alias("http_status"),
        F.when(number % 2 == 0, F.concat(F.lit(" line "), number.cast("string"))).alias("error_message"),
        F.when(number != 3, F.col("l_shipdate")).alias("created_at"),
    )


def error_keys(spark: SparkSession, root: str) -> DataFrame:
    """The two columns of the error table that outcomes depend on."""
    return errors(spark, root).select("run_id", "product_id")


_STATUS_OF_EVENT = {
    "signup": "pending", "view": "reserved", "click": "retry", "error": "dead", "purchase": "succeeded",
}


def event_status() -> Column:
    out = F.lit("pending")
    for event, name in _STATUS_OF_EVENT.items():
        out = F.when(F.col("event_type") == event, name).otherwise(out)
    return out


def item_id() -> Column:
    return F.col("user_id") * 50 + F.col("event_id") % 50


def queue_events(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select(
        F.col("user_id").alias("run_id"), item_id().alias("item_id"),
        event_status().alias("transition"), F.col("ts").alias("at"), "event_id",
    )


def queue(spark: SparkSession, root: str) -> DataFrame:
    """Queue rows as the newest event of each item left them."""
    place = F.struct("ts", "event_id")
    seconds = F.floor("value").cast("bigint")
    folded = table(spark, root, "events").groupBy("user_id", item_id().alias("id")).agg(
        F.max_by(event_status(), place).alias("status"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max_by(seconds, place).alias("wait"),
        F.count_if(F.col("event_type").isin("click", "error")).cast("int").alias("failures"),
    )
    state, last = F.col("status"), F.col("last_ts")

    def none(kind: str) -> Column:
        return F.lit(None).cast(kind)

    held = state == "reserved"
    return folded.select(
        "id",
        F.col("user_id").alias("run_id"),
        F.concat(F.lit(f"https://{SHOP}/q/"), F.col("id").cast("string")).alias("url"),
        state.alias("status"),
        F.least(F.col("failures"), F.lit(3)).alias("attempt"),
        F.lit(3).alias("max_attempts"),
        F.when(state == "retry", last + F.make_interval(secs=F.col("wait"))).alias("next_attempt_at"),
        F.when(held, last).alias("reserved_at"),
        F.when(held, last + F.make_interval(secs=F.col("wait"))).alias("lease_until"),
        F.when(held, F.concat(F.lit("worker-"), (F.col("user_id") % 4).cast("string"))).alias("reserved_by"),
        F.sha2(F.concat_ws(":", F.col("user_id"), F.col("id")), 256).alias("idempotency_key"),
        F.when(F.col("failures") > 2, "timeout").alias("last_error_code"),
        none("int").alias("last_http_status"),
        none("string").alias("last_error_message"),
        F.col("first_ts").alias("created_at"),
        last.alias("updated_at"),
        F.when(state.isin("succeeded", "dead"), last).alias("finished_at"),
    )


def fetches(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select(
        F.col("user_id").alias("host"), F.col("event_id").alias("id"), "ts",
        F.col("event_type").isin("error", "click").alias("transient"),
    )


def pages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select("page_id", "url", "html")
