"""Every registered query: (spark, table folder) to a flat, comparable result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks import derived
from pricetrail import schemas
from pricetrail.functions import display, fetch, pricing, sql, status, text, urls
from pricetrail.operators import (
    breaker, crawl, discovery, extract, grid, history, identity, legacy, observations, queue, routing,
)
from pricetrail.operators.numbering import numbered
from pricetrail.plans import chart, health, live, products as product_plans, runs as run_plans
from pricetrail.session import cut, ensure_checkpoint_dir
from pricetrail.sources import buckets, config, documents, star_schema as star, tables
from pricetrail.streaming import observations as stream_store, queue_status

AS_OF = "2024-01-20 00:00:00"
BATCH_START = "1996-01-01 00:00:00"
SECOND_BATCH = "1997-06-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def as_of(value: str = AS_OF):
    return F.expr(f"timestamp_ntz '{value}'")


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, times without zone, dates as text."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(name: str):
    def keep(fn):
        QUERIES[name] = lambda spark, root: plain(fn(spark, root))
        return fn

    return keep


# --- runs and snapshots -------------------------------------------------------------


@query("q1_runs_grid")
def _(spark, root):
    return run_plans.runs_grid(star.runs(spark, root), star.snapshots(spark, root))


@query("q1_runs_grid_page")
def _(spark, root):
    rows = run_plans.runs_grid(star.runs(spark, root), star.snapshots(spark, root))
    page, _ = grid.grid_query(
        rows, filters=[("items_count", "gte", 2), ("status", "neq", "running")],
        search=("7", ["id", "city", "status"]),
        sort=[("items_count", "desc"), ("status", ""), ("started_at", "desc"), ("id", "asc")],
        page=2, page_size=50,
    )
    return page


@query("q1_runs_grid_total")
def _(spark, root):
    rows = run_plans.runs_grid(star.runs(spark, root), star.snapshots(spark, root))
    return grid.grid_query(
        rows, filters=[("items_count", "gte", 2), ("status", "neq", "running")],
        search=("7", ["id", "city", "status"]),
    )[1]


@query("q2_runs_tree")
def _(spark, root):
    nodes = run_plans.runs_tree(
        star.runs(spark, root), star.snapshots(spark, root), star.error_keys(spark, root)
    )
    return nodes.select(
        "id", "parent_id", "node_type", "title", "run_id", "snapshot_scope", "started_at",
        "finished_at", "status", "items_count", "place",
    )


def _grid(scope):
    def run(spark, root):
        return run_plans.snapshots_grid(
            star.snapshots(spark, root), star.error_keys(spark, root), scope
        ).withColumn(
            "strong_discount", pricing.strong_discount(F.col("promo_flag"), F.col("discount_percent"))
        )

    return run


query("q3_snapshots_grid")(_grid(None))
query("q3_snapshots_grid_successful")(_grid(" Successful "))
query("q3_snapshots_grid_failed")(_grid("FAILED"))


# --- products -----------------------------------------------------------------------


@query("q4_products_grid")
def _(spark, root):
    return product_plans.products_grid(star.snapshots(spark, root), star.products(spark, root))


@query("q5_product_details")
def _(spark, root):
    return product_plans.product_details(
        star.snapshots(spark, root), star.products(spark, root), star.runs(spark, root)
    )


@query("o1_tree_order")
def _(spark, root):
    nodes = run_plans.runs_tree(
        star.runs(spark, root), star.snapshots(spark, root), star.error_keys(spark, root)
    )
    return numbered(nodes, run_plans.tree_order(), "position").select("id", "position")


@query("o2_newest_first")
def _(spark, root):
    rows = product_plans.product_history(star.snapshots(spark, root), star.runs(spark, root))
    return numbered(rows, product_plans.newest_first_order(), "position").select("id", "product_id", "position")


@query("q6_product_history")
def _(spark, root):
    shots = star.snapshots(spark, root)
    newest = history.latest_snapshots(shots).where("promo_flag").select(F.col("id").alias("snapshot_id"))
    return product_plans.product_history(shots, star.runs(spark, root), newest)


@query("q6_product_history_all")
def _(spark, root):
    return product_plans.product_history(star.snapshots(spark, root), star.runs(spark, root))


@query("q7_product_analytics")
def _(spark, root):
    return product_plans.product_analytics(
        star.snapshots(spark, root), probe=star.product_probe(spark, root)
    )


@query("q7_product_analytics_split")
def _(spark, root):
    """The same answer when nearly every product is treated as too large for one task."""
    return product_plans.product_analytics(
        star.snapshots(spark, root), probe=star.product_probe(spark, root), hot_rows=40
    )


@query("q8_product_analysis")
def _(spark, root):
    head, _ = product_plans.product_analysis(
        star.snapshots(spark, root), star.products(spark, root), star.runs(spark, root),
        page_size=20, probe=star.product_probe(spark, root),
    )
    return head.select(
        "snapshot_id", "product_id", "history_pages",
        F.col("product_card.name").alias("name"), F.col("product_card.unit").alias("unit"),
        F.col("product_card.discount_percent").alias("discount_percent"),
        F.col("analytics.average_price").alias("average_price"),
        F.col("analytics.previous_price").alias("previous_price"),
        F.col("analytics.change_from_first_percent").alias("change_from_first_percent"),
    )


@query("q8_history_pages")
def _(spark, root):
    _, pages = product_plans.product_analysis(
        star.snapshots(spark, root), star.products(spark, root), star.runs(spark, root),
        page_size=20, probe=star.product_probe(spark, root),
    )
    return pages.select(
        "product_id", "page_no", F.size("points").cast("bigint").alias("points"),
        F.array_join(F.transform("points", product_plans.point_text), ",").alias("point_text"),
    )


@query("q9_live_comparison")
def _(spark, root):
    newest = history.latest_snapshots(star.snapshots(spark, root))
    cards = live.live_cards(extract.extract_cards(derived.product_pages(spark, root)))
    return live.live_comparison(
        product_plans.product_details(newest, star.products(spark, root), star.runs(spark, root), beside=cards)
    )


@query("q9_live_comparison_all")
def _(spark, root):
    cards = live.live_cards(extract.extract_cards(derived.product_pages(spark, root)))
    return live.live_comparison(product_plans.product_details(
        star.snapshots(spark, root), star.products(spark, root), star.runs(spark, root), beside=cards
    ))


@query("q10_chart_summary")
def _(spark, root):
    return chart.chart_summary(
        product_plans.product_analytics(
            star.snapshots(spark, root), probe=star.product_probe(spark, root)
        )
    )


@query("q10_chart_series")
def _(spark, root):
    return chart.chart_series(star.snapshots(spark, root))


@query("q10_selected_series")
def _(spark, root):
    shots = star.snapshots(spark, root)
    newest = history.latest_snapshots(shots).select("product_id", F.col("id").alias("selected_id"))
    points = shots.join(newest, "product_id")
    return history.selected_series(points, F.col("selected_id")).select(
        "product_id", "id", "price", "selected_price"
    )


# --- health -------------------------------------------------------------------------


@query("q11_status_counts")
def _(spark, root):
    return health.status_counts(star.runs(spark, root)).withColumn("kind", F.lit("run")).unionByName(
        health.status_counts(star.queue(spark, root)).withColumn("kind", F.lit("queue"))
    )


@query("q11_table_counts")
def _(spark, root):
    return health.table_counts(
        {
            "crawler_run": star.runs(spark, root), "product": star.products(spark, root),
            "price_snapshot": star.snapshots(spark, root),
            "price_collect_queue": star.queue(spark, root), "crawl_error": star.errors(spark, root),
        }
    )


@query("q12_coverage_calendar")
def _(spark, root):
    return health.coverage_calendar(
        star.products(spark, root), star.runs(spark, root), star.snapshots(spark, root)
    )


@query("q12_missing_days")
def _(spark, root):
    return health.missing_days(
        star.products(spark, root), star.runs(spark, root), star.snapshots(spark, root),
        "1997-03-01", "1997-03-31",
    )


@query("q12_missing_spans")
def _(spark, root):
    return health.missing_spans(
        star.products(spark, root), star.runs(spark, root), star.snapshots(spark, root)
    )


# --- history operators --------------------------------------------------------------


@query("w1_reference_prices")
def _(spark, root):
    return history.with_reference_prices(
        star.snapshots(spark, root), star.product_probe(spark, root)
    ).select(
        "id", "previous_price", "first_observed_price", "latest_observed_price",
        "change_from_previous_amount", "change_from_previous_percent",
        "change_from_first_amount", "change_from_first_percent",
    )


@query("w4_change_points")
def _(spark, root):
    return history.change_points(star.snapshots(spark, root), star.product_probe(spark, root)).select(
        "id", "product_id", "captured_at", "price", "old_price", "promo_flag", "in_stock"
    )


@query("w4_change_points_split")
def _(spark, root):
    return history.change_points(
        star.snapshots(spark, root), star.product_probe(spark, root), hot_rows=40
    ).select("id", "product_id", "captured_at", "price", "old_price", "promo_flag", "in_stock")


@query("w5_latest_snapshot")
def _(spark, root):
    return history.latest_snapshots(star.snapshots(spark, root)).select(
        "product_id", "id", "captured_at", "price", "in_stock"
    )


@query("w6_distinct_on")
def _(spark, root):
    rows = star.errors(spark, root).select("run_id", "product_id", "created_at", "id")
    return history.distinct_on(
        rows, F.col("run_id"), [F.desc_nulls_last("created_at"), F.desc("id")]
    )


@query("w7_first_wins")
def _(spark, root):
    rows = star.table(spark, root, "documents").select(
        F.col("doc_id").alias("pos"), F.upper("source").alias("word"), "lang"
    )
    return history.first_wins(rows, [F.lower("word"), F.col("lang")], "pos", "word", "lang")


@query("w10_failure_streaks")
def _(spark, root):
    return breaker.failure_streaks(star.fetches(spark, root)).select("host", "id", "transient", "streak")


# --- queue --------------------------------------------------------------------------


def _queue_items(spark, root):
    return star.table(spark, root, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
        F.concat(F.lit(f" \t https://{star.SHOP}/q/"), star.item_id().cast("string"),
                 F.when(F.col("event_type") == "view", "/new").otherwise(""), F.lit("\n")).alias("url"),
    )


@query("t1_enqueue")
def _(spark, root):
    items = queue.build_items(_queue_items(spark, root))
    return queue.enqueue(star.queue(spark, root), items, 0, as_of()).select(
        "id", "run_id", "url", "status", "attempt", "max_attempts", "next_attempt_at",
        "idempotency_key", "created_at",
    )


@query("j11_zip_items")
def _(spark, root):
    arrays = star.table(spark, root, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("urls"),
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))),
                    lambda x: F.md5(x["text"])).alias("idempotency_keys"),
    )
    return queue.zip_items(arrays)


@query("t2_plan_batches")
def _(spark, root):
    return queue.plan_batches(star.queue(spark, root), as_of(), 6, 90, " worker-a ")


@query("t2_plan_batches_split")
def _(spark, root):
    return queue.plan_batches(star.queue(spark, root), as_of(), 6, 90, " worker-a ", hot_rows=5)


@query("o3_next_batch")
def _(spark, root):
    return queue.next_batches(star.queue(spark, root), as_of(), 4).select("id", "run_id", "url", "status", "attempt")


@query("sql_reserve_batch")
def _(spark, root):
    """The table function called from SQL, its arguments by name."""
    sql.register_sql_functions(spark)
    star.queue(spark, root).createOrReplaceTempView("price_collect_queue")
    return spark.sql(
        f"""SELECT id, run_id, url, attempt, max_attempts, idempotency_key, reserved_by FROM queue_reserve_batch(
          worker_id => ' worker-a ', batch_size => 6, as_of => timestamp_ntz '{AS_OF}', queue => TABLE(
            SELECT id, run_id, url, attempt, max_attempts, idempotency_key, status, next_attempt_at, created_at
            FROM price_collect_queue))"""
    )


@query("sql_named_calls")
def _(spark, root):
    """Scalar routines from SQL, their arguments by name and in any order."""
    sql.register_sql_functions(spark)
    star.products(spark, root).createOrReplaceTempView("product")
    return spark.sql(
        """SELECT id, trim_nullable(max_length => 5, value => concat('  ', name)) AS short_name,
          trim_required(value => CASE WHEN id % 3 = 0 THEN '  ' ELSE slug END, max_length => 2) AS short_slug,
          run_status(status => CASE id % 3 WHEN 0 THEN ' OK ' WHEN 1 THEN 'running' ELSE 'odd' END) AS run_status,
          queue_status(status => CASE id % 2 WHEN 0 THEN 'Dead' ELSE 'x' END) AS queue_status,
          CAST(discount_percent(old_price => CAST(id + 10 AS DECIMAL(18,2)), price => CAST(id AS DECIMAL(18,2))) AS DOUBLE) AS off,
          CAST(price_change_percent(target => CAST(id AS DECIMAL(18,2)), base => CAST(id * 2 AS DECIMAL(18,2))) AS DOUBLE) AS change
        FROM product"""
    )


@query("j13_reserve")
def _(spark, root):
    rows = star.queue(spark, root)
    batch = queue.plan_batches(rows, as_of(), 6, 90, "w").where("batch_no = 0")
    return queue.reserve(rows, batch).select(
        "id", "run_id", "status", "reserved_at", "lease_until", "reserved_by", "updated_at"
    )


def _initial_queue(spark, root):
    rows = star.queue(spark, root)
    none = {n: F.lit(None).cast(rows.schema[n].dataType) for n in (
        "next_attempt_at", "reserved_at", "lease_until", "reserved_by", "last_error_code",
        "finished_at",
    )}
    return rows.withColumns(
        none | {"status": F.lit("pending"), "attempt": F.lit(0), "updated_at": F.col("created_at")}
    )


def _transitions(spark, root):
    return star.table(spark, root, "events").select(
        star.item_id().alias("queue_id"), star.event_status().alias("kind"),
        F.when(F.col("event_type") == "error", " Timeout ").otherwise("  ").alias("error_code"),
        F.when(F.col("event_type") == "click", 429).alias("http_status"),
        F.concat(F.lit(" event "), F.col("event_id").cast("string"), F.lit(" ")).alias("message"),
        (F.col("ts") + F.expr("INTERVAL 5 SECONDS")).alias("next_attempt_at"),
        F.col("ts").alias("at"), F.col("event_id").alias("seq"),
    )


@query("t3_5_transitions")
def _(spark, root):
    return queue.apply_transitions(_initial_queue(spark, root), _transitions(spark, root)).select(
        "id", "run_id", "status", "attempt", "next_attempt_at", "last_error_code",
        "last_http_status", "last_error_message", "updated_at", "finished_at",
    )


@query("t6_reap_expired")
def _(spark, root):
    return queue.reap_expired(star.queue(spark, root), as_of()).select(
        "id", "status", "attempt", "next_attempt_at", "reserved_at", "lease_until", "reserved_by",
        "last_error_code", "last_error_message", "updated_at",
    )


@query("t7_has_outstanding")
def _(spark, root):
    return queue.has_outstanding(star.queue(spark, root))


@query("t8_queue_stats")
def _(spark, root):
    return queue.queue_stats(star.queue(spark, root))


@query("t8_latest_states")
def _(spark, root):
    return queue.latest_states(star.queue_events(spark, root)).select("run_id", "item_id", "status", "at")


# --- observation store --------------------------------------------------------------


def _arriving(spark, root):
    """Known products, their history before the batch, and the batch."""
    shots = star.snapshots(spark, root)
    cut_at = as_of(BATCH_START)
    small = star.products(spark, root).where(F.col("pack_unit").isNotNull())
    held = shots.where(F.col("captured_at") < cut_at).join(
        small.select(F.col("id").alias("product_id")), "product_id", "left_semi"
    )
    # Products that are not known yet have no history: all their rows arrive.
    known = small.select(F.col("id").alias("l_partkey"), F.lit(True).alias("_known"))
    arriving = star.observations(spark, root, known).where(
        (F.col("observed_at") >= cut_at) | F.col("_known").isNull()
    )
    return arriving, small, held, cut_at


def _store(spark, root):
    arriving, small, held, cut_at = _arriving(spark, root)
    return observations.store_observations(arriving, small, held, now=cut_at)


@query("t9_late")
def _(spark, root):
    """The batch of t9_observation_store out of order: two thirds arrive first, newest first."""
    arriving, small, held, cut_at = _arriving(spark, root)
    turned = arriving.withColumn("seq", F.when(F.col("queue_id") % 3 == 0, F.col("seq")).otherwise(-F.col("seq")))
    return observations.store_observations(turned, small, held, now=cut_at).results


@query("t9_two_batches")
def _(spark, root):
    """The batch in two parts, the second stored over what the first left."""
    arriving, small, held, cut_at = _arriving(spark, root)
    later = F.col("observed_at") >= as_of(SECOND_BATCH)
    one = observations.store_observations(arriving.where(~later), small, held, now=cut_at)
    products, first = cut(one.products), cut(one.snapshots)
    two = observations.store_observations(arriving.where(later), products, held.unionByName(first.select(held.columns)), now=cut_at)
    parts = [one.results.withColumn("batch", F.lit(1)), two.results.withColumn("batch", F.lit(2))]
    return parts[0].unionByName(parts[1])


def _tangled(spark, root):
    """A customer as an observation: many without an address, addresses and ids that mix."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    address = F.when(key % 3 == 0, "").when(key % 7 == 0, F.concat(F.lit("n"), key.cast("string"))).otherwise(
        F.concat(F.lit("u"), (key % 61).cast("string"))
    )
    return star.table(spark, root, "customer").select(
        key.alias("seq"), F.lit(1).cast("bigint").alias("run_id"), key.alias("queue_id"),
        F.when(key % 5 != 0, F.concat(F.lit("e"), (key * 7 % 53 + nation % 2).cast("string"))).alias("external_id"),
        F.lit("n").alias("name"), address.alias("url"), F.lit(None).cast("string").alias("slug"), F.lit(None).cast("decimal(18,6)").alias("pack_value"),
        F.lit(None).cast("string").alias("pack_unit"), F.lit(1).cast("decimal(18,2)").alias("price"), F.lit(None).cast("decimal(18,2)").alias("old_price"),
        F.lit(False).alias("promo_flag"), F.lit(True).alias("in_stock"), F.lit(None).cast("timestamp_ntz").alias("observed_at"),
    )


@query("t9_tangled")
def _(spark, root):
    """Which product each observation meets where addresses and ids tie almost all together."""
    clean = observations.normalize_observations(_tangled(spark, root), as_of())
    suppliers = star.table(spark, root, "supplier")
    known = suppliers.select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("e"), (F.col("s_suppkey") % 53).cast("string")).alias("external_id"),
        F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("url"),
    )
    base = F.lit(known.agg(F.max("id") + 1).first()[0]).cast("bigint")
    return identity.resolve_products(clean, known, base).select("seq", "product_id")


@query("t9_observation_store")
def _(spark, root):
    return _store(spark, root).results


@query("t9_new_snapshots")
def _(spark, root):
    return _store(spark, root).snapshots


@query("t9_products")
def _(spark, root):
    return _store(spark, root).products


# --- streams, replayed ----------------------------------------------------------------


def _replayed(spark, rows, order, parts=3, files=4):
    """``rows`` as a stream that brings them in ``parts`` triggers by ``order``, and a folder for its results."""
    folder = f"{ensure_checkpoint_dir(spark)}/replay/{uuid.uuid4().hex}"
    files = max(files, spark.sparkContext.defaultParallelism)  # as many tasks write and read a trigger
    share = [i / parts for i in range(1, parts)]
    placed = cut(rows)  # the marks and the parts are looked for in the copy
    marks = placed.agg(F.percentile_approx(order, share, 1000).alias("m")).first()["m"] if share else []
    part = sum(((F.col(order) > m).cast("int") for m in marks or []), F.lit(0))
    for i in range(parts):
        # Dealt by a hash of the row: dealing in turn sorts all rows first.
        placed.where(part == i).repartition(files, *rows.columns).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(placed.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    return stream, folder


def _ended(running):
    running.awaitTermination()
    if running.exception():
        raise running.exception()


def _written(spark, path, schema):
    return spark.read.schema(schema).parquet(path)


@query("st1_changes")
def _(spark, root):
    """Price changes per product on a stream; observations in capture order."""
    shots = star.snapshots(spark, root).withColumn("seq", F.unix_date(F.to_date("captured_at")).cast("bigint") * 281474976710656 + F.col("id").bitwiseAND(281474976710655))
    rows = shots.select("product_id", "seq", F.col("captured_at").alias("observed_at"), "price", "old_price", "promo_flag", "in_stock")
    stream, folder = _replayed(spark, rows, "seq")
    _ended(stream_store.write_changes(stream, f"{folder}/out", f"{folder}/check"))
    kinds = "product_id bigint, seq bigint, observed_at timestamp, price decimal(18,2), old_price decimal(18,2), promo_flag boolean, in_stock boolean"
    return _written(spark, f"{folder}/out", kinds)


@query("s12_stream_products")
def _(spark, root):
    """The product table after the batch of t9_observation_store came as a stream into bucketed tables."""
    arriving, small, held, _ = _arriving(spark, root)
    stream, folder = _replayed(spark, arriving, "seq")
    stream_store.start_tables(small, held, f"{folder}/db", 8)
    _ended(stream_store.store_stream(stream, f"{folder}/db", f"{folder}/check"))
    return buckets.read(spark, f"{folder}/db", "product").select("slug", "external_id", "name", "url", "pack_unit", "created_at", "updated_at")


@query("st2_live_counts")
def _(spark, root):
    events = star.queue_events(spark, root).withColumn("micros", F.unix_micros(F.col("at").cast("timestamp")))
    stream, folder = _replayed(spark, events, "micros")
    _ended(queue_status.start_live_counts(stream, f"{folder}/db", f"{folder}/check"))
    return queue_status.live_counts(spark, f"{folder}/db")


@query("st2_lease_timeouts")
def _(spark, root):
    """Leases that ran out before the newest event; all events come in one trigger, so what counts is where they end."""
    lease = F.when(F.col("transition") == "reserved", F.col("at") + F.make_interval(secs=F.floor("value").cast("bigint")))
    events = star.table(spark, root, "events").select(
        F.col("user_id").alias("run_id"), star.item_id().alias("item_id"), star.event_status().alias("transition"), F.col("ts").cast("timestamp").alias("at"), "event_id", "value"
    ).withColumn("lease_until", lease.cast("timestamp")).withColumn("micros", F.unix_micros("at"))
    stream, folder = _replayed(spark, events, "micros", parts=1)
    _ended(queue_status.write_lease_timeouts(stream, f"{folder}/out", f"{folder}/check"))
    return _written(spark, f"{folder}/out", "run_id bigint, item_id bigint, lease_until timestamp")


@query("j7_match_existing")
def _(spark, root):
    clean = observations.normalize_observations(star.observations(spark, root), as_of())
    known = star.products(spark, root).where(F.col("pack_unit").isNotNull())
    from pricetrail.operators.identity import match_existing

    return match_existing(clean, known)


@query("s8_normalize_errors")
def _(spark, root):
    return tables.normalize_errors(star.errors(spark, root), as_of())


# --- routing ------------------------------------------------------------------------


def _raw_issue():
    kind = F.col("event_type")
    return F.struct(
        F.when(kind == "view", "  ").otherwise(" Fetch ").alias("stage"),
        F.when(kind == "error", "timeout").when(kind == "click", "too_many_requests")
        .otherwise("Odd").alias("error_code"),
        F.when(kind == "click", 429).cast("int").alias("http_status"),
        F.concat(F.lit("  m"), F.col("event_id").cast("string"), F.lit(" ")).alias("message"),
        kind.isin("error", "click").alias("is_transient"),
    )


def _processed(spark, root):
    """Each event as a processed queue item: card, partial card or failure."""
    kind = F.col("event_type")
    number = F.col("event_id").cast("string")
    card = F.struct(
        F.concat(F.lit("SKU-"), (F.col("event_id") % 97).cast("string")).alias("external_id"),
        F.concat(F.lit("n"), number).alias("name"),
        F.concat(F.lit(f"https://{star.SHOP}/e/"), (F.col("event_id") % 97).cast("string")).alias("url"),
        F.lit("s").alias("slug"), F.lit(None).cast("decimal(18,6)").alias("pack_value"),
        F.lit(None).cast("string").alias("pack_unit"),
        star.money(star.cents(F.col("value"))).alias("price"),
        F.lit(None).cast("decimal(18,2)").alias("old_price"),
        F.lit(False).alias("promo_flag"), F.lit(True).alias("in_stock"),
    )
    return star.table(spark, root, "events").select(
        F.col("event_id").alias("seq"), F.col("event_id").alias("queue_id"),
        F.col("user_id").alias("run_id"),
        F.concat(F.lit(f"https://{star.SHOP}/q/"), number).alias("url"),
        (F.col("event_id") % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"),
        (F.col("event_id") % 700).cast("int").alias("jitter_ms"),
        F.when(kind.isin("purchase", "view"), card).alias("card"),
        F.when(kind.isin("error", "click", "view"), _raw_issue()).alias("issue"),
    )


@query("t11_failure_routing")
def _(spark, root):
    *_, failed = routing.route_items(_processed(spark, root), as_of())
    moves, _ = routing.route_failures(failed, as_of(), 500, 5000)
    return moves.drop("at")


@query("t11_dead_errors")
def _(spark, root):
    *_, failed = routing.route_items(_processed(spark, root), as_of())
    return routing.route_failures(failed, as_of(), 500, 5000)[1]


@query("t12_item_routing")
def _(spark, root):
    seen, partial, done, failed = routing.route_items(_processed(spark, root), as_of())
    parts = [
        seen.select(F.lit("observation").alias("kind"), "queue_id", F.col("name").alias("info")),
        partial.select(F.lit("partial").alias("kind"), "queue_id",
                       F.concat_ws("/", "url", "error_code", "error_message").alias("info")),
        done.select(F.lit("succeeded").alias("kind"), "queue_id", F.lit("").alias("info")),
        failed.select(F.lit("failed").alias("kind"), "queue_id",
                      F.concat_ws("/", "issue.stage", "issue.error_code", "issue.message").alias("info")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _crawled(spark, root):
    """Events as the items of one crawl, processed in two batches; what is left and how the runs end."""
    results = _processed(spark, root)
    none = {n: F.lit(None).cast(t) for n, t in (
        ("next_attempt_at", "timestamp_ntz"), ("reserved_at", "timestamp_ntz"), ("lease_until", "timestamp_ntz"), ("reserved_by", "string"),
        ("last_error_code", "string"), ("last_http_status", "int"), ("last_error_message", "string"), ("finished_at", "timestamp_ntz"),
    )}
    items = results.select(
        F.col("queue_id").alias("id"), "run_id", "url", F.lit("reserved").alias("status"), "attempt", "max_attempts",
        F.lit("").alias("idempotency_key"), as_of().alias("created_at"), as_of().alias("updated_at"), *[c.alias(n) for n, c in none.items()],
    )
    state = crawl.CrawlTables(
        items, *(spark.createDataFrame([], kind) for kind in (schemas.PRODUCT, schemas.PRICE_SNAPSHOT)),
        spark.createDataFrame([], schemas.CRAWL_ERROR),
    )
    for part in (0, 1):
        state = crawl.process_results(state, results.where(F.col("queue_id") % 2 == part), as_of(), 500, 5000)
    return state, results


@query("run_crawl")
def _(spark, root):
    state, results = _crawled(spark, root)
    plans = results.groupBy("run_id").agg(F.lit("Sitemap").alias("discovery_kind"), F.count("*").alias("queued"), F.count("*").alias("enqueued"))
    runs = routing.start_runs(results.groupBy("run_id").agg(as_of().alias("at")).withColumn("source", F.lit("sitemap")))
    outcomes, ended = crawl.finish_crawls(state, runs, plans, as_of())
    return outcomes.select("run_id", "source", "products_processed", "errors", "note").join(
        ended.select(F.col("id").alias("run_id"), "status", "finished_at"), "run_id"
    )


@query("run_crawl_errors")
def _(spark, root):
    return _crawled(spark, root)[0].errors.select("run_id", "queue_id", "product_id", "url", "error_code", "http_status", "error_message")


@query("t10_finish_runs")
def _(spark, root):
    orders = star.table(spark, root, "orders")
    started = routing.start_runs(orders.select(
        F.col("o_orderkey").alias("run_id"), F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("source"),
        F.col("o_orderdate").alias("at"),
    ))
    code = F.col("o_orderstatus")
    ends = orders.where(code != "P").select(
        F.col("o_orderkey").alias("run_id"),
        F.when(code == "F", " OK ").otherwise("crashed").alias("status"),
        F.when(code == "F", F.concat(F.lit(" cust "), F.col("o_custkey").cast("string"))).otherwise("  ").alias("note"),
        (F.col("o_orderdate") + F.expr("INTERVAL 7 MINUTES")).alias("at"),
    )
    return routing.finish_runs(started, ends)


@query("t10_finish_ingestion_runs")
def _(spark, root):
    orders = star.table(spark, root, "orders")
    runs = orders.select(
        (F.col("o_orderkey") * 10).alias("ingestion_run_id"), F.col("o_orderkey").alias("crawler_run_id"),
        F.col("o_orderdate").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.lit("running").alias("status"), F.lit(None).cast("string").alias("error_code"),
        F.lit(None).cast("string").alias("error_message"),
    )
    code = F.col("o_orderstatus")
    ends = orders.where(code != "P").select(
        (F.col("o_orderkey") * 10).alias("ingestion_run_id"),
        F.when(code == "F", "ok").otherwise("error").alias("status"),
        F.when(code == "O", " crawler_failed ").alias("error_code"),
        F.when(code == "O", F.concat(F.lit(" x"), F.col("o_custkey").cast("string"))).alias("error_message"),
        F.col("o_orderdate").alias("at"),
    )
    return routing.finish_ingestion_runs(runs, ends)


@query("t13_run_outcome")
def _(spark, root):
    plans = star.table(spark, root, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.count("*").alias("queued"), F.count_distinct(star.item_id()).alias("enqueued")
    ).withColumn(
        "discovery_kind", F.when(F.col("run_id") % 2 == 0, "Sitemap").otherwise("CategorySeed")
    )
    return routing.run_outcomes(queue.queue_stats(star.queue(spark, root)), plans)


@query("t14_discovery_failures")
def _(spark, root):
    chosen = discovery.choose_sitemaps(_candidates(spark, root), _candidate_documents(spark, root))
    lost = chosen.where(F.col("sitemap_url").isNull()).select(
        F.xxhash64("site").alias("run_id"), "failure_kinds", "site"
    )
    rows = lost.select(
        "site", "run_id", F.lit("ProductUrlDiscoveryUnavailable").alias("error_code"),
        F.concat(F.lit(" none: "), F.col("failure_kinds")).alias("message"), as_of().alias("at"),
    )
    return routing.discovery_failures(rows.withColumn("run_id", F.length("site").cast("bigint")))


# --- discovery ----------------------------------------------------------------------


def _candidates(spark, root):
    return discovery.sitemap_candidates(
        derived.candidate_sites(spark, root), derived.candidate_robots(spark, root),
        f"https://{star.SHOP}/",
    )


def _candidate_documents(spark, root):
    return documents.sitemap_documents(derived.candidate_responses(spark, root))


@query("s4_sitemap_kinds")
def _(spark, root):
    return _candidate_documents(spark, root).select(
        "url", "failure_kind", "root", F.size("locs").alias("locs")
    )


@query("s5_sitemap_locs")
def _(spark, root):
    docs = documents.sitemap_documents(derived.sitemap_responses(spark, root), ["/FR/", "#top"])
    return docs.where("root = 'urlset'").select(F.explode("locs").alias("loc"))


@query("s6_robots")
def _(spark, root):
    return derived.candidate_robots(spark, root).select(
        "url", F.posexplode(documents.robots_sitemaps(F.col("body"))).alias("pos", "sitemap")
    )


@query("t15_sitemap_candidates")
def _(spark, root):
    return discovery.choose_sitemaps(_candidates(spark, root), _candidate_documents(spark, root))


@query("t16_sitemap_walk")
def _(spark, root):
    docs = documents.sitemap_documents(derived.sitemap_responses(spark, root))
    return discovery.walk_sitemaps(derived.sitemap_roots(spark, root), docs, 20_000)[0]


def _capped(spark, root):
    docs = documents.sitemap_documents(derived.capped_responses(spark, root))
    return discovery.walk_sitemaps(derived.capped_roots(spark, root), docs, derived.MAX_CAPPED, derived.MAX_TOP)


@query("t16_sitemap_walk_capped")
def _(spark, root):
    return _capped(spark, root)[0]


@query("t16_sitemap_walk_failures")
def _(spark, root):
    return _capped(spark, root)[1].select("site", "failed_url", "failure_kind")


def _walk(spark, root):
    docs = discovery.category_documents(derived.category_pages(spark, root), star.SHOP)
    return discovery.walk_categories(derived.category_seeds(spark, root), docs, derived.MAX_PAGES)


@query("t17_category_walk")
def _(spark, root):
    return _walk(spark, root)[1]


@query("t17_category_urls")
def _(spark, root):
    return _walk(spark, root)[0]


@query("s3_category_seeds")
def _(spark, root):
    entries = star.pages(spark, root).select(
        F.col("page_id").alias("pos"),
        F.when(F.col("page_id") % 13 == 0, "  ").otherwise(F.concat(F.lit(" page "), F.col("page_id").cast("string"))).alias("name"),
        F.when(F.col("page_id") % 17 == 0, "").when(F.col("page_id") % 19 == 0, "no url")
        .when(F.col("page_id") % 3 == 0, F.col("url"))
        .otherwise(F.concat(F.lit(" HTTPS://SHOP.example/"), F.substring("url", -3, 2),
                            F.lit("?a=1#b"))).alias("url"),
    )
    rows = config.classify_seeds(entries, star.SHOP)
    good, bad = config.category_seeds(entries, star.SHOP)
    none = F.lit(None).cast("string")
    return good.withColumn("reject_reason", none).unionByName(
        bad.select("pos", "name", none.alias("seed_url"), "reject_reason")
    )


@query("s2_url_exclusions")
def _(spark, root):
    words = star.table(spark, root, "documents").select(
        F.col("doc_id").alias("pos"),
        F.when(F.col("doc_id") % 5 == 0, "  ").when(F.col("doc_id") % 2 == 0, F.upper("lang"))
        .otherwise(F.concat(F.lit(" "), "lang", F.lit("\t"))).alias("word"),
    )
    return config.distinct_words(words)


@query("t18_url_filter")
def _(spark, root):
    rows = star.pages(spark, root).select(
        F.regexp_extract("url", r"([a-z]+)/?[^/]*$", 1).alias("_x"),
        F.when(F.col("url").startswith("https"), "sitemap").otherwise("category-seed").alias("source"),
        F.col("page_id").alias("pos"), F.regexp_replace("url", "/[a-z][a-z]/", "/EN/").alias("url"),
    ).drop("_x")
    return discovery.filter_product_urls(rows, "/en/", ["Blog", "m."], 200, 20_000)


@query("u9_choose_source")
def _(spark, root):
    rows = derived.sited_pages(spark, root).select(
        F.col("site").alias("crawl"),
        F.when(F.col("url").contains("#"), "sitemap").otherwise("category-seed").alias("kind"),
        F.col("page_id").alias("pos"), "url",
    )
    return discovery.choose_source(rows, ["sitemap", "category-seed"])


# --- extraction ---------------------------------------------------------------------


@query("t19_product_cards")
def _(spark, root):
    cards = extract.extract_cards(derived.product_pages(spark, root))
    return extract.flat_cards(cards)


@query("t19_page_cards")
def _(spark, root):
    cards = extract.extract_cards(star.pages(spark, root))
    return extract.flat_cards(cards).select("page_id", "page_url", "has_card", "error_code", "is_transient")


@query("t19_page_text")
def _(spark, root):
    from pricetrail.functions import parsing

    rows = parsing.with_page_text(star.pages(spark, root))
    return rows.select(
        "page_id", F.col("_title").alias("title"), F.col("_heading").alias("heading"),
        F.length("_text").cast("bigint").alias("text_length"), F.md5("_text").alias("text_digest"),
    )


@query("f12_page_anchors")
def _(spark, root):
    from pricetrail.operators.anchors import anchors, product_hrefs

    found = star.pages(spark, root).withColumn("a", anchors(F.col("html")))
    return found.select(
        "page_id", F.posexplode(product_hrefs(F.col("a"))).alias("pos", "href")
    ).select("page_id", "pos", "href", urls.resolve(F.col("href"), F.lit("https://shop.example/x/y")).alias("resolved"))


@query("f13_next_links")
def _(spark, root):
    """Links to the next page: six selectors, else the four texts; what the page marks in the way it does."""
    from pricetrail.operators.anchors import anchors, next_hrefs

    found = derived.pager_pages(spark, root).withColumn("a", anchors(F.col("html")))
    return found.select("page_id", F.posexplode(next_hrefs(F.col("a"))).alias("pos", "href"))


# --- reports and legacy -------------------------------------------------------------


@query("t21_breaker_report")
def _(spark, root):
    return breaker.breaker_report(star.fetches(spark, root), 3)


@query("t21_breaker_trips")
def _(spark, root):
    return breaker.breaker_trips(star.fetches(spark, root), 3, 60)


@query("t21_breaker_trips_split")
def _(spark, root):
    return breaker.breaker_trips(star.fetches(spark, root), 3, 60, hot_rows=80)


def _legacy(spark, root):
    parts = star.table(spark, root, "part")
    lines = star.table(spark, root, "lineitem")
    orders = star.table(spark, root, "orders")
    key = F.col("p_partkey")
    old_products = parts.select(
        key.alias("product_key"),
        F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.concat(F.lit(" SKU-"), key.cast("string"))).alias("product_id"),
        F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("p_size") % 5 == 0, "").otherwise(
            F.concat(F.lit(" https://shop.example/c/"), F.col("p_brand"), F.lit("/"), F.col("p_size").cast("string"),
                     F.when(F.col("p_type") == "PROMO", "/?x=1/y").otherwise("/"))
        ).alias("url"),
        (F.col("p_size").cast("decimal(18,0)") / 4).alias("pack_value"), F.lower("p_type").alias("pack_unit"),
        F.when(F.col("p_size") % 2 == 0, F.expr("timestamp_ntz '2023-05-05 00:00:00'")).alias("created_at"),
        F.when(F.col("p_size") % 7 != 0, F.expr("timestamp_ntz '2024-01-01 00:00:00'")
               + F.make_interval(mins=(key % 50).cast("int"))).alias("last_seen_at"),
    )
    current = parts.where("p_size % 5 <> 0 and p_type = 'SMALL'").select(
        F.concat(F.lit("https://shop.example/c/"), "p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit("/")).alias("url"),
        F.lit("OLD").alias("external_id"), F.lit("kept").alias("slug"), "p_partkey",
    ).groupBy("url", "external_id", "slug").agg((F.min("p_partkey") + 1_000_000).alias("id")).select(
        "id", "external_id", F.lit("old name").alias("name"), "url", "slug",
        F.lit(1).cast("decimal(18,6)").alias("pack_value"), F.lit("kg").alias("pack_unit"),
        F.expr("timestamp_ntz '2020-01-01 00:00:00'").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    full = star.cents(F.col("l_extendedprice"))
    old_snapshots = lines.select(
        star.line_id().alias("snapshot_id"), F.col("l_orderkey").alias("run_id"),
        F.col("l_partkey").alias("product_key"),
        F.when(F.col("l_linenumber") != 2, F.col("l_shipdate")).alias("captured_at"),
        F.when(F.col("l_linenumber") != 3, star.money(full)).alias("final_price"),
        F.when(F.col("l_linenumber") != 4, star.money(full + 100)).alias("regular_price"),
        F.when(F.col("l_linenumber") != 5, F.col("l_discount") > 0).alias("promo_flag"),
        F.when(F.col("l_linenumber") != 6, F.col("l_linestatus") == "O").alias("in_stock"),
        F.col("l_suppkey").alias("queue_id"),
    )
    old_errors = lines.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("queue_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("product_key"),
        star.line_id().alias("price_snapshot_id"),
        F.when(F.col("l_linenumber") < 4, " timeout ").otherwise(" ").alias("error_code"),
        F.lit(" late ").alias("error_message"),
        F.when(F.col("l_linenumber") != 5, F.col("l_shipdate")).alias("occurred_at"),
    )
    old_runs = orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.when(F.col("o_orderstatus") == "P", "0").when(F.col("o_orderstatus") == "F", "1")
        .otherwise("failed").alias("status"),
        F.col("o_orderpriority").alias("source"), F.lit(None).cast("string").alias("note"),
    )
    stored_runs = star.runs(spark, root).where("status = 'running'")
    old_ingestion = orders.select(
        (F.col("o_orderkey") * 10).alias("ingestion_run_id"), F.col("o_orderkey").alias("crawler_run_id"),
        F.col("o_orderdate").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_code"),
        F.lit(None).cast("string").alias("error_message"),
    )
    rows = star.queue(spark, root)
    old_queue = rows.withColumnRenamed("id", "queue_id").withColumns({
        "status": F.when(F.col("status") != "pending", F.col("status")),
        "max_attempts": F.lit(None).cast("int"),
    })
    return legacy.consolidate(
        {
            "product": current, "price_snapshot": star.snapshots(spark, root).where("old_price is null"),
            "crawler_run": stored_runs, "ingestion_run": old_ingestion.where("crawler_run_id < 0"),
            "price_collect_queue": rows.where("status = 'dead'"),
        },
        {
            "product": old_products, "price_snapshot": old_snapshots, "product_errors": old_errors,
            "crawler_run": old_runs, "ingestion_run": old_ingestion, "price_collect_queue": old_queue,
        },
        as_of(),
    )


@query("t20_legacy_products")
def _(spark, root):
    return _legacy(spark, root).products


@query("t20_legacy_snapshots")
def _(spark, root):
    return _legacy(spark, root).snapshots


@query("t20_legacy_errors")
def _(spark, root):
    return _legacy(spark, root).errors


@query("t20_legacy_runs")
def _(spark, root):
    return _legacy(spark, root).runs


@query("t20_legacy_queue")
def _(spark, root):
    return _legacy(spark, root).queue.select(
        "id", "run_id", "status", "attempt", "max_attempts", "created_at"
    )


# --- scalar functions ---------------------------------------------------------------


@query("p_text")
def _(spark, root):
    raw = F.when(F.col("doc_id") % 9 == 0, "   ").otherwise(F.concat(F.lit("  "), "text", F.lit(" \t")))
    rows = star.table(spark, root, "documents").select("doc_id", raw.alias("v"))
    v = F.col("v")
    return rows.select(
        "doc_id", F.md5(text.trim_nullable(v, 40)).alias("trim_nullable"),
        F.md5(text.trim_required(v, 40)).alias("trim_required"),
        F.md5(text.strip_and_cut(v, 1024)).alias("strip_and_cut"),
        F.md5(text.trim_message(v)).alias("trim_message"), text.is_blank(v).alias("is_blank"),
        text.trim_nullable(v, 0).alias("nothing"),
    )


@query("p_status")
def _(spark, root):
    word = F.when(F.col("event_type") == "view", " RESERVED ").when(F.col("event_type") == "click", "Retry") \
        .when(F.col("event_type") == "signup", " Ok").when(F.col("event_type") == "error", "running")
    rows = star.table(spark, root, "events").select("event_id", "event_type", word.alias("w"))
    w = F.col("w")
    card, issue = F.col("event_type") != "error", F.col("event_type").isin("click", "error")
    return rows.select(
        "event_id", status.run_status(w).alias("run_status"), status.queue_status(w).alias("queue_status"),
        status.stored_run_status(F.coalesce(w, F.lit("ok"))).alias("stored_status"),
        status.legacy_run_status((F.col("event_id") % 4).cast("string")).alias("legacy_status"),
        status.outcome_label(card).alias("label"), status.scope_column(F.concat(F.lit(" "), F.when(card, "Failed").otherwise("any"))).alias("scope"),
        status.item_error_code(F.when(card, "timeout").otherwise("Timeout")).alias("code"),
        status.live_status(card, issue).alias("live_status"),
        status.run_source(F.when(card, "CategorySeed").otherwise("Sitemap")).alias("source"),
    )


@query("p_pricing")
def _(spark, root):
    rows = star.snapshots(spark, root)
    price, old = F.col("price"), F.col("old_price")
    return rows.select(
        "id", pricing.discount_percent(price, old).alias("d1"),
        pricing.grid_discount_percent(price, old).alias("d0"),
        pricing.extracted_discount_percent(old, price).alias("di"),
        pricing.price_change_percent(old, price).alias("change"),
        pricing.amount_delta(old, price).alias("delta"),
        pricing.snapshot_price(price, old).alias("shown"),
        pricing.promo_flag(F.lit(None).cast("int"), old, price).alias("promo"),
        pricing.has_valid_state(F.lit("u"), price, old, F.col("in_stock")).alias("valid"),
        pricing.tone(pricing.amount_delta(old, price)).alias("tone"),
        pricing.level_direction(pricing.amount_delta(old, price)).alias("level"),
        pricing.move_direction(pricing.amount_delta(old, price)).alias("move"),
        pricing.signed_price_text(pricing.amount_delta(old, price)).alias("amount_text"),
        pricing.signed_percent_text(pricing.price_change_percent(old, price)).alias("percent_text"),
        pricing.coverage_percent(F.col("run_id") % 7, F.col("product_id") % 5).alias("coverage"),
    )


@query("p_fetch")
def _(spark, root):
    code = F.element_at(F.array(*[F.lit(c) for c in (200, 404, 410, 429, 500, 503, 302)]), (F.col("event_id") % 7 + 1).cast("int"))
    rows = star.table(spark, root, "events").select(
        "event_id", code.alias("http"), (F.col("event_type") == "error").alias("late"),
        (F.col("event_id") % 5 + 1).cast("int").alias("attempt"),
        (F.col("event_id") % 400).cast("int").alias("jitter"), (F.col("event_id") % 2 == 0).alias("ok"),
    )
    out = fetch.classify_http(F.col("http"), F.col("late"), F.col("ok"))
    a, j = F.col("attempt"), F.col("jitter")
    return rows.select(
        "event_id", out["code"].alias("code"), out["transient"].alias("transient"),
        fetch.classify_category_page(F.col("http"), F.when(F.col("ok"), "text/HTML").otherwise("application/json"), F.when(F.col("late"), " \n").otherwise("x")).alias("page_kind"),
        fetch.retry_action(out["transient"], a, F.lit(3)).alias("action"),
        fetch.backoff_ms(a, F.lit(500), F.lit(5000), j).alias("backoff"),
        fetch.queue_retry_delay_ms(out["code"], a, F.lit(500), F.lit(5000), j).alias("queue_delay"),
        fetch.extractor_retry_delay_ms(out["code"], a, F.lit(2500), j).alias("extract_delay"),
    )


@query("p_urls")
def _(spark, root):
    rows = star.pages(spark, root).select("page_id", "url")
    u = F.col("url")
    messy = F.concat(F.lit(" "), F.regexp_replace(u, "^(https?)://([^/]+)/", "HTTP://$2:80/x/../"), F.lit(" "))
    return rows.select(
        "page_id", urls.canonical(u).alias("canonical"), urls.product_url(u).alias("product_url"),
        urls.page_url(u).alias("page_url"), urls.product_url(messy).alias("cleaned"),
        urls.slug(u).alias("slug"), urls.legacy_slug(u).alias("legacy_slug"), urls.host(u).alias("host"),
        urls.on_site(u, "m.ththth.example.net").alias("on_site"), urls.is_absolute(F.substring(u, 5, 99)).alias("cut_absolute"),
        urls.resolve(F.lit("../up/./x?q=1#f"), u).alias("up"), urls.resolve(F.lit("?page=2"), u).alias("next_page"),
        urls.resolve(F.lit("//cdn.example/a b"), u).alias("other_host"),
        urls.idempotency_key(F.col("page_id"), F.concat(F.lit(" "), u)).alias("idempotency_key"),
        urls.looks_like_product(F.concat(F.lit("https://shop.example/"), F.substring(u, -5, 5)), F.lit("https://shop.example/list")).alias("is_product"),
    )


@query("p_display")
def _(spark, root):
    parts = star.products(spark, root)
    return parts.select(
        "id", display.format_unit(F.col("pack_value"), F.col("pack_unit")).alias("unit"),
        display.sku_or_empty(F.when(F.col("id") % 2 == 0, F.col("external_id"))).alias("sku"),
        display.missing_text().alias("brand"),
        status.run_note(F.col("id"), F.lit(2), F.lit(3), F.lit(4), F.lit(5), F.lit(6)).alias("note"),
        pricing.text_differs(F.concat(F.lit(" "), F.upper("name")), F.col("name")).alias("same_text"),
        pricing.value_differs(F.col("pack_value"), F.lit(None).cast("decimal(18,6)")).alias("differs"),
        pricing.shown_rate(F.col("id") / 8).alias("rate"),
    )


@query("s10_json_payload")
def _(spark, root):
    rows = run_plans.runs_grid(star.runs(spark, root), star.snapshots(spark, root)).select("id", "status", "items_count")
    return tables.json_payload(rows)
