import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from pricetrail.plans import chart, live, products as plans, runs as run_plans
from pricetrail.sources import tables

SNAP = ("id bigint, run_id bigint, product_id bigint, captured_at timestamp, price decimal(18,2), "
        "old_price decimal(18,2), promo_flag boolean, in_stock boolean, queue_id bigint")


def at(text):
    return dt.datetime.fromisoformat(text)


def shots(spark, extra=()):
    rows = [
        (88, 14, 501, at("2026-03-23 08:00"), D("21.50"), None, False, True, None),
        (101, 21, 501, at("2026-03-24 11:00"), D("19.90"), D("24.50"), True, True, None),
        (133, 27, 501, at("2026-03-25 09:30"), D("22.10"), D("22.10"), False, False, None),
    ]
    return spark.createDataFrame(rows + list(extra), SNAP)


def test_analytics_numbers(spark):
    chosen = spark.createDataFrame([(101,)], "snapshot_id bigint")
    row = plans.product_analytics(shots(spark), chosen).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.history_points_count, r.price_points_count, r.promo_moments_count, r.in_stock_moments_count) == (3, 3, 1, 2)
    assert (r.selected_price, r.previous_price, r.first_observed_price, r.latest_observed_price) == (
        D("19.90"), D("21.50"), D("21.50"), D("22.10"))
    assert (r.min_price, r.max_price, r.average_price, r.price_spread) == (D("19.90"), D("22.10"), D("21.17"), D("2.20"))
    assert (r.change_from_previous_amount, r.change_from_previous_percent) == (D("-1.60"), D("-7.4"))
    assert (r.change_from_first_amount, r.change_from_first_percent) == (D("-1.60"), D("-7.4"))


def test_previous_price_skips_missing_and_ties_break_by_id(spark):
    extra = [
        (140, 30, 501, at("2026-03-26 00:00"), None, None, False, False, None),
        (150, 31, 501, at("2026-03-27 00:00"), D("0.00"), None, False, True, None),
        (151, 31, 501, at("2026-03-27 00:00"), D("5.00"), None, False, True, None),
        (900, 31, 9, at("2026-03-27 00:00"), None, None, False, True, None),
    ]
    got = {r.snapshot_id: r for r in plans.product_analytics(shots(spark, extra)).collect()}
    assert got[150].previous_price == D("22.10")
    assert got[151].previous_price == D("0.00") and got[151].change_from_previous_percent is None
    assert got[88].previous_price is None and got[900].average_price is None
    assert got[140].change_from_first_amount is None


def test_points_are_paged_in_capture_order(spark):
    runs = spark.createDataFrame([(14, "daily"), (21, None)], "id bigint, source string")
    pages = plans.price_points(shots(spark), runs, page_size=2).collect()
    by_page = {p.page_no: [(x.snapshot_id, x.source) for x in p.points] for p in pages}
    assert by_page == {0: [(88, "daily"), (101, "shop")], 1: [(133, "shop")]}


def products(spark):
    return spark.createDataFrame(
        [(501, "SKU-11", "Tomato", "https://shop.example/tomato", "tomato", D("1"), "kg", at("2026-03-01"), None)],
        "id bigint, external_id string, name string, url string, slug string, pack_value decimal(18,6), "
        "pack_unit string, created_at timestamp, updated_at timestamp")


def card_snapshot(spark):
    return spark.createDataFrame(
        [(101, 7, 501, at("2026-03-24 11:00"), D("49.90"), D("59.90"), True, True, None)], SNAP)


def test_card_and_grid(spark):
    runs = spark.createDataFrame([], "id bigint, source string")
    card = plans.product_details(card_snapshot(spark), products(spark), runs).first()
    assert (card.unit, card.discount_percent, card.sku, card.source, card.brand) == ("1 kg", D("16.7"), "SKU-11", "shop", None)
    row = plans.products_grid(card_snapshot(spark), products(spark)).first()
    assert (row.price, row.unit, row.sku) == (D("49.90"), "1 kg", "SKU-11")
    head, pages = plans.product_analysis(card_snapshot(spark), products(spark), runs)
    both = head.first()
    assert both.product_card.name == "Tomato" and both.analytics.history_points_count == 1 and both.history_pages == 1
    text = tables.json_payload(head).first().payload
    assert '"productCard":{"id":501' in text and '"averagePrice":49.90' in text and '"brand":null' in text


LIVE = ("url string, live_status string, has_live_card boolean, issue_code string, live_name string, "
        "live_sku string, live_current_price decimal(18,2), live_old_price decimal(18,2), "
        "live_promo_flag boolean, live_in_stock boolean, live_unit string, live_slug string")


def test_live_comparison(spark):
    runs = spark.createDataFrame([], "id bigint, source string")
    details = plans.product_details(card_snapshot(spark), products(spark), runs)
    url = "https://shop.example/tomato"
    good = spark.createDataFrame([(url, "success", True, None, "Tomato Premium", "sku-11 ", D("47.90"), D("59.90"), True, True, "1 kg", "tomato")], LIVE)
    row = live.live_comparison(details, good).first()
    assert row.changed_fields == 2 and row.name_changed and row.current_price_changed and not row.sku_changed
    bad = spark.createDataFrame([(url, "error", False, "timeout") + (None,) * 8], LIVE)
    row = live.live_comparison(details, bad).first()
    assert (row.live_status, row.issue_code, row.changed_fields) == ("error", "timeout", None)


def test_live_cards_met_by_product_give_the_same_rows(spark):
    runs = spark.createDataFrame([(7, "web"), (7, "twice")], "id bigint, source string")
    url = "https://shop.example/tomato"
    cards = spark.createDataFrame([
        (url, "success", True, None, "Tomato Premium", "sku-11 ", D("47.90"), D("59.90"), True, True, "1 kg", "tomato"),
        (url, "error", False, "timeout") + (None,) * 8, (None, "success", True) + (None,) * 9,
    ], LIVE)
    shot = card_snapshot(spark)
    expected = live.live_comparison(plans.product_details(shot, products(spark), runs), cards).collect()
    got = live.live_comparison(plans.product_details(shot, products(spark), runs, beside=cards)).collect()
    assert len(got) == 4 and sorted(map(str, got)) == sorted(map(str, expected))


def test_runs_are_met_before_product_texts(spark):
    runs = spark.createDataFrame([(7, "web")], "id bigint, source string")
    plan = plans.product_details(card_snapshot(spark), products(spark), runs)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    # The outer join is the product's: the shuffle by run carries snapshots only.
    assert "Inner" in joins[0] and "LeftOuter" in joins[1]


def test_tree(spark):
    rows = spark.createDataFrame(
        [(21, at("2026-03-24 10:00"), None, "ok", 5, 4, 1), (18, at("2026-03-24 08:45"), None, "error", 3, 1, 2),
         (14, at("2026-03-23 17:30"), None, "ok", 2, 2, 0)],
        "id bigint, started_at timestamp, finished_at timestamp, status string, items_count bigint, "
        "successful_count bigint, failed_count bigint")
    nodes = run_plans.in_tree_order(run_plans.tree_nodes(rows)).collect()
    assert [n.id for n in nodes] == [
        "date:2026-03-24", "run:21", "run:21:successful", "run:21:failed", "run:18", "run:18:successful",
        "run:18:failed", "date:2026-03-23", "run:14", "run:14:successful"]
    named = {n.id: n for n in nodes}
    assert named["date:2026-03-24"].title == "24.03.2026 (2)"
    assert named["run:21"].items_count == 5 and named["run:21"].parent_id == "date:2026-03-24"
    assert named["run:21:successful"].title == "Successful snapshots (4)"
    assert named["run:18:failed"].title == "Failed snapshots (2)"


def test_snapshot_scopes(spark):
    rows = spark.createDataFrame(
        [(101, 7, 1, at("2026-03-24"), D("1"), None, False, True, None),
         (102, 7, 2, at("2026-03-24"), D("1"), None, False, True, None)], SNAP)
    errors = spark.createDataFrame([(7, 2), (7, 2), (7, None), (8, 1)], "run_id bigint, product_id bigint")
    grid = lambda scope: [(r.id, r.status) for r in run_plans.snapshots_grid(rows, errors, scope, 7).collect()]
    assert grid("successful") == [(101, "OK")]
    assert grid("Failed ") == [(102, "Failed")]
    assert sorted(grid(None)) == [(101, "OK"), (102, "Failed")]


def test_trend_text(spark):
    stats = plans.product_analytics(shots(spark)).where("snapshot_id = 101")
    row = chart.chart_summary(stats).first()
    assert row.trend_text == (
        "This price is -7.4% below the first one seen. Since the price before it went "
        "cheaper by -7.4%. Promotions cover 33% and stock covers 67%.")
    assert (row.trend_tone, row.selected_text) == ("success", "19.90 UAH")
    series = chart.chart_series(shots(spark)).orderBy("bucket").collect()
    assert [(s.base_unit, s.price) for s in series][0] == ("hours", D("21.50"))
