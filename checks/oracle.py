"""The expected results as SQL on the same tables, in integer arithmetic where it matters."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"
BATCH_START = "TIMESTAMP '1996-01-01 00:00:00'"
ROOT = "https://shop.example/p/"

VIEWS = f"""
v_run AS (
  SELECT o_orderkey AS id, o_orderdate AS started_at,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 10 MINUTE END AS finished_at,
         CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'running' ELSE 'error' END AS status,
         o_orderpriority AS source
  FROM orders),
v_product AS (
  SELECT p_partkey AS id, 'SKU-' || p_partkey AS external_id, p_name AS name,
         '{ROOT}' || p_partkey AS url, CAST(p_partkey AS VARCHAR) AS slug,
         CASE WHEN p_size % 10 <> 0 THEN p_size * 125 END AS pack_milli,
         CASE WHEN p_type <> 'PROMO' THEN lower(p_type) END AS pack_unit
  FROM part),
v_unit AS (
  SELECT *, CASE WHEN pack_milli IS NULL THEN NULL
                 WHEN pack_milli % 1000 = 0 THEN CAST(pack_milli // 1000 AS VARCHAR)
                 ELSE (pack_milli // 1000) || '.' || rtrim(lpad(CAST(pack_milli % 1000 AS VARCHAR), 3, '0'), '0') END AS shown
  FROM v_product),
v_card AS (
  SELECT *, CASE WHEN shown IS NULL THEN pack_unit WHEN pack_unit IS NULL THEN shown
                 ELSE shown || ' ' || pack_unit END AS unit
  FROM v_unit),
v_line AS (
  SELECT l.*, CAST(round(l_discount * 100) AS BIGINT) AS off,
         CAST(round(p_retailprice * 100) AS BIGINT) AS listc,
         (l_orderkey * 8 + l_linenumber) * 268435456 + (l_partkey * 1000003 + l_suppkey * 10007
              + CAST(round(l_extendedprice * 100) AS BIGINT)) % 268435456 AS id
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
v_snapshot AS (
  SELECT id, l_orderkey AS run_id, l_partkey AS product_id, l_shipdate AS captured_at,
         CASE WHEN l_linenumber <> 7 THEN (listc * (100 - off) + 50) // 100 END AS pc,
         CASE WHEN off > 0 THEN listc END AS oc,
         off > 0 AS promo_flag, l_linestatus = 'O' AS in_stock, l_suppkey AS queue_id
  FROM v_line),
v_error AS (
  SELECT l_orderkey AS run_id, CASE WHEN l_linenumber <> 6 THEN l_partkey END AS product_id
  FROM lineitem WHERE l_returnflag = 'R'),
v_failed AS (SELECT DISTINCT run_id, product_id FROM v_error WHERE product_id IS NOT NULL),
v_status AS (
  SELECT *, user_id * 50 + event_id % 50 AS item,
         CASE event_type WHEN 'view' THEN 'reserved' WHEN 'click' THEN 'retry'
              WHEN 'error' THEN 'dead' WHEN 'purchase' THEN 'succeeded' ELSE 'pending' END AS st
  FROM events),
v_last AS (
  SELECT item AS id, user_id AS run_id, first(st ORDER BY ts DESC, event_id DESC) AS status,
         min(ts) AS first_ts, max(ts) AS last_ts,
         CAST(floor(first(value ORDER BY ts DESC, event_id DESC)) AS BIGINT) AS wait,
         count(*) FILTER (event_type IN ('click', 'error')) AS failures
  FROM v_status GROUP BY item, user_id),
v_queue AS (
  SELECT id, run_id, 'https://shop.example/q/' || id AS url, status,
         least(failures, 3) AS attempt, 3 AS max_attempts,
         CASE WHEN status = 'retry' THEN last_ts + to_seconds(wait) END AS next_attempt_at,
         CASE WHEN status = 'reserved' THEN last_ts END AS reserved_at,
         CASE WHEN status = 'reserved' THEN last_ts + to_seconds(wait) END AS lease_until,
         CASE WHEN status = 'reserved' THEN 'worker-' || (run_id % 4) END AS reserved_by,
         sha256(run_id || ':' || id) AS idempotency_key,
         CASE WHEN failures > 2 THEN 'timeout' END AS last_error_code,
         first_ts AS created_at, last_ts AS updated_at,
         CASE WHEN status IN ('succeeded', 'dead') THEN last_ts END AS finished_at
  FROM v_last),
v_host AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS site FROM pages)
"""


def ratio(num: str, den: str, scale: int = 1) -> str:
    """num / den in units of 1/scale, half away from zero, as a double (den > 0)."""
    n = f"CAST(({num}) * {scale} AS HUGEINT)"
    d = f"CAST(({den}) AS HUGEINT)"
    return f"(CAST(sign({num}) * ((2 * abs({n}) + {d}) // (2 * {d})) AS DOUBLE) / {scale}.0)"


def discount(p: str = "pc", o: str = "oc", scale: int = 10) -> str:
    return f"CASE WHEN {o} > 0 AND {o} > {p} THEN {ratio(f'100 * ({o} - {p})', o, scale)} END"


def change(base: str, target: str) -> str:
    return f"CASE WHEN {base} > 0 THEN {ratio(f'100 * ({target} - {base})', base, 10)} END"


def two(cents: str) -> str:
    return f"(({cents}) / 100.0)"


def grouped(cents: str) -> str:
    """Cents as text with thousands separators."""
    c = f"abs({cents})"
    return f"(replace(format('{{:,}}', {c} // 100), '_', ',') || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"


def signed_pct(v: str) -> str:
    return (
        f"coalesce(CASE WHEN {v} > 0 THEN '+' WHEN {v} < 0 THEN '-' ELSE '' END || "
        f"format('{{:.1f}}', abs({v})) || '%', 'Not available')"
    )


W = "PARTITION BY product_id ORDER BY captured_at, id"
WALL = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"

ANALYTICS = f"""
v_an0 AS (
  SELECT *, last_value(pc IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
         first_value(pc IGNORE NULLS) OVER {WALL} AS firstp,
         last_value(pc IGNORE NULLS) OVER {WALL} AS lastp,
         count(*) OVER (PARTITION BY product_id) AS n, count(pc) OVER (PARTITION BY product_id) AS np,
         count(*) FILTER (promo_flag) OVER (PARTITION BY product_id) AS nprom,
         count(*) FILTER (in_stock) OVER (PARTITION BY product_id) AS nst,
         min(captured_at) OVER (PARTITION BY product_id) AS fc,
         max(captured_at) OVER (PARTITION BY product_id) AS lc,
         min(pc) OVER (PARTITION BY product_id) AS minp, max(pc) OVER (PARTITION BY product_id) AS maxp,
         sum(pc) OVER (PARTITION BY product_id) AS sump
  FROM v_snapshot),
v_an AS (
  SELECT *, CASE WHEN np > 0 THEN ((2 * sump + np) // (2 * np)) / 100.0 END AS avgp,
         {change('prev', 'pc')} AS dprev, {change('firstp', 'pc')} AS dfirst
  FROM v_an0)
"""


def q(body: str, extra: str = "") -> str:
    return f"WITH {VIEWS}{',' + extra if extra else ''} {body}"


ORACLE: dict[str, str] = {}

_grid = """SELECT r.id, r.started_at, r.finished_at, r.status, count(s.id) AS items_count
 FROM v_run r LEFT JOIN v_snapshot s ON s.run_id = r.id GROUP BY ALL"""
ORACLE["q1_runs_grid"] = q(_grid)
_page_where = "items_count >= 2 AND status <> 'running' AND (contains(CAST(id AS VARCHAR), '7') OR contains(status, '7'))"
ORACLE["q1_runs_grid_page"] = q(
    f"SELECT * FROM ({_grid}) WHERE {_page_where} ORDER BY items_count DESC, started_at DESC, id LIMIT 50 OFFSET 50"
)
ORACLE["q1_runs_grid_total"] = q(f"SELECT count(*) AS total FROM ({_grid}) WHERE {_page_where}")

_rows = """v_flag AS (
  SELECT s.run_id, f.run_id IS NOT NULL AS failed FROM v_snapshot s
  LEFT JOIN v_failed f ON f.run_id = s.run_id AND f.product_id = s.product_id),
v_rows AS (
  SELECT r.id, r.started_at, r.finished_at, r.status, count(f.run_id) AS n,
         count(*) FILTER (f.failed = false) AS ok, count(*) FILTER (f.failed) AS bad
  FROM v_run r LEFT JOIN v_flag f ON f.run_id = r.id GROUP BY ALL)"""
_none = "NULL::TIMESTAMP AS started_at, NULL::TIMESTAMP AS finished_at, NULL::VARCHAR AS status"
ORACLE["q2_runs_tree"] = q(
    f"""SELECT 'date:' || strftime(started_at, '%Y-%m-%d') AS id, NULL AS parent_id, 'date' AS node_type,
  strftime(started_at, '%d.%m.%Y') || ' (' || count(*) || ')' AS title, NULL::BIGINT AS run_id,
  'none' AS snapshot_scope, {_none}, count(*) AS items_count, 0 AS place
  FROM v_rows GROUP BY strftime(started_at, '%Y-%m-%d'), strftime(started_at, '%d.%m.%Y')
 UNION ALL SELECT 'run:' || id, 'date:' || strftime(started_at, '%Y-%m-%d'), 'run', 'Run #' || id, id, 'all',
  started_at, finished_at, status, n, 1 FROM v_rows
 UNION ALL SELECT 'run:' || id || ':successful', 'run:' || id, 'successful',
  'Successful snapshots (' || ok || ')', id, 'successful', NULL, NULL, NULL, ok, 2 FROM v_rows
 UNION ALL SELECT 'run:' || id || ':failed', 'run:' || id, 'failed',
  'Failed snapshots (' || bad || ')', id, 'failed', NULL, NULL, NULL, bad, 3 FROM v_rows WHERE bad > 0""",
    _rows,
)


def _snap_grid(where: str) -> str:
    return q(
        f"""SELECT s.id, s.run_id, s.captured_at AS created_at, {two('pc')} AS price, {two('oc')} AS old_price,
  {discount(scale=1)} AS discount_percent, s.promo_flag, s.in_stock,
  CASE WHEN f.run_id IS NULL THEN 'OK' ELSE 'Failed' END AS status,
  coalesce(s.promo_flag AND {discount(scale=1)} > 25, false) AS strong_discount
  FROM v_snapshot s LEFT JOIN v_failed f ON f.run_id = s.run_id AND f.product_id = s.product_id {where}"""
    )


ORACLE["q3_snapshots_grid"] = _snap_grid("")
ORACLE["q3_snapshots_grid_successful"] = _snap_grid("WHERE f.run_id IS NULL")
ORACLE["q3_snapshots_grid_failed"] = _snap_grid("WHERE f.run_id IS NOT NULL")

ORACLE["q4_products_grid"] = q(
    f"""SELECT s.id AS snapshot_id, p.id, p.name, p.external_id AS sku, p.url,
  {two('coalesce(pc, oc)')} AS price, p.unit, NULL::TIMESTAMP AS updated_at
  FROM v_snapshot s JOIN v_card p ON p.id = s.product_id"""
)
_details = f"""SELECT p.id, s.id AS snapshot_id, s.run_id, p.name, p.external_id AS sku, p.url, p.slug, p.unit,
  {two('pc')} AS current_price, {two('oc')} AS old_price, {discount()} AS discount_percent, s.promo_flag,
  s.in_stock, NULL::TIMESTAMP AS updated_at, s.captured_at, coalesce(r.source, 'shop') AS source,
  NULL::VARCHAR AS brand, NULL::VARCHAR AS category, NULL::VARCHAR AS image_url
  FROM v_snapshot s JOIN v_card p ON p.id = s.product_id LEFT JOIN v_run r ON r.id = s.run_id"""
ORACLE["q5_product_details"] = q(_details)

_newest = f"""v_new AS (SELECT * FROM v_snapshot QUALIFY
  row_number() OVER (PARTITION BY product_id ORDER BY captured_at DESC, id DESC) = 1)"""
_hist = f"""SELECT h.product_id, h.id, h.run_id, h.captured_at, {two('h.pc')} AS price, {two('h.oc')} AS old_price,
  {discount('h.pc', 'h.oc')} AS discount_percent, h.promo_flag, h.in_stock, coalesce(r.source, 'shop') AS source
  FROM v_snapshot h LEFT JOIN v_run r ON r.id = h.run_id"""
ORACLE["q6_product_history"] = q(
    _hist + " WHERE h.product_id IN (SELECT product_id FROM v_new WHERE promo_flag)", _newest
)
ORACLE["q6_product_history_all"] = q(_hist)
ORACLE["o1_tree_order"] = q(
    """SELECT id, row_number() OVER (ORDER BY day DESC, st DESC NULLS FIRST, run_id DESC NULLS FIRST, place) - 1 AS position FROM (
  SELECT DISTINCT 'date:' || strftime(started_at, '%Y-%m-%d') AS id, CAST(started_at AS DATE) AS day, NULL::TIMESTAMP AS st, NULL::BIGINT AS run_id, 0 AS place FROM v_rows
  UNION ALL SELECT 'run:' || id, CAST(started_at AS DATE), started_at, id, 1 FROM v_rows
  UNION ALL SELECT 'run:' || id || ':successful', CAST(started_at AS DATE), started_at, id, 2 FROM v_rows
  UNION ALL SELECT 'run:' || id || ':failed', CAST(started_at AS DATE), started_at, id, 3 FROM v_rows WHERE bad > 0)""",
    _rows,
)
ORACLE["o2_newest_first"] = q(
    "SELECT id, product_id, row_number() OVER (ORDER BY product_id, captured_at DESC, id DESC) - 1 AS position FROM v_snapshot"
)
_analytics = f"""SELECT id AS snapshot_id, product_id, n AS history_points_count, np AS price_points_count,
  nprom AS promo_moments_count, nst AS in_stock_moments_count, captured_at AS selected_captured_at,
  fc AS first_captured_at, lc AS last_captured_at, {two('pc')} AS selected_price, {two('prev')} AS previous_price,
  {two('firstp')} AS first_observed_price, {two('lastp')} AS latest_observed_price, {two('minp')} AS min_price,
  {two('maxp')} AS max_price, avgp AS average_price, {two('maxp - minp')} AS price_spread,
  {two('pc - prev')} AS change_from_previous_amount, dprev AS change_from_previous_percent,
  {two('pc - firstp')} AS change_from_first_amount, dfirst AS change_from_first_percent FROM v_an"""
ORACLE["q7_product_analytics"] = q(_analytics, ANALYTICS)
ORACLE["q7_product_analytics_split"] = ORACLE["q7_product_analytics"]
ORACLE["q8_product_analysis"] = q(
    f"""SELECT a.id AS snapshot_id, a.product_id, (n + 19) // 20 AS history_pages, p.name, p.unit,
  {discount()} AS discount_percent, avgp AS average_price, {two('prev')} AS previous_price,
  dfirst AS change_from_first_percent FROM v_an a JOIN v_card p ON p.id = a.product_id""",
    ANALYTICS,
)
ORACLE["q8_history_pages"] = q(
    f"""SELECT product_id, page_no, count(*) AS points, string_agg(t, ',' ORDER BY rn) AS point_text FROM (
  SELECT product_id, rn, (rn - 1) // 20 AS page_no, id || ':' || coalesce(CAST(pc AS VARCHAR), '-') || ':' ||
   CASE WHEN promo_flag THEN 'p' ELSE 'n' END || ':' || CASE WHEN in_stock THEN 's' ELSE 'o' END || ':' || src AS t
  FROM (SELECT s.*, coalesce(r.source, 'shop') AS src, row_number() OVER (PARTITION BY product_id ORDER BY captured_at, s.id) AS rn
        FROM v_snapshot s LEFT JOIN v_run r ON r.id = s.run_id)) GROUP BY product_id, page_no"""
)

# Expected cards of the rendered product pages.
PAGES = """
v_style AS (
  SELECT p_partkey AS k, p_name AS name, p_size AS size, p_type AS kind, p_size % 4 AS style,
         CAST(round(p_retailprice * 100) AS BIGINT) AS fullc,
         CAST(round(p_retailprice * 100) AS BIGINT) - p_size * 100 AS salec,
         CASE WHEN p_size = 47 THEN 'timeout' WHEN p_size = 50 THEN 'not_found' WHEN p_size = 49 THEN 'http_5xx'
              WHEN p_size = 48 THEN 'too_many_requests' WHEN p_size = 46 THEN 'parse_failed' END AS err,
         CASE WHEN p_size = 50 THEN 404 WHEN p_size = 49 THEN 503 WHEN p_size = 48 THEN 429 ELSE 200 END AS http
  FROM part),
v_page AS (
  SELECT k, http, size = 47 AS timed_out, err, err IS NULL AS has_card,
   CASE WHEN err IS NULL THEN CAST(k AS VARCHAR) END AS external_id,
   CASE WHEN err IS NULL THEN CASE style WHEN 2 THEN 'Товар ' || name || ' <new>' ELSE name END END AS name,
   CASE WHEN err IS NULL THEN CAST(k AS VARCHAR) END AS slug,
   CASE WHEN err IS NULL THEN CASE style WHEN 0 THEN fullc ELSE salec END END AS pc,
   CASE WHEN err IS NULL THEN CASE WHEN style IN (2, 3) THEN fullc END END AS oc,
   CASE WHEN err IS NULL THEN style IN (2, 3) END AS promo_flag,
   CASE WHEN err IS NULL THEN style = 3 END AS in_stock,
   CASE WHEN err IS NULL THEN CASE style WHEN 0 THEN size + 0.5 WHEN 1 THEN size * 10.0 WHEN 2 THEN size * 10.0 + 5 END END AS pack_value,
   CASE WHEN err IS NULL THEN CASE style WHEN 0 THEN 'кг' WHEN 1 THEN kind || '/' || size || '0г' WHEN 2 THEN 'мл' END END AS pack_unit,
   CASE WHEN err IS NULL THEN CASE style
     WHEN 2 THEN CAST((2 * 100 * (fullc - salec) + fullc) // (2 * fullc) AS INT) WHEN 3 THEN 7 END END AS discount_percent
  FROM v_style)
"""
ORACLE["t19_product_cards"] = q(
    f"""SELECT http AS http_status, timed_out, discount_percent, '{ROOT}' || k AS page_url, has_card, external_id, name,
  slug, {two('pc')} AS price, {two('oc')} AS old_price, promo_flag, in_stock, CAST(pack_value AS DOUBLE) AS pack_value, pack_unit, err AS error_code,
  CASE WHEN err IS NULL THEN NULL ELSE err IN ('timeout', 'http_5xx', 'too_many_requests') END AS is_transient FROM v_page""",
    PAGES,
)
_diffs = {
    "name": "lower(trim(d.name)) <> lower(trim(coalesce(l.name, '')))",
    "sku": "lower(d.sku) <> lower(coalesce(l.external_id, ''))",
    "current_price": "d.pc IS DISTINCT FROM l.pc",
    "old_price": "d.oc IS DISTINCT FROM l.oc",
    "promo_flag": "d.promo_flag <> l.promo_flag",
    "in_stock": "d.in_stock <> l.in_stock",
    "unit": "lower(coalesce(d.unit, '')) <> lower(coalesce(l.unit, ''))",
    "slug": "d.slug <> l.slug",
}
_flags = ", ".join(f"CASE WHEN has_card THEN {e} END AS {n}_changed" for n, e in _diffs.items())
_total = " + ".join(f"CAST({n}_changed AS INT)" for n in _diffs)
_compared = f"""SELECT *, {_total} AS changed_fields FROM (
  SELECT d.snapshot_id, d.url, CASE WHEN has_card THEN 'success' ELSE 'error' END AS live_status, err AS issue_code, {_flags}
  FROM (SELECT s.id AS snapshot_id, p.id AS k, p.url, p.name, p.external_id AS sku, s.pc, s.oc, s.promo_flag, s.in_stock, p.unit, p.slug
        FROM FROM_HERE s JOIN v_card p ON p.id = s.product_id) d
  JOIN (SELECT *, CASE WHEN pack_value IS NULL THEN pack_unit
               ELSE CASE WHEN pack_value = 2.5 THEN '2.5' ELSE CAST(CAST(pack_value AS INT) AS VARCHAR) END || ' ' || pack_unit END AS unit
        FROM v_page) l ON l.k = d.k)"""
ORACLE["q9_live_comparison"] = q(_compared.replace("FROM_HERE", "v_new"), _newest + "," + PAGES)
ORACLE["q9_live_comparison_all"] = q(_compared.replace("FROM_HERE", "v_snapshot"), PAGES)


def _tone(v: str) -> str:
    return f"CASE WHEN {v} < 0 THEN 'success' WHEN {v} > 0 THEN 'accent' WHEN {v} = 0 THEN 'neutral' ELSE 'muted' END"


def _signed_price(v: str) -> str:
    return (
        f"coalesce(CASE WHEN {v} > 0 THEN '+' WHEN {v} < 0 THEN '-' ELSE '' END || {grouped(v)} || ' UAH', 'No change')"
    )


def _cover(v: str) -> str:
    return f"CAST((2 * 100 * {v} + n) // (2 * n) AS INT)"


ORACLE["q10_chart_summary"] = q(
    f"""SELECT id AS snapshot_id, np > 0 AS has_visible_prices, {_tone('pc - firstp')} AS trend_tone,
  {_tone('pc - prev')} AS delta_tone, coalesce({grouped('pc')} || ' UAH', 'Not available') AS selected_text,
  {_signed_price('(pc - prev)')} AS previous_amount_text, {signed_pct('dprev')} AS previous_percent_text,
  {_cover('nst')} AS in_stock_coverage, {_cover('nprom')} AS promo_coverage,
  concat_ws(' ',
   'This price is ' || CASE WHEN dfirst IS NOT NULL THEN {signed_pct('dfirst')} END || ' ' ||
     CASE WHEN dfirst < 0 THEN 'below' WHEN dfirst > 0 THEN 'above' WHEN dfirst = 0 THEN 'aligned with' END || ' the first one seen.',
   'Since the price before it went ' || CASE WHEN dprev < 0 THEN 'cheaper' WHEN dprev > 0 THEN 'higher' WHEN dprev = 0 THEN 'flat' END
     || ' by ' || {signed_pct('dprev')} || '.',
   'Promotions cover ' || {_cover('nprom')} || '% and stock covers ' || {_cover('nst')} || '%.') AS trend_text
  FROM v_an""",
    ANALYTICS,
)
ORACLE["q10_chart_series"] = q(
    """SELECT product_id, CASE WHEN n <= 14 THEN 'hours' ELSE 'fit' END AS base_unit,
  CASE WHEN n <= 14 THEN date_trunc('hour', captured_at) ELSE date_trunc('day', captured_at) END AS bucket,
  last(pc ORDER BY captured_at, id) FILTER (pc IS NOT NULL) / 100.0 AS price, count(*) AS points
  FROM v_an0 GROUP BY 1, 2, 3""",
    ANALYTICS,
)
ORACLE["q10_selected_series"] = q(
    f"""SELECT s.product_id, s.id, {two('s.pc')} AS price, CASE WHEN s.id = w.id THEN {two('s.pc')} END AS selected_price
  FROM v_snapshot s JOIN v_new w ON w.product_id = s.product_id""",
    _newest,
)
ORACLE["q11_status_counts"] = q(
    """SELECT status, count(*) AS total, 'run' AS kind FROM v_run GROUP BY status
 UNION ALL SELECT status, count(*), 'queue' FROM v_queue GROUP BY status"""
)
ORACLE["q11_table_counts"] = q(
    """SELECT 'crawler_run' AS metric, count(*) AS total FROM v_run UNION ALL SELECT 'product', count(*) FROM v_product
 UNION ALL SELECT 'price_snapshot', count(*) FROM v_snapshot UNION ALL SELECT 'price_collect_queue', count(*) FROM v_queue
 UNION ALL SELECT 'crawl_error', count(*) FROM v_error"""
)
_days = """v_day AS (SELECT DISTINCT CAST(started_at AS DATE) AS day FROM v_run),
v_seen AS (SELECT DISTINCT s.product_id, CAST(r.started_at AS DATE) AS day FROM v_snapshot s JOIN v_run r ON r.id = s.run_id)"""
ORACLE["q12_coverage_calendar"] = q(
    """SELECT p.id AS product_id, (SELECT count(*) FROM v_day) AS days_with_runs, count(s.day) AS days_captured,
  (SELECT count(*) FROM v_day) - count(s.day) AS days_missing
  FROM v_product p LEFT JOIN v_seen s ON s.product_id = p.id GROUP BY p.id""",
    _days,
)
ORACLE["q12_missing_days"] = q(
    """SELECT p.id AS product_id, CAST(d.day AS VARCHAR) AS day FROM v_product p, v_day d
  WHERE d.day BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'
  AND NOT EXISTS (SELECT 1 FROM v_seen s WHERE s.product_id = p.id AND s.day = d.day)""",
    _days,
)

ORACLE["q12_missing_spans"] = q(
    """SELECT product_id, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS days FROM (
  SELECT p.id AS product_id, d.day, d.no - row_number() OVER (PARTITION BY p.id ORDER BY d.day) AS island
  FROM v_product p, (SELECT day, row_number() OVER (ORDER BY day) AS no FROM v_day) d
  WHERE NOT EXISTS (SELECT 1 FROM v_seen s WHERE s.product_id = p.id AND s.day = d.day)) GROUP BY product_id, island""",
    _days,
)
ORACLE["w1_reference_prices"] = q(
    f"""SELECT id, {two('prev')} AS previous_price, {two('firstp')} AS first_observed_price, {two('lastp')} AS latest_observed_price,
  {two('pc - prev')} AS change_from_previous_amount, dprev AS change_from_previous_percent,
  {two('pc - firstp')} AS change_from_first_amount, dfirst AS change_from_first_percent FROM v_an""",
    ANALYTICS,
)
_valid = "(pc IS NOT NULL OR oc IS NOT NULL OR in_stock)"
ORACLE["w4_change_points"] = q(
    f"""SELECT id, product_id, captured_at, {two('pc')} AS price, {two('oc')} AS old_price, promo_flag, in_stock FROM (
  SELECT *, lag(id) OVER w AS pid, lag(pc) OVER w AS ppc, lag(oc) OVER w AS poc, lag(promo_flag) OVER w AS pp, lag(in_stock) OVER w AS ps
  FROM v_snapshot WHERE {_valid} WINDOW w AS ({W}))
  WHERE pid IS NULL OR pc IS DISTINCT FROM ppc OR oc IS DISTINCT FROM poc OR promo_flag <> pp OR in_stock <> ps"""
)
ORACLE["w4_change_points_split"] = ORACLE["w4_change_points"]
ORACLE["w5_latest_snapshot"] = q(
    f"SELECT product_id, id, captured_at, {two('pc')} AS price, in_stock FROM v_new", _newest
)
_errors = f"""v_err AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 268435456 + (l_partkey * 1000003 + l_suppkey * 10007
              + CAST(round(l_extendedprice * 100) AS BIGINT)) % 268435456 AS id, l_orderkey AS run_id,
   l_suppkey AS queue_id, CASE WHEN l_linenumber <> 6 THEN l_partkey END AS product_id, l_partkey AS pk, l_linenumber AS ln,
   CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS created_at
  FROM lineitem WHERE l_returnflag = 'R')"""
ORACLE["w6_distinct_on"] = q(
    """SELECT DISTINCT ON (run_id) run_id, product_id, created_at, id FROM v_err
  ORDER BY run_id, created_at DESC NULLS LAST, id DESC""",
    _errors,
)
ORACLE["w7_first_wins"] = """SELECT doc_id AS pos, upper(source) AS word, lang FROM documents
 QUALIFY row_number() OVER (PARTITION BY lower(source), lang ORDER BY doc_id) = 1"""
_streak = """v_f AS (SELECT user_id AS host, event_id AS id, ts, event_type IN ('error', 'click') AS transient FROM events),
v_isl AS (SELECT *, sum(CASE WHEN transient THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY ts, id) AS isl FROM v_f),
v_str AS (SELECT *, sum(CASE WHEN transient THEN 1 ELSE 0 END) OVER (PARTITION BY host, isl ORDER BY ts, id) AS streak FROM v_isl)"""
ORACLE["w10_failure_streaks"] = q(
    "SELECT host, id, transient, CAST(streak AS BIGINT) AS streak FROM v_str", _streak
)

_items = f"""v_item AS (
  SELECT user_id AS run_id, event_id AS seq,
   'https://shop.example/q/' || (user_id * 50 + event_id % 50) || CASE WHEN event_type = 'view' THEN '/new' ELSE '' END AS url FROM events)"""
ORACLE["t1_enqueue"] = q(
    f"""SELECT (SELECT max(id) + 1 FROM v_queue) + row_number() OVER (ORDER BY min(seq)) - 1 AS id, run_id, url, 'pending' AS status, 0 AS attempt, 1 AS max_attempts,
  {AS_OF} AS next_attempt_at, sha256(run_id || ':' || url) AS idempotency_key, {AS_OF} AS created_at
  FROM v_item i WHERE NOT EXISTS (SELECT 1 FROM v_queue q WHERE q.run_id = i.run_id AND q.url = i.url) GROUP BY run_id, url""",
    _items,
)
ORACLE["j11_zip_items"] = """SELECT conv_id AS run_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS INT) AS pos,
 role AS url, md5(text) AS idempotency_key FROM conversations"""
_ready = f"""v_ready AS (SELECT *, coalesce(next_attempt_at, created_at) AS due_at,
  row_number() OVER (PARTITION BY run_id ORDER BY coalesce(next_attempt_at, created_at), id) - 1 AS e
  FROM v_queue WHERE status IN ('pending', 'retry') AND coalesce(next_attempt_at, created_at) <= {AS_OF})"""
ORACLE["t2_plan_batches"] = q(
    f"""SELECT id, run_id, url, attempt, max_attempts, idempotency_key, due_at, e // 6 AS batch_no, e % 6 + 1 AS batch_position,
  {AS_OF} AS reserved_at, {AS_OF} + INTERVAL 90 SECOND AS lease_until, 'worker-a' AS reserved_by FROM v_ready""",
    _ready,
)
ORACLE["t2_plan_batches_split"] = ORACLE["t2_plan_batches"]
ORACLE["j13_reserve"] = q(
    f"""SELECT q.id, q.run_id, CASE WHEN r.id IS NULL THEN q.status ELSE 'reserved' END AS status,
  CASE WHEN r.id IS NULL THEN q.reserved_at ELSE {AS_OF} END AS reserved_at,
  CASE WHEN r.id IS NULL THEN q.lease_until ELSE {AS_OF} + INTERVAL 90 SECOND END AS lease_until,
  CASE WHEN r.id IS NULL THEN q.reserved_by ELSE 'w' END AS reserved_by,
  CASE WHEN r.id IS NULL THEN q.updated_at ELSE {AS_OF} END AS updated_at
  FROM v_queue q LEFT JOIN v_ready r ON r.id = q.id AND r.e < 6""",
    _ready,
)
ORACLE["o3_next_batch"] = q("SELECT id, run_id, url, status, attempt FROM v_ready WHERE e < 4", _ready)
ORACLE["sql_reserve_batch"] = q(
    "SELECT id, run_id, url, attempt, max_attempts, coalesce(idempotency_key, '') AS idempotency_key, 'worker-a' AS reserved_by FROM v_ready WHERE e < 6", _ready
)
ORACLE["sql_named_calls"] = """SELECT p_partkey AS id, left(trim(p_name), 5) AS short_name,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE left(CAST(p_partkey AS VARCHAR), 2) END AS short_slug,
  CASE p_partkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'running' ELSE 'error' END AS run_status,
  CASE p_partkey % 2 WHEN 0 THEN 'dead' ELSE 'pending' END AS queue_status,
  (10000 + p_partkey + 10) // (2 * (p_partkey + 10)) * 0 + floor((2 * 10000 + p_partkey + 10) / (2 * (p_partkey + 10))) / 10.0 AS off,
  CAST(CASE WHEN p_partkey > 0 THEN -50 END AS DOUBLE) AS change FROM part"""
ORACLE["t3_5_transitions"] = q(
    """SELECT item AS id, user_id AS run_id,
  coalesce(first(st ORDER BY ts DESC, event_id DESC) FILTER (st IN ('succeeded', 'retry', 'dead')), 'pending') AS status,
  CAST(count(*) FILTER (st IN ('retry', 'dead')) AS INT) AS attempt,
  first(ts + INTERVAL 5 SECOND ORDER BY ts DESC, event_id DESC) FILTER (st = 'retry') AS next_attempt_at,
  first(CASE WHEN st = 'dead' THEN 'Timeout' ELSE '' END ORDER BY ts DESC, event_id DESC) FILTER (st IN ('retry', 'dead')) AS last_error_code,
  nullif(first(CASE WHEN st = 'retry' THEN 429 ELSE -1 END ORDER BY ts DESC, event_id DESC) FILTER (st IN ('retry', 'dead')), -1) AS last_http_status,
  first('event ' || event_id ORDER BY ts DESC, event_id DESC) FILTER (st IN ('retry', 'dead')) AS last_error_message,
  coalesce(max(ts) FILTER (st IN ('succeeded', 'retry', 'dead')), min(ts)) AS updated_at,
  max(ts) FILTER (st IN ('succeeded', 'dead')) AS finished_at
  FROM v_status GROUP BY item, user_id"""
)
_hit = f"(status = 'reserved' AND lease_until < {AS_OF})"
ORACLE["t6_reap_expired"] = q(
    f"""SELECT id, CASE WHEN {_hit} THEN 'retry' ELSE status END AS status, attempt,
  CASE WHEN {_hit} THEN {AS_OF} ELSE next_attempt_at END AS next_attempt_at,
  CASE WHEN {_hit} THEN NULL ELSE reserved_at END AS reserved_at, CASE WHEN {_hit} THEN NULL ELSE lease_until END AS lease_until,
  CASE WHEN {_hit} THEN NULL ELSE reserved_by END AS reserved_by,
  CASE WHEN {_hit} THEN coalesce(last_error_code, 'lease_expired') ELSE last_error_code END AS last_error_code,
  CASE WHEN {_hit} THEN 'The lease ran out' END AS last_error_message,
  CASE WHEN {_hit} THEN {AS_OF} ELSE updated_at END AS updated_at FROM v_queue"""
)
ORACLE["t7_has_outstanding"] = q(
    "SELECT run_id, bool_or(status IN ('pending', 'retry', 'reserved')) AS has_outstanding FROM v_queue GROUP BY run_id"
)
_stat = ", ".join(
    f"CAST(count(*) FILTER (status = '{s}') AS INT) AS {s}_count"
    for s in ("pending", "reserved", "retry", "succeeded", "dead")
)
ORACLE["t8_queue_stats"] = q(f"SELECT run_id, {_stat} FROM v_queue GROUP BY run_id")
ORACLE["t8_latest_states"] = q(
    "SELECT run_id, id AS item_id, status, last_ts AS at FROM v_last"
)

# The batch lies after the history in capture order and every part is one product, so the
# store is a comparison with the row before; new ids follow the place in the batch.
STORE = f"""
v_known AS (SELECT * FROM v_product WHERE pack_unit IS NOT NULL),
v_held AS (SELECT s.* FROM v_snapshot s JOIN v_known k ON k.id = s.product_id WHERE captured_at < {BATCH_START}),
v_obs AS (
  SELECT s.*, CAST(date_diff('day', DATE '1970-01-01', CAST(captured_at AS DATE)) AS BIGINT) * 281474976710656
         + (s.id & 281474976710655) AS seq, l.l_linenumber AS ln,
         '{ROOT}' || product_id || CASE WHEN product_id % 5 = 0 AND l.l_suppkey % 2 = 1 THEN '/alt' ELSE '' END AS url
  FROM v_snapshot s JOIN v_line l ON l.id = s.id WHERE captured_at >= {BATCH_START} OR product_id NOT IN (SELECT id FROM v_known)),
v_pos AS (SELECT seq AS arrival, row_number() OVER (ORDER BY seq) - 1 AS pos FROM v_obs),
v_own AS (
  SELECT product_id AS part, coalesce(max(k.id), (SELECT max(id) + 1 FROM v_known) + min(pos)) AS pid
  FROM v_obs o JOIN v_pos ON arrival = seq LEFT JOIN v_known k ON k.id = o.product_id GROUP BY product_id),
v_seqd AS (
  SELECT o.seq, w.pid, (SELECT max(id) + 1 FROM v_held) + pos AS own, {_valid} AS ok, pc, oc, promo_flag, in_stock,
         run_id, queue_id, captured_at FROM v_obs o JOIN v_pos ON arrival = seq JOIN v_own w ON w.part = o.product_id
  UNION ALL
  SELECT -1, product_id, id, true, pc, oc, promo_flag, in_stock, NULL, NULL, captured_at FROM (
    SELECT * FROM v_held WHERE product_id IN (SELECT product_id FROM v_obs)
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY captured_at DESC, id DESC) = 1)),
v_lag AS (
  SELECT *, CASE WHEN ok THEN {{'p': pc, 'o': oc, 'f': promo_flag, 's': in_stock}} END AS cur,
   last_value(CASE WHEN ok THEN {{'p': pc, 'o': oc, 'f': promo_flag, 's': in_stock}} END IGNORE NULLS)
     OVER (PARTITION BY pid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef FROM v_seqd),
v_dec AS (SELECT *, ok AND (bef IS NULL OR cur IS DISTINCT FROM bef) AS st FROM v_lag),
v_res AS (SELECT *, last_value(CASE WHEN st THEN own END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY seq) AS sid FROM v_dec)
"""
ORACLE["t9_observation_store"] = q(
    "SELECT seq, pid AS product_id, sid AS snapshot_id, st AS snapshot_created FROM v_res WHERE seq >= 0", STORE
)
ORACLE["t9_new_snapshots"] = q(
    f"""SELECT sid AS id, run_id, pid AS product_id, captured_at, {two('pc')} AS price, {two('oc')} AS old_price,
  promo_flag, in_stock, queue_id FROM v_res WHERE seq >= 0 AND st""",
    STORE,
)
ORACLE["t9_products"] = q(
    """SELECT coalesce(k.id, o.pid) AS id, coalesce(o.ext, k.external_id) AS external_id,
  CASE WHEN o.pid IS NULL THEN k.name ELSE o.name END AS name, CASE WHEN o.pid IS NULL THEN k.url ELSE o.url END AS url,
  coalesce(o.slug, k.slug) AS slug, CASE WHEN o.pid IS NULL THEN k.pack_milli / 1000.0 END AS pack_value,
  CASE WHEN o.pid IS NULL THEN k.pack_unit ELSE 'pcs' END AS pack_unit,
  CASE WHEN k.id IS NULL THEN o.f ELSE TIMESTAMP '2020-01-01' END AS created_at, o.l AS updated_at
  FROM v_known k FULL JOIN (
   SELECT w.pid, max(CASE WHEN ln <> 1 OR product_id % 5 = 0 THEN 'SKU-' || product_id END) AS ext,
     'part ' || product_id || ' seen' AS name, last(o.url ORDER BY seq) AS url,
     CAST(product_id AS VARCHAR) AS slug, first(captured_at ORDER BY seq) AS f, last(captured_at ORDER BY seq) AS l
   FROM v_obs o JOIN v_own w ON w.part = o.product_id GROUP BY w.pid, product_id) o ON o.pid = k.id""",
    STORE,
)
_state = "{'p': pc, 'o': oc, 'f': promo_flag, 's': in_stock}"
# Out of order: each product's rows one after another, beside the stored row that is newest by capture time.
LATE = STORE.split("v_pos AS")[0] + f"""
v_turned AS (SELECT *, CASE WHEN queue_id % 3 = 0 THEN seq ELSE -seq END AS arr FROM v_obs),
v_pos AS (SELECT arr, row_number() OVER (ORDER BY arr) - 1 AS pos FROM v_turned),
v_own AS (
  SELECT product_id AS part, coalesce(max(k.id), (SELECT max(id) + 1 FROM v_known) + min(pos)) AS pid
  FROM v_turned o JOIN v_pos USING (arr) LEFT JOIN v_known k ON k.id = o.product_id GROUP BY product_id),
v_all AS (
  SELECT arr, pos, w.pid, (SELECT max(id) + 1 FROM v_held) + pos AS own, {_valid} AS ok, {_state} AS cur, captured_at
  FROM v_turned o JOIN v_pos USING (arr) JOIN v_own w ON w.part = o.product_id
  UNION ALL
  SELECT NULL, -1, product_id, id, true, {_state}, captured_at FROM (
    SELECT * FROM v_held WHERE product_id IN (SELECT product_id FROM v_obs)
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY captured_at DESC, id DESC) = 1)),
v_n AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY pos) AS k FROM v_all),
v_step AS (
  SELECT pid, k, arr, ok AS st, CASE WHEN ok THEN own END AS sid, CASE WHEN ok THEN own END AS bid, CASE WHEN ok THEN captured_at END AS bt, cur AS bs
  FROM v_n WHERE k = 1
  UNION ALL
  SELECT pid, k, arr, st, CASE WHEN st THEN own ELSE bid END, CASE WHEN newer THEN own ELSE bid END, CASE WHEN newer THEN captured_at ELSE bt END,
    CASE WHEN newer THEN cur ELSE bs END FROM (
    SELECT *, st AND (bid IS NULL OR captured_at > bt OR (captured_at = bt AND own > bid)) AS newer FROM (
      SELECT n.pid, n.k, n.arr, n.own, n.cur, n.captured_at, r.bid, r.bt, r.bs, n.ok AND (r.bid IS NULL OR n.cur IS DISTINCT FROM r.bs) AS st
      FROM v_step r JOIN v_n n ON n.pid = r.pid AND n.k = r.k + 1)))
"""
ORACLE["t9_late"] = q(
    "SELECT arr AS seq, pid AS product_id, sid AS snapshot_id, st AS snapshot_created FROM v_step WHERE arr IS NOT NULL", LATE
).replace("WITH", "WITH RECURSIVE", 1)
# The second batch's ids begin after what the first one made.
TWICE = STORE.split("v_pos AS")[0] + f"""
v_two AS (SELECT *, CASE WHEN captured_at >= TIMESTAMP '1997-06-01 00:00:00' THEN 2 ELSE 1 END AS batch FROM v_obs),
v_pos AS (SELECT seq AS arrival, batch, row_number() OVER (PARTITION BY batch ORDER BY seq) - 1 AS pos FROM v_two),
v_first AS (
  SELECT product_id AS part, max(k.id) AS known, min(pos) FILTER (o.batch = 1) AS p1, min(pos) FILTER (o.batch = 2) AS p2
  FROM v_two o JOIN v_pos ON arrival = seq LEFT JOIN v_known k ON k.id = o.product_id GROUP BY product_id),
v_base AS (SELECT (SELECT max(id) + 1 FROM v_known) AS b1, greatest((SELECT max(id) FROM v_known), max((SELECT max(id) + 1 FROM v_known) + p1) FILTER (known IS NULL)) + 1 AS b2 FROM v_first),
v_own AS (SELECT part, coalesce(known, b1 + p1, b2 + p2) AS pid FROM v_first, v_base),
v_lag AS (
  SELECT *, lag(cur IGNORE NULLS) OVER (PARTITION BY pid ORDER BY seq) AS bef FROM (
    SELECT o.seq, o.batch, p.pos, w.pid, CASE WHEN {_valid} THEN {_state} END AS cur FROM v_two o JOIN v_pos p ON p.arrival = o.seq JOIN v_own w ON w.part = o.product_id
    UNION ALL
    SELECT -1, 0, id, product_id, {_state} FROM (
      SELECT * FROM v_held WHERE product_id IN (SELECT product_id FROM v_obs)
      QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY captured_at DESC, id DESC) = 1))),
v_dec AS (SELECT *, batch = 0 OR (cur IS NOT NULL AND (bef IS NULL OR cur IS DISTINCT FROM bef)) AS st FROM v_lag),
v_ids AS (SELECT max(id) + 1 AS s1, greatest(max(id), (SELECT max((SELECT max(id) + 1 FROM v_held) + pos) FROM v_dec WHERE batch = 1 AND st)) + 1 AS s2 FROM v_held),
v_res AS (
  SELECT *, last_value(CASE WHEN st THEN CASE batch WHEN 0 THEN pos WHEN 1 THEN s1 + pos ELSE s2 + pos END END IGNORE NULLS)
    OVER (PARTITION BY pid ORDER BY seq) AS sid FROM v_dec, v_ids)
"""
ORACLE["t9_two_batches"] = q("SELECT seq, pid AS product_id, sid AS snapshot_id, st AS snapshot_created, CAST(batch AS INT) AS batch FROM v_res WHERE batch > 0", TWICE)
# One observation after another: the product with its url, else the smallest with its id, else a new one.
ORACLE["t9_tangled"] = """WITH RECURSIVE c AS (
  SELECT c_custkey AS seq, row_number() OVER (ORDER BY c_custkey) AS n, CASE WHEN c_custkey % 5 <> 0 THEN 'e' || (c_custkey * 7 % 53 + c_nationkey % 2) END AS x,
    CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'n' || c_custkey ELSE 'u' || (c_custkey % 61) END AS u FROM customer),
r AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS p,
    (SELECT list({'id': CAST(s_suppkey AS BIGINT), 'u': 'u' || s_suppkey, 'x': 'e' || (s_suppkey % 53)} ORDER BY s_suppkey) FROM supplier) AS held
  UNION ALL
  SELECT n, seq, p, CASE WHEN met IS NULL THEN list_append(held, {'id': p, 'u': u, 'x': x})
      ELSE [CASE WHEN h.id = p THEN {'id': h.id, 'u': u, 'x': coalesce(x, h.x)} ELSE h END for h in held] END FROM (
    SELECT *, coalesce(met, (SELECT max(s_suppkey) + 1 FROM supplier) + seq) AS p FROM (
      SELECT c.n, c.seq, c.u, c.x, r.held, coalesce(list_min([h.id for h in r.held if h.u = c.u]), list_min([h.id for h in r.held if h.x = c.x])) AS met
      FROM r JOIN c ON c.n = r.n + 1)))
SELECT seq, p AS product_id FROM r WHERE n > 0"""
_keys = "CAST(date_diff('day', DATE '1970-01-01', CAST(captured_at AS DATE)) AS BIGINT) * 281474976710656 + (id & 281474976710655)"
ORACLE["st1_changes"] = q(
    f"""SELECT product_id, seq, captured_at AS observed_at, {two('pc')} AS price, {two('oc')} AS old_price, promo_flag, in_stock FROM (
  SELECT *, lag({_state}) OVER (PARTITION BY product_id ORDER BY seq) AS bef FROM (SELECT *, {_keys} AS seq FROM v_snapshot) WHERE {_valid})
  WHERE bef IS NULL OR bef IS DISTINCT FROM {_state}"""
)
ORACLE["s12_stream_products"] = f"SELECT slug, external_id, name, url, pack_unit, created_at, updated_at FROM ({ORACLE['t9_products']})"
ORACLE["st2_live_counts"] = ORACLE["t8_queue_stats"]
ORACLE["st2_lease_timeouts"] = q(
    """SELECT run_id, id AS item_id, lease_until FROM v_queue WHERE status = 'reserved'
  AND lease_until < (SELECT date_trunc('millisecond', max(ts)) FROM events)"""
)
ORACLE["j7_match_existing"] = q(
    f"""SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(captured_at AS DATE)) AS BIGINT) * 281474976710656
  + (s.id & 281474976710655) AS seq,
  CASE WHEN l.l_linenumber <> 1 OR s.product_id % 5 = 0 OR NOT (s.product_id % 5 = 0 AND l.l_suppkey % 2 = 1) THEN k.id END AS product_id
  FROM v_snapshot s JOIN v_line l ON l.id = s.id LEFT JOIN v_product k ON k.id = s.product_id AND k.pack_unit IS NOT NULL"""
)
ORACLE["s8_normalize_errors"] = q(
    f"""SELECT run_id, queue_id, product_id, '{ROOT}' || pk AS url,
  CASE ln WHEN 1 THEN 'not_found' WHEN 2 THEN 'timeout' WHEN 3 THEN 'http_5xx' WHEN 4 THEN 'too_many_requests'
   WHEN 6 THEN 'odd_code' ELSE 'unknown' END AS error_code,
  CASE ln WHEN 1 THEN 404 WHEN 3 THEN 503 WHEN 4 THEN 429 END AS http_status,
  CASE WHEN ln % 2 = 0 THEN 'line ' || ln END AS error_message, coalesce(created_at, {AS_OF}) AS created_at FROM v_err""",
    _errors,
)

_fail = f"""v_fail AS (
  SELECT event_id, user_id, event_type, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'too_many_requests' ELSE 'unknown' END AS code,
   CASE WHEN event_type = 'click' THEN 429 END AS http, CASE WHEN event_type = 'signup' THEN '' ELSE 'm' || event_id END AS message,
   event_id % 4 + 1 AS a, event_type <> 'signup' AND event_id % 4 + 1 < 3 AS again,
   least(500 * (1 << (event_id % 4)) + event_id % 700, 5000) AS back
  FROM events WHERE event_type IN ('error', 'click', 'signup')),
v_route AS (SELECT *, CASE WHEN code = 'too_many_requests' THEN least(2 * back, 5000) ELSE back END AS delay FROM v_fail)"""
ORACLE["t11_failure_routing"] = q(
    f"""SELECT event_id AS queue_id, CASE WHEN again THEN 'retry' ELSE 'dead' END AS kind, code AS error_code, http AS http_status, message,
  CASE WHEN again THEN {AS_OF} + to_milliseconds(delay) END AS next_attempt_at, CASE WHEN again THEN delay END AS delay_ms FROM v_route""",
    _fail,
)
ORACLE["t11_dead_errors"] = q(
    f"""SELECT user_id AS run_id, event_id AS queue_id, NULL::BIGINT AS product_id, 'https://shop.example/q/' || event_id AS url,
  code AS error_code, http AS http_status, message AS error_message, {AS_OF} AS created_at FROM v_route WHERE NOT again""",
    _fail,
)
ORACLE["t12_item_routing"] = q(
    """SELECT 'observation' AS kind, event_id AS queue_id, 'n' || event_id AS info FROM events WHERE event_type IN ('purchase', 'view')
 UNION ALL SELECT 'partial', event_id, 'https://shop.example/e/' || (event_id % 97) || '/unknown/m' || event_id FROM events WHERE event_type = 'view'
 UNION ALL SELECT 'succeeded', event_id, '' FROM events WHERE event_type IN ('purchase', 'view')
 UNION ALL SELECT 'failed', event_id, CASE WHEN event_type = 'signup' THEN 'extract/unknown/' ELSE 'fetch/' || code || '/' || message END FROM v_fail""",
    _fail,
)
# Even items first, then odd ones; a product is new with its first card in a batch.
_crawl = _fail + """,
v_seen AS (SELECT event_id, event_id % 97 AS g, event_id % 2 AS part, row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id) - 1 AS pos
  FROM events WHERE event_type IN ('purchase', 'view')),
v_even AS (SELECT g, 1 + min(pos) AS pid FROM v_seen WHERE part = 0 GROUP BY g),
v_gone AS (SELECT g, coalesce((SELECT max(pid) FROM v_even), 0) + 1 + min(pos) AS pid FROM v_seen WHERE part = 1 AND g NOT IN (SELECT g FROM v_even) GROUP BY g),
v_prod AS (SELECT * FROM v_even UNION ALL SELECT * FROM v_gone)"""
ORACLE["run_crawl_errors"] = q(
    """SELECT user_id AS run_id, event_id AS queue_id, pid AS product_id, 'https://shop.example/e/' || g AS url, 'unknown' AS error_code, NULL::INT AS http_status, 'm' || event_id AS error_message
  FROM events JOIN v_seen USING (event_id) JOIN v_prod USING (g) WHERE event_type = 'view'
 UNION ALL SELECT user_id, event_id, NULL, 'https://shop.example/q/' || event_id, code, http, nullif(message, '') FROM v_route WHERE NOT again""",
    _crawl,
)
ORACLE["run_crawl"] = q(
    f"""SELECT run_id, 'sitemap' AS source, ok AS products_processed, dead AS errors,
  'queued=' || n || ', enqueued=' || n || ', succeeded=' || ok || ', dead=' || dead || ', pending=0, retry=' || again AS note,
  CASE WHEN again > 0 THEN 'running' WHEN dead > 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN again = 0 THEN {AS_OF} END AS finished_at
  FROM (SELECT e.user_id AS run_id, count(*) AS n, count(*) FILTER (e.event_type IN ('purchase', 'view')) AS ok,
    count(*) FILTER (NOT r.again) AS dead, count(*) FILTER (r.again) AS again FROM events e LEFT JOIN v_route r USING (event_id) GROUP BY e.user_id)""",
    _fail,
)
ORACLE["t10_finish_runs"] = """SELECT o_orderkey AS id, o_orderdate AS started_at,
 CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 7 MINUTE END AS finished_at,
 CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'ok' ELSE 'error' END AS status, o_orderpriority AS source,
 CASE WHEN o_orderstatus = 'F' THEN 'cust ' || o_custkey END AS note FROM orders"""
ORACLE["t10_finish_ingestion_runs"] = """SELECT o_orderkey * 10 AS ingestion_run_id, o_orderkey AS crawler_run_id, o_orderdate AS started_at,
 CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS finished_at,
 CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'ok' ELSE 'error' END AS status,
 CASE WHEN o_orderstatus = 'O' THEN 'crawler_failed' END AS error_code,
 CASE WHEN o_orderstatus = 'O' THEN 'x' || o_custkey END AS error_message FROM orders"""
ORACLE["t13_run_outcome"] = q(
    f"""SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'sitemap' ELSE 'category-seed' END AS source,
  CASE WHEN dead_count > 0 THEN 'error' ELSE 'ok' END AS status, succeeded_count AS products_processed, dead_count AS errors,
  'queued=' || queued || ', enqueued=' || enqueued || ', succeeded=' || succeeded_count || ', dead=' || dead_count ||
  ', pending=' || pending_count || ', retry=' || retry_count AS note
  FROM (SELECT run_id, {_stat} FROM v_queue GROUP BY run_id)
  JOIN (SELECT user_id AS run_id, count(*) AS queued, count(DISTINCT item) AS enqueued FROM v_status GROUP BY user_id) USING (run_id)"""
)

# Candidate sitemaps per host, by the smallest page id of the host.
SITES = """
v_site AS (SELECT site, min(page_id) AS m, 'https://' || site AS h FROM v_host GROUP BY site),
v_answer AS (
  SELECT site, m, h || name AS url, status, kind_of, body FROM v_site, (VALUES
    ('/sitemap-index.xml', 'text/xml'), ('/a.xml', 'text/plain'), ('/b.xml', 'text/xml'), ('/sitemap.xml', 'text/xml')) AS n(name, kind_of),
    LATERAL (SELECT CASE name WHEN '/sitemap-index.xml' THEN CASE WHEN m % 3 = 0 THEN 404 ELSE 200 END WHEN '/a.xml' THEN CASE WHEN m % 2 = 0 THEN 429 ELSE 200 END
        WHEN '/sitemap.xml' THEN CASE WHEN m % 7 = 0 THEN 200 ELSE 500 END ELSE 200 END AS status,
      CASE WHEN name = '/sitemap-index.xml' AND m % 3 = 1 THEN '<!DOCTYPE html><title>404 Not Found</title>' WHEN name = '/b.xml' AND m % 5 <> 0 THEN '<urlset><url>'
        ELSE '<urlset><url><loc>https://x.example/1</loc></url></urlset>' END AS body)),
v_resp AS (
  SELECT site, m, url, CASE WHEN status = 404 THEN 'NotFound' WHEN status = 429 THEN 'RateLimited' WHEN status >= 500 THEN 'ServerError'
    WHEN regexp_matches(body, '(?i)^\\s*<(!doctype\\s+)?html') THEN 'HtmlInsteadOfXml' WHEN NOT contains(kind_of, 'xml') THEN 'InvalidContentType'
    WHEN NOT regexp_matches(body, '^\\s*<(urlset|sitemapindex)\\b.*</(urlset|sitemapindex)>\\s*$') THEN 'InvalidXml' END AS kind,
    regexp_extract(body, '<(urlset|sitemapindex)', 1) AS root, len(regexp_extract_all(body, '<loc>')) AS n FROM v_answer),
v_cand AS (
  SELECT site, m, 0 AS pos, h || '/sitemap-index.xml' AS url FROM v_site
  UNION ALL SELECT site, m, 1, h || '/a.xml' FROM v_site WHERE m % 11 <> 0
  UNION ALL SELECT site, m, 2, h || '/b.xml' FROM v_site WHERE m % 11 <> 0
  UNION ALL SELECT site, m, 3, h || '/sitemap.xml' FROM v_site
  UNION ALL SELECT site, m, 4, h || '/sitemap_index.xml' FROM v_site),
v_judged AS (
  SELECT c.site, c.pos, c.url, CASE WHEN r.url IS NULL THEN 'NotFound' ELSE r.kind END AS kind
  FROM v_cand c LEFT JOIN v_resp r ON r.url = c.url),
v_kinds AS (SELECT site, kind, min(pos) AS p FROM v_judged WHERE kind IS NOT NULL GROUP BY site, kind),
v_chosen AS (
  SELECT site, first(url ORDER BY pos) FILTER (kind IS NULL) AS sitemap_url, string_agg(url, ', ' ORDER BY pos) AS tried,
   (SELECT string_agg(kind, ', ' ORDER BY p) FROM v_kinds k WHERE k.site = j.site) AS kinds
  FROM v_judged j GROUP BY site)
"""
ORACLE["t15_sitemap_candidates"] = q(
    """SELECT site, sitemap_url, CASE WHEN sitemap_url IS NULL THEN tried END AS tried_urls,
  CASE WHEN sitemap_url IS NULL THEN kinds END AS failure_kinds FROM v_chosen""",
    SITES,
)
ORACLE["t14_discovery_failures"] = q(
    f"""SELECT length(site) AS run_id, 'discovery' AS source, 'error' AS status, 0 AS products_processed, 1 AS errors,
  'none: ' || kinds AS note, 'ProductUrlDiscoveryUnavailable' AS error_code, {AS_OF} AS finished_at
  FROM v_chosen WHERE sitemap_url IS NULL""",
    SITES,
)
ORACLE["s4_sitemap_kinds"] = q(
    """SELECT url, kind AS failure_kind, CASE WHEN kind IS NULL THEN root END AS root, CAST(CASE WHEN kind IS NULL THEN n END AS INT) AS locs FROM v_resp""",
    SITES,
)
ORACLE["s5_sitemap_locs"] = "SELECT url AS loc FROM pages WHERE NOT contains(lower(url), '/fr/') AND NOT contains(lower(url), '#top')"
ORACLE["s6_robots"] = q(
    """SELECT url, CAST(row_number() OVER (PARTITION BY url ORDER BY k) - 1 AS INT) AS pos, sitemap FROM (
  SELECT url, k, trim(substr(line, strpos(line, ':') + 1)) AS sitemap FROM (
    SELECT url, k, trim(regexp_replace(line, '#.*$', '')) AS line FROM (
      SELECT url, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM (
        SELECT h || '/robots.txt' AS url, string_split_regex('User-agent: *' || chr(13) || chr(10) || 'Disallow: /x # Sitemap: no' || chr(13) || chr(10) || 'Sitemap: ' || h ||
          '/a.xml # main' || chr(10) || '  sitemap:' || h || '/b.xml' || chr(10) || 'SITEMAP: ' || h || '/SITEMAP-index.xml' || chr(10) || 'Sitemap:' || chr(10), '\\r?\\n') AS lines FROM v_site)))
  WHERE starts_with(lower(line), 'sitemap:')) WHERE sitemap <> ''""",
    SITES,
)
ORACLE["t16_sitemap_walk"] = q(
    """SELECT site, row_number() OVER (PARTITION BY site ORDER BY p) - 1 AS pos, url FROM (
  SELECT site, url, min(page_id) AS p FROM v_host GROUP BY site, url)"""
)
# The capped walk reads the bodies: files by their place, no file twice on a way, then the caps.
CAPPED = """WITH RECURSIVE v_file AS (
  SELECT host AS site, page_id // 7 AS n, list(url ORDER BY page_id) AS locs FROM (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host, page_id, url FROM pages) GROUP BY ALL
), v_doc AS (
  SELECT site, 'https://' || site || '/part-' || n || '.xml' AS url, n % 7 = 6 AS broken, CASE WHEN n % 5 = 4
    THEN '<sitemapindex><sitemap><loc> https://' || site || '/parts.xml </loc></sitemap><sitemap><loc> https://' || site || '/leaf-' || n || '.xml </loc></sitemap></sitemapindex>'
    ELSE '<urlset>' || array_to_string(['<url><loc> ' || replace(replace(u, '&', '&amp;'), '<', '&lt;') || ' </loc></url>' for u in locs], '') || '</urlset>' END AS body FROM v_file
  UNION ALL
  SELECT site, 'https://' || site || '/leaf-' || n || '.xml', false, '<urlset>' || array_to_string(['<url><loc> ' || replace(replace(u, '&', '&amp;'), '<', '&lt;') || ' </loc></url>' for u in locs], '') || '</urlset>' FROM v_file WHERE n % 5 = 4
  UNION ALL
  SELECT site, 'https://' || site || '/parts.xml', false, '<sitemapindex>' || string_agg('<sitemap><loc> https://' || site || '/part-' || n || '.xml </loc></sitemap>', '' ORDER BY n) || '</sitemapindex>' FROM v_file GROUP BY site
), v_read AS (
  SELECT url, CASE WHEN broken THEN NULL WHEN contains(body, '<sitemapindex>') THEN 'sitemapindex' ELSE 'urlset' END AS root,
    [replace(replace(x, '&lt;', '<'), '&amp;', '&') for x in regexp_extract_all(body, '<loc>\\s*(.*?)\\s*</loc>', 1)] AS locs FROM v_doc
), v_way AS (
  SELECT DISTINCT site, 'https://' || site || '/parts.xml' AS url, CAST([] AS INT[]) AS place, CAST([] AS VARCHAR[]) AS way FROM v_file
  UNION ALL
  SELECT site, loc, place, way FROM (
    SELECT w.site, unnest(r.locs) AS loc, list_append(w.place, unnest(range(len(r.locs)))::INT) AS place, list_append(w.way, w.url) AS way
    FROM v_way w JOIN v_read r ON r.url = w.url AND r.root = 'sitemapindex')
  WHERE NOT list_contains(way, loc) AND (len(place) > 1 OR place[1] < 10)
), v_first AS (SELECT site, url, place FROM v_way QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY place) = 1),
v_bad AS (
  SELECT f.site, f.url, f.place FROM v_first f LEFT JOIN v_read r ON r.url = f.url WHERE r.root IS NULL
  QUALIFY row_number() OVER (PARTITION BY f.site ORDER BY f.place) = 1
), v_at AS (
  SELECT f.site, unnest(r.locs) AS url, list_append(f.place, unnest(range(len(r.locs)))::INT) AS place FROM v_first f JOIN v_read r ON r.url = f.url AND r.root = 'urlset'
), v_url AS (SELECT site, url, place FROM v_at QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY place) = 1),
v_fail AS (
  SELECT b.site, b.url FROM v_bad b WHERE (SELECT count(*) FROM v_url u WHERE u.site = b.site AND u.place < b.place) < 40
)"""
ORACLE["t16_sitemap_walk_capped"] = CAPPED + """
SELECT site, row_number() OVER (PARTITION BY site ORDER BY place) - 1 AS pos, url FROM v_url WHERE site NOT IN (SELECT site FROM v_fail)
QUALIFY row_number() OVER (PARTITION BY site ORDER BY place) <= 40"""
ORACLE["t16_sitemap_walk_failures"] = CAPPED + " SELECT site, url AS failed_url, 'ServerError' AS failure_kind FROM v_fail"
# Brand pages follow the key order, type pages the reverse; five pages are read at most and
# page 2 of brand 7 is broken.
CATEGORY = """
v_part AS (SELECT *, p_partkey // 300 AS c, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS bno,
  1000 + ascii(substr(p_type, 1, 1)) * 200 + ascii(substr(p_type, 2, 1)) AS tno,
  (SELECT max(p_partkey) // 300 FROM part) AS lastc FROM part),
v_brand AS (SELECT bno AS seed_no, c AS page, p_partkey FROM v_part),
v_bpage AS (SELECT seed_no, page, count(*) AS n, (SELECT max(lastc) FROM v_part) AS lastc FROM v_brand GROUP BY seed_no, page),
v_bread AS (SELECT *, seed_no = 7 AND page = 2 AS gone FROM v_bpage WHERE page < 5 AND NOT (seed_no = 7 AND page > 2)),
v_found AS (SELECT b.p_partkey FROM v_brand b JOIN v_bread r ON r.seed_no = b.seed_no AND r.page = b.page AND NOT r.gone),
v_tpage AS (
  SELECT tno AS seed_no, p_type, lastc - c AS page, count(*) AS n, count(*) FILTER (p_partkey NOT IN (SELECT p_partkey FROM v_found)) AS fresh, max(lastc) AS lastc
  FROM v_part GROUP BY tno, p_type, lastc - c),
v_tread AS (SELECT * FROM v_tpage t WHERE page < 5
  AND NOT EXISTS (SELECT 1 FROM v_tpage e WHERE e.seed_no = t.seed_no AND e.page < t.page AND e.fresh = 0))
"""
ORACLE["t17_category_walk"] = q(
    """SELECT 1 AS crawl, seed_no, page + 1 AS page_no, 'https://shop.example/brand-' || seed_no || CASE WHEN page > 0 THEN '?page=' || page ELSE '' END AS page_url,
  CASE WHEN gone THEN 0 ELSE n END AS urls_found, CASE WHEN gone THEN 0 ELSE n END AS new_urls,
  CASE WHEN gone THEN 'CategoryPageServerError' WHEN page = lastc THEN 'NoNextPage' WHEN page = 4 THEN 'MaxCategoryPagesPerSeed' END AS stop_reason FROM v_bread
 UNION ALL SELECT 1, seed_no, page + 1, 'https://shop.example/type-' || lower(p_type) || CASE WHEN page > 0 THEN '?page=' || page ELSE '' END, n, fresh,
  CASE WHEN fresh = 0 THEN 'NoNewProductUrls' WHEN page = lastc THEN 'NoNextPage' WHEN page = 4 THEN 'MaxCategoryPagesPerSeed' END FROM v_tread""",
    CATEGORY,
)
ORACLE["t17_category_urls"] = q(
    """SELECT 1 AS crawl, first(seed_no ORDER BY seed_no) AS seed_no, first(page + 1 ORDER BY seed_no) AS page_no,
  first(spot ORDER BY seed_no) AS "at", 'https://shop.example/item-' || p_partkey AS url FROM (
  SELECT b.seed_no, b.page, b.p_partkey, row_number() OVER (PARTITION BY b.seed_no, b.page ORDER BY b.p_partkey) - 1 AS spot
   FROM v_brand b JOIN v_bread r ON r.seed_no = b.seed_no AND r.page = b.page AND NOT r.gone
  UNION ALL SELECT t.seed_no, t.page, p.p_partkey, row_number() OVER (PARTITION BY t.seed_no, t.page ORDER BY p.p_partkey) - 1
   FROM v_part p JOIN v_tread t ON t.seed_no = p.tno AND t.page = p.lastc - p.c) GROUP BY p_partkey""",
    CATEGORY,
)
ORACLE["s3_category_seeds"] = """WITH e AS (
 SELECT page_id AS pos, CASE WHEN page_id % 13 = 0 THEN '' ELSE 'page ' || page_id END AS name, url,
  CASE WHEN page_id % 13 = 0 THEN 'EmptyName' WHEN page_id % 17 = 0 THEN 'EmptyUrl' WHEN page_id % 19 = 0 THEN 'MalformedUrl'
   WHEN page_id % 3 = 0 THEN 'NotSiteHttpsUrl' END AS reject_reason,
  'https://shop.example/' || regexp_extract(substr(url, length(url) - 2, 2), '^([^?#]*)', 1) AS seed_url FROM pages)
 SELECT min(pos) AS pos, first(name ORDER BY pos) AS name, first(seed_url ORDER BY pos) AS seed_url, NULL AS reject_reason
 FROM e WHERE reject_reason IS NULL GROUP BY lower(seed_url)
 UNION ALL SELECT pos, name, NULL, reject_reason FROM e WHERE reject_reason IS NOT NULL"""
ORACLE["s2_url_exclusions"] = """SELECT min(doc_id) AS pos, first(CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END ORDER BY doc_id) AS word
 FROM documents WHERE doc_id % 5 <> 0 GROUP BY lower(lang)"""
ORACLE["t18_url_filter"] = """WITH u AS (
 SELECT CASE WHEN url LIKE 'https%' THEN 'sitemap' ELSE 'category-seed' END AS source, page_id AS pos,
  regexp_extract(regexp_replace(url, '/[a-z][a-z]/', '/EN/'), '^([^?#]*)', 1) AS url FROM pages),
d AS (SELECT source, min(pos) AS pos, first(url ORDER BY pos) AS url FROM u
 WHERE contains(lower(url), '/en/') AND NOT contains(lower(url), 'blog') AND NOT contains(lower(url), 'm.') GROUP BY source, lower(url))
SELECT source, pos, url FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos) <= 200"""
ORACLE["u9_choose_source"] = q(
    """SELECT site AS crawl, CASE WHEN contains(url, '#') THEN 'sitemap' ELSE 'category-seed' END AS kind, page_id AS pos, url FROM v_host h
  WHERE contains(url, '#') OR NOT EXISTS (SELECT 1 FROM v_host o WHERE o.site = h.site AND contains(o.url, '#'))"""
)
_strip = r"'(?is)<!--.*?-->|<(?:script|style)\b[^>]*>(.*?)</(?:script|style)\s*>|<[a-z/!?][^>]*>'"
def _plain_text(value: str) -> str:
    """The entities these pages use, the ampersand last."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        value = f"replace({value}, '{name}', '{char}')"
    return f"regexp_replace({value}, '&amp;?', '&', 'g')"


_body = rf"regexp_replace(regexp_replace(html, '(?is)^.*?<body\b[^>]*>', ''), {_strip}, '\1', 'g')"
_head = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1)"
_h1 = rf"regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), {_strip}, '\1', 'g')"
ORACLE["t19_page_text"] = rf"""WITH b AS (SELECT page_id, html, {_plain_text(_body)} AS txt FROM pages)
SELECT page_id, trim(regexp_replace({_plain_text(_head)}, '\s+', ' ', 'g')) AS title,
 trim({_plain_text(_h1)}) AS heading, length(txt) AS text_length, md5(txt) AS text_digest FROM b"""
ORACLE["t19_page_cards"] = rf"""WITH b AS (SELECT page_id, url, {_plain_text(_body)} AS txt FROM pages),
f AS (SELECT *, regexp_matches(txt, '[0-9][0-9,. ]*(₴|грн)') OR contains(txt, 'sqpp') AS priced FROM b)
SELECT page_id, url AS page_url, priced AS has_card, CASE WHEN NOT priced THEN 'parse_failed' END AS error_code,
 CASE WHEN NOT priced THEN false END AS is_transient FROM f"""

ORACLE["f12_page_anchors"] = r"""WITH a AS (
 SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g'), '(?is)<a\b[^>]*?\bhref="([^"]*)"', 1) AS hrefs FROM pages),
h AS (SELECT page_id, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS raw FROM a)
SELECT page_id, CAST(pos AS INT) AS pos, replace(raw, '&amp;', '&') AS href, 'https://shop.example/' || replace(url_encode(substr(replace(raw, '&amp;', '&'), 2)), '%2C', ',') AS resolved FROM h"""
# The marked link is the only one of a page; a page without a mark has none.
ORACLE["f13_next_links"] = """SELECT page_id, 0 AS pos, '?after=' || page_id || '&way=' || (page_id % 11) AS href FROM pages WHERE page_id % 11 < 10"""
ORACLE["t21_breaker_report"] = q(
    """SELECT host, count(*) AS requests,
  CASE WHEN max(ts) > min(ts) THEN round(CAST(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0) AS DECIMAL(28, 10)), 2)::DOUBLE ELSE 0.0 END AS approximate_rps,
  CAST(max(streak) AS BIGINT) AS longest_streak, count(*) FILTER (transient AND streak % 3 = 0) AS trips FROM v_str GROUP BY host""",
    _streak,
)
ORACLE["t21_breaker_trips"] = q(
    """SELECT host, id, ts, CAST(streak AS BIGINT) AS streak, ts + INTERVAL 60 SECOND AS open_until
  FROM v_str WHERE transient AND streak % 3 = 0""",
    _streak,
)
ORACLE["t21_breaker_trips_split"] = ORACLE["t21_breaker_trips"]

LEGACY = f"""
v_old AS (
  SELECT p_partkey AS k, CASE WHEN p_size % 3 <> 0 THEN 'SKU-' || p_partkey END AS ext,
   CASE WHEN p_size % 4 <> 0 THEN p_name END AS nm,
   CASE WHEN p_size % 5 <> 0 THEN 'https://shop.example/c/' || p_brand || '/' || p_size || CASE WHEN p_type = 'PROMO' THEN '/?x=1/y' ELSE '/' END END AS u,
   p_size / 4.0 AS pv, lower(p_type) AS pu, CASE WHEN p_size % 2 = 0 THEN TIMESTAMP '2023-05-05' END AS cr,
   CASE WHEN p_size % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(p_partkey % 50) END AS seen, p_size FROM part),
v_oldu AS (SELECT *, coalesce(u, 'legacy://product/' || k) AS url FROM v_old),
v_in AS (
  SELECT k, ext, coalesce(nm, ext, 'product-' || k) AS name, url, CASE WHEN u IS NOT NULL THEN CAST(p_size AS VARCHAR) END AS slug,
   pv, pu, coalesce(cr, {AS_OF}) AS cr, coalesce(seen, cr) AS up
  FROM v_oldu QUALIFY row_number() OVER (PARTITION BY url ORDER BY seen DESC NULLS LAST, k DESC) = 1),
v_cur AS (
  SELECT min(p_partkey) + 1000000 AS id, 'https://shop.example/c/' || p_brand || '/' || p_size || '/' AS url
  FROM part WHERE p_size % 5 <> 0 AND p_type = 'SMALL' GROUP BY 2),
v_now AS (
  SELECT coalesce(c.id, (SELECT max(id) + 1 FROM v_cur) + row_number() OVER (PARTITION BY c.id IS NULL ORDER BY i.k) - 1) AS id, coalesce(i.ext, CASE WHEN c.id IS NOT NULL THEN 'OLD' END) AS external_id,
   CASE WHEN i.k IS NULL THEN 'old name' ELSE i.name END AS name, coalesce(c.url, i.url) AS url,
   coalesce(i.slug, CASE WHEN c.id IS NOT NULL THEN 'kept' END) AS slug, CASE WHEN i.k IS NULL THEN 1.0 ELSE i.pv END AS pack_value,
   CASE WHEN i.k IS NULL THEN 'kg' ELSE i.pu END AS pack_unit,
   CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '2020-01-01' ELSE i.cr END AS created_at, i.up AS updated_at
  FROM v_cur c FULL JOIN v_in i ON i.url = c.url),
v_map AS (SELECT o.k, n.id AS nid, n.url FROM v_oldu o JOIN v_now n ON n.url = o.url),
v_oline AS (SELECT l.*, CAST(round(l_extendedprice * 100) AS BIGINT) AS xc FROM v_line l)
"""
ORACLE["t20_legacy_products"] = q(
    "SELECT id, external_id, name, url, slug, CAST(pack_value AS DOUBLE) AS pack_value, pack_unit, created_at, updated_at FROM v_now", LEGACY
)
ORACLE["t20_legacy_snapshots"] = q(
    f"""SELECT l.id, l_orderkey AS run_id, m.nid AS product_id, CASE WHEN l_linenumber <> 2 THEN l_shipdate ELSE {AS_OF} END AS captured_at,
  {two('CASE WHEN l_linenumber <> 3 THEN xc ELSE xc + 100 END')} AS price, CASE WHEN l_linenumber <> 4 THEN {two('xc + 100')} END AS old_price,
  CASE WHEN l_linenumber = 5 THEN false ELSE off > 0 END AS promo_flag, CASE WHEN l_linenumber = 6 THEN false ELSE l_linestatus = 'O' END AS in_stock,
  l_suppkey AS queue_id FROM v_oline l JOIN v_map m ON m.k = l.l_partkey WHERE off > 0""",
    LEGACY,
)
ORACLE["t20_legacy_errors"] = q(
    f"""SELECT DISTINCT l_orderkey AS run_id, l_suppkey AS queue_id, CASE WHEN l_linenumber % 2 = 0 THEN m.nid END AS product_id, m.url,
  CASE WHEN l_linenumber < 4 THEN 'timeout' END AS error_code, NULL::INT AS http_status, 'late' AS error_message,
  CASE WHEN l_linenumber <> 5 THEN l_shipdate ELSE {AS_OF} END AS created_at
  FROM v_oline l JOIN v_map m ON m.k = l.l_partkey WHERE l_returnflag = 'R'""",
    LEGACY,
)
ORACLE["t20_legacy_runs"] = """SELECT o_orderkey AS id, o_orderdate AS started_at, NULL::TIMESTAMP AS finished_at,
 CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'error' END AS status, o_orderpriority AS source, NULL::VARCHAR AS note
 FROM orders WHERE o_orderstatus <> 'P'"""
ORACLE["t20_legacy_queue"] = q(
    "SELECT id, run_id, status, CAST(attempt AS INT) AS attempt, 0 AS max_attempts, created_at FROM v_queue WHERE status <> 'dead'"
)

_t = r"regexp_replace(x, '^[\s\p{Z}\x{0085}]+|[\s\p{Z}\x{0085}]+$', '', 'g')"
ORACLE["p_text"] = rf"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '   ' ELSE '  ' || text || ' ' || chr(9) END AS v FROM documents),
s AS (SELECT doc_id, v, trim(v, ' ') AS t, v AS x FROM r), w AS (SELECT *, {_t} AS y FROM s)
SELECT doc_id, md5(CASE WHEN t = '' THEN NULL ELSE substr(t, 1, 40) END) AS trim_nullable, md5(substr(t, 1, 40)) AS trim_required,
 md5(substr(y, 1, 1024)) AS strip_and_cut, md5(substr(y, 1, 400)) AS trim_message, y = '' AS is_blank,
 CASE WHEN t = '' THEN NULL ELSE '' END AS nothing FROM w"""
ORACLE["p_status"] = """SELECT event_id, CASE event_type WHEN 'signup' THEN 'ok' WHEN 'error' THEN 'running' ELSE 'error' END AS run_status,
 CASE event_type WHEN 'view' THEN 'reserved' WHEN 'click' THEN 'retry' ELSE 'pending' END AS queue_status,
 CASE event_type WHEN 'error' THEN 'running' WHEN 'purchase' THEN 'ok' ELSE 'error' END AS stored_status,
 CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'ok' ELSE 'error' END AS legacy_status,
 CASE WHEN event_type <> 'error' THEN 'OK' ELSE 'Failed' END AS label, CASE WHEN event_type <> 'error' THEN 'failed' ELSE 'all' END AS scope,
 CASE WHEN event_type <> 'error' THEN 'timeout' ELSE 'unknown' END AS code,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'partial' ELSE 'success' END AS live_status,
 CASE WHEN event_type <> 'error' THEN 'category-seed' ELSE 'sitemap' END AS source FROM events"""
_d = "(pc - oc)"
ORACLE["p_pricing"] = q(
    f"""SELECT id, {discount()} AS d1, {discount(scale=1)} AS d0, CAST({discount(scale=1)} AS INT) AS di, {change('oc', 'pc')} AS change,
  {two('pc - oc')} AS delta, {two('coalesce(pc, oc)')} AS shown, coalesce(oc > pc, false) AS promo, {_valid} AS valid,
  {_tone(_d)} AS tone, CASE WHEN {_d} < 0 THEN 'below' WHEN {_d} > 0 THEN 'above' WHEN {_d} = 0 THEN 'aligned with' END AS level,
  CASE WHEN {_d} < 0 THEN 'cheaper' WHEN {_d} > 0 THEN 'higher' WHEN {_d} = 0 THEN 'flat' END AS move,
  {_signed_price(_d)} AS amount_text, {signed_pct('(' + change('oc', 'pc') + ')')} AS percent_text,
  CASE WHEN product_id % 5 > 0 THEN CAST((200 * (run_id % 7) + product_id % 5) // (2 * (product_id % 5)) AS INT) END AS coverage FROM v_snapshot"""
)
ORACLE["p_fetch"] = """WITH r AS (SELECT event_id, [200, 404, 410, 429, 500, 503, 302][event_id % 7 + 1] AS http, event_type = 'error' AS late,
  event_id % 5 + 1 AS a, event_id % 400 AS j, event_id % 2 = 0 AS ok FROM events),
c AS (SELECT *, CASE WHEN late THEN 'timeout' WHEN http IN (404, 410) THEN 'not_found' WHEN http = 429 THEN 'too_many_requests' WHEN http >= 500 THEN 'http_5xx'
  WHEN http <> 200 THEN 'unknown' WHEN NOT ok THEN 'parse_failed' END AS code, late OR http = 429 OR http >= 500 AS transient,
  least(500 * (1 << (a - 1)) + j, 5000) AS b FROM r)
SELECT event_id, code, transient, CASE WHEN http = 404 THEN 'CategoryPageNotFound' WHEN http = 429 THEN 'CategoryPageRateLimited'
 WHEN http >= 500 THEN 'CategoryPageServerError' WHEN http <> 200 THEN 'CategoryPageHttpError' WHEN NOT ok THEN 'CategoryPageInvalidContentType'
 WHEN late THEN 'CategoryPageEmptyBody' END AS page_kind, CASE WHEN transient AND a < 3 THEN 'Retry' ELSE 'Dead' END AS action, b AS backoff,
 CASE WHEN code = 'too_many_requests' THEN least(2 * b, 5000) ELSE b END AS queue_delay,
 least(2500 * (1 << (a - 1)) * CASE WHEN code = 'too_many_requests' THEN 2 ELSE 1 END + j, 30000) AS extract_delay FROM c"""
ORACLE["p_urls"] = r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS sch, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(\?[^#]*)', 1) AS qs,
  regexp_extract(url, '^([^?#]*)', 1) AS bare, regexp_extract(url, '^([^#]*)', 1) AS nofrag FROM pages),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg, regexp_replace(path, '[^/]*$', '') AS folder,
  substr(url, length(url) - 4, 5) AS tail FROM p),
t AS (SELECT *, regexp_replace(regexp_extract(tail, '^([^?#]*)', 1), '^/+|/+$', '', 'g') AS tp FROM s)
SELECT page_id, url AS canonical, bare AS product_url, nofrag AS page_url, 'http://' || h || path AS cleaned,
 seg[-1] AS slug, nullif(regexp_replace(regexp_replace(regexp_extract(url, '^([^?]*)', 1), '/+$', ''), '^.*/', ''), '') AS legacy_slug,
 h AS host, sch = 'https' AND h = 'm.ththth.example.net' AS on_site, sch = 'https' AS cut_absolute,
 sch || '://' || h || CASE WHEN length(folder) > 1 THEN regexp_replace(folder, '[^/]+/$', '') ELSE '/' END || 'up/x?q=1#f' AS up,
 sch || '://' || h || path || '?page=2' AS next_page, sch || '://cdn.example/a%20b' AS other_host,
 sha256(page_id || ':' || url) AS idempotency_key,
 tp <> '' AND NOT contains(tp, '/') AND NOT regexp_matches(lower(tp), '^(blog|checkout|customer|ru)') AS is_product FROM t"""
ORACLE["p_display"] = q(
    """SELECT id, unit, CASE WHEN id % 2 = 0 THEN external_id ELSE '' END AS sku, NULL::VARCHAR AS brand,
  'queued=' || id || ', enqueued=2, succeeded=3, dead=4, pending=5, retry=6' AS note, false AS same_text, pack_milli IS NOT NULL AS differs,
  ((id % 8) * 125 * 2 + 10) // 20 / 100.0 + id // 8 AS rate FROM v_card"""
)
ORACLE["s10_json_payload"] = q(
    f"""SELECT '{{"id":' || id || ',"status":"' || status || '","itemsCount":' || items_count || '}}' AS payload FROM ({_grid})"""
)
