"""Table schemas, value sets and text lengths of the price-observation model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
PACK = T.DecimalType(18, 6)
PERCENT = T.DecimalType(18, 1)


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "DECIMAL(18,2)": MONEY,
    "DECIMAL(18,6)": PACK,
}


def _schema(columns: str) -> T.StructType:
    """``name TYPE [NOT NULL], ...`` without needing a running session."""
    fields = []
    for column in columns.split(", "):
        name, kind, *rest = column.split(" ")
        fields.append(T.StructField(name, _TYPES[kind], not rest))
    return T.StructType(fields)


CRAWLER_RUN = _schema(
    "id BIGINT NOT NULL, started_at TIMESTAMP NOT NULL, finished_at TIMESTAMP, "
    "status STRING NOT NULL, source STRING NOT NULL, note STRING"
)
INGESTION_RUN = _schema(
    "ingestion_run_id BIGINT NOT NULL, crawler_run_id BIGINT NOT NULL, "
    "started_at TIMESTAMP NOT NULL, finished_at TIMESTAMP, status STRING NOT NULL, "
    "error_code STRING, error_message STRING"
)
PRODUCT = _schema(
    "id BIGINT NOT NULL, external_id STRING, name STRING NOT NULL, url STRING NOT NULL, "
    "slug STRING, pack_value DECIMAL(18,6), pack_unit STRING, "
    "created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP"
)
PRICE_COLLECT_QUEUE = _schema(
    "id BIGINT NOT NULL, run_id BIGINT NOT NULL, url STRING NOT NULL, status STRING NOT NULL, "
    "attempt INT NOT NULL, max_attempts INT NOT NULL, next_attempt_at TIMESTAMP, "
    "reserved_at TIMESTAMP, lease_until TIMESTAMP, reserved_by STRING, idempotency_key STRING, "
    "last_error_code STRING, last_http_status INT, last_error_message STRING, "
    "created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP, finished_at TIMESTAMP"
)
PRICE_SNAPSHOT = _schema(
    "id BIGINT NOT NULL, run_id BIGINT NOT NULL, product_id BIGINT NOT NULL, "
    "captured_at TIMESTAMP NOT NULL, price DECIMAL(18,2), old_price DECIMAL(18,2), "
    "promo_flag BOOLEAN NOT NULL, in_stock BOOLEAN NOT NULL, queue_id BIGINT"
)
CRAWL_ERROR = _schema(
    "id BIGINT NOT NULL, run_id BIGINT NOT NULL, queue_id BIGINT, product_id BIGINT, "
    "url STRING, error_code STRING, http_status INT, error_message STRING, "
    "created_at TIMESTAMP NOT NULL"
)
OBSERVATION = _schema(
    "seq BIGINT NOT NULL, run_id BIGINT, queue_id BIGINT, external_id STRING, name STRING, "
    "url STRING, slug STRING, pack_value DECIMAL(18,6), pack_unit STRING, "
    "price DECIMAL(18,2), old_price DECIMAL(18,2), promo_flag BOOLEAN, in_stock BOOLEAN, "
    "observed_at TIMESTAMP"
)

BUSINESS_TABLES = {
    "crawler_run": CRAWLER_RUN,
    "ingestion_run": INGESTION_RUN,
    "product": PRODUCT,
    "price_collect_queue": PRICE_COLLECT_QUEUE,
    "price_snapshot": PRICE_SNAPSHOT,
    "crawl_error": CRAWL_ERROR,
}

# Stored lengths, status words, error codes, failure kinds and stop reasons.
TEXT_LENGTHS = {
    "external_id": 64,
    "name": 512,
    "url": 1024,
    "slug": 512,
    "pack_unit": 16,
    "idempotency_key": 128,
    "reserved_by": 128,
    "source": 64,
    "note": 255,
    "run_error_code": 128,
    "error_code": 64,
    "error_message": 512,
}
RUN_STATUSES = ("running", "ok", "error")
QUEUE_STATUSES = ("pending", "reserved", "retry", "succeeded", "dead")
OUTSTANDING_STATUSES = ("pending", "retry", "reserved")
ITEM_ERROR_CODES = ("not_found", "too_many_requests", "timeout", "http_5xx", "parse_failed")
UNKNOWN_ERROR = "unknown"
DISCOVERY_UNAVAILABLE = "ProductUrlDiscoveryUnavailable"
SNAPSHOT_SCOPES = ("none", "all", "successful", "failed")
STOP_NO_NEW = "NoNewProductUrls"
STOP_NO_NEXT = "NoNextPage"
STOP_MAX_PAGES = "MaxCategoryPagesPerSeed"
STOP_UNAVAILABLE = "PageUnavailable"
SITEMAP_NAMES = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")
PRODUCT_PATH_DENY_PREFIXES = (
    "brands/", "blog", "checkout", "customer", "img/", "media/", "ru",
)

DEFAULT_SOURCE = "shop"
MAX_TOP_LEVEL_SITEMAPS = 10
