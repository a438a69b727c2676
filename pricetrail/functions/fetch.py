"""Fetch outcomes and retry arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def classify_http(status: Column, timed_out: Column, parsed: Column) -> Column:
    """Struct ``code, transient``; both null/false for a parsed 200 page."""

    def outcome(code: str, transient: bool) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(transient).alias("transient"))

    return (
        F.when(timed_out, outcome("timeout", True))
        .when(status.isin(404, 410), outcome("not_found", False))
        .when(status == 429, outcome("too_many_requests", True))
        .when(status >= 500, outcome("http_5xx", True))
        .when(status.isNull() | (status != 200), outcome("unknown", False))
        .when(~parsed, outcome("parse_failed", False))
        .otherwise(F.struct(F.lit(None).cast("string").alias("code"), F.lit(False).alias("transient")))
    )


def classify_category_page(status: Column, content_type: Column, body: Column) -> Column:
    """Failure kind of a category page, null when usable."""
    blank = F.coalesce(body.rlike(r"^(?U)\s*$"), F.lit(True))
    return (
        F.when(status == 404, "CategoryPageNotFound")
        .when(status == 403, "CategoryPageForbidden")
        .when(status == 429, "CategoryPageRateLimited")
        .when(status >= 500, "CategoryPageServerError")
        .when(status.isNull() | (status != 200), "CategoryPageHttpError")
        .when(~F.coalesce(F.lower(content_type).contains("html"), F.lit(False)),
              "CategoryPageInvalidContentType")
        .when(blank, "CategoryPageEmptyBody")
    )


def sitemap_failure_kind(
    status: Column, content_type: Column, body: Column, well_formed: Column, root: Column
) -> Column:
    """Ordered checks on a fetched sitemap; null means usable."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    preview = F.lower(F.substring(body, 1, 512))
    start = F.regexp_replace(preview, r"(?U)^\s+", "")
    html = (
        kind.contains("text/html")
        | start.startswith("<html")
        | start.startswith("<!doctype html")
        | start.contains("<title>404 not found</title>")
    )
    blank = F.coalesce(body.rlike(r"^(?U)\s*$"), F.lit(True))
    return (
        F.when(status == 404, "NotFound")
        .when(status == 403, "Forbidden")
        .when(status == 429, "RateLimited")
        .when(status >= 500, "ServerError")
        .when(status.isNull() | (status != 200), "UnexpectedStatusCode")
        .when(blank, "EmptyBody")
        .when(html, "HtmlInsteadOfXml")
        .when(~kind.contains("xml"), "InvalidContentType")
        .when(~well_formed, "InvalidXml")
        .when(~F.coalesce(root.isin("sitemapindex", "urlset"), F.lit(False)), "InvalidXml")
    )


def retry_action(transient: Column, attempt: Column, max_attempts: Column) -> Column:
    again = transient & (attempt < F.greatest(F.lit(1), max_attempts))
    return F.when(again, "Retry").otherwise("Dead")


def _doubling(base: Column, attempt: Column) -> Column:
    exponent = F.greatest(attempt, F.lit(1)) - 1
    return F.greatest(base, F.lit(1)) * F.pow(F.lit(2.0), exponent)


def backoff_ms(attempt: Column, base_ms: Column, max_ms: Column, jitter_ms: Column) -> Column:
    floor = F.greatest(base_ms, F.lit(1))
    delay = _doubling(base_ms, attempt) + F.greatest(jitter_ms, F.lit(0))
    return F.least(delay, F.greatest(floor, max_ms)).cast("bigint")


def queue_retry_delay_ms(
    code: Column, attempt: Column, base_ms: Column, max_ms: Column, jitter_ms: Column
) -> Column:
    delay = backoff_ms(attempt, base_ms, max_ms, jitter_ms)
    doubled = F.least(delay * 2, F.greatest(max_ms, F.lit(1)).cast("bigint"))
    return F.when(F.lower(code) == "too_many_requests", doubled).otherwise(delay)


def extractor_retry_delay_ms(
    code: Column, attempt: Column, base_ms: Column, jitter_ms: Column
) -> Column:
    """Jitter is a column so that the result is repeatable."""
    delay = _doubling(base_ms, attempt)
    factor = F.when(F.lower(code) == "too_many_requests", 2.0).otherwise(1.0)
    return F.least(delay * factor + jitter_ms, F.lit(30000.0)).cast("bigint")
