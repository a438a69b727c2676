"""Status words and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pricetrail import schemas as S
from pricetrail.functions import text


def _word(value: Column) -> Column:
    return F.lower(F.coalesce(F.trim(value), F.lit("")))


def run_status(value: Column) -> Column:
    word = _word(value)
    return F.when(word.isin("running", "ok"), word).otherwise("error")


def queue_status(value: Column) -> Column:
    word = _word(value)
    return F.when(word.isin("reserved", "retry", "succeeded", "dead"), word).otherwise("pending")


def stored_run_status(value: Column) -> Column:
    """Stored status as shown in grids: exact words, anything else is an error."""
    return F.when(value == "running", "running").when(value == "ok", "ok").otherwise("error")


def legacy_run_status(value: Column) -> Column:
    word = value.cast("string")
    return (
        F.when(word.isin("0", "running"), "running")
        .when(word.isin("1", "ok"), "ok")
        .otherwise("error")
    )


def outcome_label(is_successful: Column) -> Column:
    return F.when(is_successful, "OK").otherwise("Failed")


def scope_name(scope: str | None) -> str:
    word = (scope or "").strip().lower()
    return word if word in ("successful", "failed") else "all"


def scope_column(scope: Column) -> Column:
    word = F.lower(text.strip(scope))
    return F.when(word.isin("successful", "failed"), word).otherwise("all")


def item_error_code(code: Column) -> Column:
    return F.when(code.isin(*S.ITEM_ERROR_CODES), code).otherwise(S.UNKNOWN_ERROR)


def normalize_issue(issue: Column, critical: Column | bool) -> Column:
    """Struct ``stage, error_code, http_status, message, is_transient, is_critical``."""
    stage = F.lower(text.strip(issue["stage"]))
    return F.struct(
        F.when(text.is_blank(issue["stage"]), "extract").otherwise(stage).alias("stage"),
        item_error_code(issue["error_code"]).alias("error_code"),
        issue["http_status"].alias("http_status"),
        text.trim_message(issue["message"]).alias("message"),
        F.coalesce(issue["is_transient"], F.lit(False)).alias("is_transient"),
        (critical if isinstance(critical, Column) else F.lit(critical)).alias("is_critical"),
    )


def live_status(has_card: Column, has_issue: Column) -> Column:
    return F.when(has_card & ~has_issue, "success").when(has_card, "partial").otherwise("error")


def run_source(discovery_kind: Column) -> Column:
    return F.when(discovery_kind == "CategorySeed", "category-seed").otherwise("sitemap")


def run_note(
    queued: Column, enqueued: Column, succeeded: Column, dead: Column, pending: Column, retry: Column
) -> Column:
    return F.format_string(
        "queued=%d, enqueued=%d, succeeded=%d, dead=%d, pending=%d, retry=%d",
        queued, enqueued, succeeded, dead, pending, retry,
    )
