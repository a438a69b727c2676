"""Price-collection queue as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricetrail import schemas as S
from pricetrail.functions import status, text, urls
from pricetrail.operators.numbering import numbered
from pricetrail.operators.ordered import Ordered

QUEUE_COLUMNS = S.PRICE_COLLECT_QUEUE.fieldNames()


def zip_items(runs: DataFrame) -> DataFrame:
    """``run_id, urls[], idempotency_keys[]`` to one row per position."""
    zipped = F.arrays_zip(F.col("urls").alias("url"), F.col("idempotency_keys").alias("idempotency_key"))
    return runs.select("run_id", F.posexplode(zipped).alias("pos", "item")).select(
        "run_id", "pos", F.col("item.url").alias("url"), F.col("item.idempotency_key").alias("idempotency_key")
    )


def build_items(items: DataFrame) -> DataFrame:
    """Rows ``run_id, seq, url`` with the cut url and its idempotency key."""
    return items.withColumns(
        {
            "idempotency_key": urls.idempotency_key(F.col("run_id"), F.col("url")),
            "url": text.strip_and_cut(F.col("url"), S.TEXT_LENGTHS["url"]),
        }
    )


def enqueue(queue: DataFrame, items: DataFrame, max_attempts: int | None, now: Column) -> DataFrame:
    """The rows to append for ``items(run_id, seq, url, idempotency_key)``.

    One row per (run, url), first ``seq`` wins, rows already queued are left alone.
    New ids are consecutive in the order of ``seq``, which is unique over the batch.
    """
    base = F.coalesce(queue.agg(F.max("id") + 1).scalar(), F.lit(1)).cast("bigint")
    fresh = (
        items.withColumn("url", text.trim_required(F.col("url"), S.TEXT_LENGTHS["url"]))
        .groupBy("run_id", "url")
        .agg(F.min("seq").alias("seq"), F.min_by("idempotency_key", "seq").alias("key"))
        .join(queue.select("run_id", "url"), ["run_id", "url"], "left_anti")
    )
    fresh = numbered(fresh, "seq", "_number")
    stamp = now.cast(queue.schema["created_at"].dataType)
    values: dict[str, Column] = {f.name: F.lit(None).cast(f.dataType) for f in queue.schema.fields}
    values |= {
        "id": base + F.col("_number"),
        "run_id": F.col("run_id"),
        "url": F.col("url"),
        "status": F.lit("pending"),
        "attempt": F.lit(0),
        "max_attempts": F.lit(max(max_attempts or 0, 1)),
        "next_attempt_at": stamp,
        "idempotency_key": text.trim_required(F.col("key"), S.TEXT_LENGTHS["idempotency_key"]),
        "created_at": stamp,
        "updated_at": stamp,
    }
    return fresh.select(*[c.alias(n) for n, c in values.items()])


def due_at(as_of: Column) -> Column:
    return F.coalesce(F.col("next_attempt_at"), F.col("created_at"), as_of)


def ready(queue: DataFrame, as_of: Column) -> DataFrame:
    """F5."""
    return queue.where(F.col("status").isin("pending", "retry") & (due_at(as_of) <= as_of))


def plan_batches(
    queue: DataFrame, as_of: Column, batch_size: int, lease_seconds: int, worker: str = "",
    hot_rows: int | None = None,
) -> DataFrame:
    """Every ready item with its batch number within the run, in due order."""
    size = max(batch_size or 0, 1)
    rows = ready(queue, as_of).withColumn("due_at", due_at(as_of))
    counted = Ordered(rows, ["run_id"], ["due_at", "id"], hot_rows=hot_rows).running(
        total={"_earlier": F.lit(1)}
    ).result
    batch = F.floor(F.col("_earlier") / size).cast("bigint")
    lease = F.make_interval(secs=F.lit(max(lease_seconds or 0, 1)))
    return counted.select(
        "id", "run_id", "url", "attempt", "max_attempts",
        F.coalesce("idempotency_key", F.lit("")).alias("idempotency_key"),
        "due_at",
        batch.alias("batch_no"),
        (F.col("_earlier") - batch * size + 1).cast("bigint").alias("batch_position"),
        as_of.alias("reserved_at"),
        (as_of + lease).alias("lease_until"),
        text.trim_required(F.lit(worker), S.TEXT_LENGTHS["reserved_by"]).alias("reserved_by"),
    )


def next_batches(queue: DataFrame, as_of: Column, batch_size: int) -> DataFrame:
    """O3: the first batch of every run; rows behind it are dropped before the shuffle."""
    first = Window.partitionBy("run_id").orderBy(due_at(as_of), "id")
    ranked = ready(queue, as_of).withColumn("_n", F.row_number().over(first))
    return ranked.where(F.col("_n") <= max(batch_size or 0, 1)).drop("_n")


def next_batch(queue: DataFrame, run_id: int, as_of: Column, batch_size: int) -> DataFrame:
    """O3 for one run."""
    return next_batches(queue.where(F.col("run_id") == run_id), as_of, batch_size).orderBy(due_at(as_of), "id")


def reserve(queue: DataFrame, batch: DataFrame) -> DataFrame:
    """The queue with a planned batch marked as reserved."""
    taken = batch.select(
        "id", *[F.col(n).alias(f"_{n}") for n in ("reserved_at", "lease_until", "reserved_by")]
    )
    hit = F.col("_reserved_at").isNotNull()
    joined = queue.join(taken, "id", "left")
    changes = {"status": F.when(hit, "reserved").otherwise(F.col("status"))}
    for name in ("reserved_at", "lease_until", "reserved_by"):
        changes[name] = F.when(hit, F.col(f"_{name}")).otherwise(F.col(name))
    changes["updated_at"] = F.when(hit, F.col("_reserved_at")).otherwise(F.col("updated_at"))
    return joined.withColumns(changes).select(*queue.columns)


def apply_transitions(queue: DataFrame, transitions: DataFrame) -> DataFrame:
    """The queue after ``succeeded``, ``retry`` and ``dead`` transitions.

    ``transitions``: queue_id, kind, error_code, http_status, message, next_attempt_at, at,
    seq. Several per item apply in (at, seq) order; they are combined before the join.
    """
    kind = F.col("kind")
    failed = kind.isin("retry", "dead")
    place = F.struct("at", "seq")
    error = F.struct(
        text.trim_required(F.col("error_code"), S.TEXT_LENGTHS["error_code"]).alias("code"),
        F.col("http_status").alias("http"),
        text.trim_nullable(F.col("message"), S.TEXT_LENGTHS["error_message"]).alias("message"),
    )
    moves = (
        transitions.where(kind.isin("succeeded", "retry", "dead")).groupBy("queue_id").agg(
            F.max_by(kind, place).alias("_status"),
            F.max("at").alias("_at"),
            F.count_if(failed).cast("int").alias("_failures"),
            F.max_by(error, F.when(failed, place)).alias("_error"),
            F.max_by(F.struct("next_attempt_at"), F.when(kind == "retry", place)).alias("_next"),
            F.max(F.when(kind != "retry", F.col("at"))).alias("_finished"),
        )
    )
    hit = F.col("_at").isNotNull()

    def cleared(name: str) -> Column:
        return F.when(~hit, F.col(name))

    def from_error(field: str, name: str) -> Column:
        return F.when(F.col("_error").isNotNull(), F.col(f"_error.{field}")).otherwise(F.col(name))

    changes = {
        "status": F.coalesce("_status", "status"),
        "attempt": F.col("attempt") + F.coalesce("_failures", F.lit(0)),
        "next_attempt_at": F.when(F.col("_next").isNotNull(), F.col("_next.next_attempt_at"))
        .otherwise(F.col("next_attempt_at")),
        "reserved_at": cleared("reserved_at"),
        "lease_until": cleared("lease_until"),
        "reserved_by": cleared("reserved_by"),
        "last_error_code": from_error("code", "last_error_code"),
        "last_http_status": from_error("http", "last_http_status"),
        "last_error_message": from_error("message", "last_error_message"),
        "updated_at": F.coalesce("_at", "updated_at"),
        "finished_at": F.coalesce("_finished", "finished_at"),
    }
    joined = queue.join(moves, queue["id"] == moves["queue_id"], "left")
    return joined.withColumns(changes).select(*queue.columns)


def expired(as_of: Column) -> Column:
    """F6."""
    return F.coalesce(
        (F.col("status") == "reserved") & (F.col("lease_until") < as_of), F.lit(False)
    )


def reap_expired(queue: DataFrame, as_of: Column) -> DataFrame:
    """Expired leases go back to retry; the attempt is not counted."""
    hit = expired(as_of)
    code = F.coalesce("last_error_code", F.lit("lease_expired"))
    message = F.coalesce("last_error_message", F.lit("The lease ran out"))
    flagged = queue.withColumn("_hit", hit)
    on = F.col("_hit")

    def pick(value: Column, name: str) -> Column:
        return F.when(on, value).otherwise(F.col(name))

    return flagged.withColumns(
        {
            "next_attempt_at": pick(as_of, "next_attempt_at"),
            "reserved_at": F.when(~on, F.col("reserved_at")),
            "lease_until": F.when(~on, F.col("lease_until")),
            "reserved_by": F.when(~on, F.col("reserved_by")),
            "updated_at": pick(as_of, "updated_at"),
            "last_error_code": pick(code, "last_error_code"),
            "last_error_message": pick(message, "last_error_message"),
            "status": pick(F.lit("retry"), "status"),
        }
    ).select(*queue.columns)


def has_outstanding(queue: DataFrame) -> DataFrame:
    """T7 per run."""
    return queue.groupBy("run_id").agg(
        F.bool_or(F.col("status").isin(*S.OUTSTANDING_STATUSES)).alias("has_outstanding")
    )


def _counts() -> list[Column]:
    return [
        F.count_if(F.col("status") == name).cast("int").alias(f"{name}_count")
        for name in S.QUEUE_STATUSES
    ]


def queue_stats(queue: DataFrame) -> DataFrame:
    """T8, A4 per run."""
    return queue.groupBy("run_id").agg(*_counts())


def run_queue_stats(queue: DataFrame, run_id: int) -> DataFrame:
    """A4 for one run: always one row, zeros when the run has no items."""
    return queue.where(F.col("run_id") == run_id).agg(*_counts())


def latest_states(events: DataFrame) -> DataFrame:
    """Newest status per (run, item) out of ``run_id, item_id, transition, at, event_id``."""
    newest = Window.partitionBy("run_id", "item_id").orderBy(F.desc("at"), F.desc("event_id"))
    return (
        events.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        .withColumn("status", status.queue_status(F.col("transition")))
    )
