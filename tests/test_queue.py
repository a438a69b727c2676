import datetime as dt

from pyspark.sql import functions as F

from pricetrail import schemas as S
from pricetrail.functions import status
from pricetrail.operators import breaker, queue, routing
from pricetrail.sources.tables import empty

NOW = dt.datetime(2026, 3, 1, 12)


def at(seconds):
    return NOW + dt.timedelta(seconds=seconds)


def now():
    return F.lit(NOW)


def enqueued(spark, n, max_attempts=3):
    items = spark.createDataFrame([(1, i, f"https://shop.example/{i % 10}", f"k{i % 10}") for i in range(n)],
                                  "run_id bigint, seq bigint, url string, idempotency_key string")
    return queue.enqueue(empty(spark, S.PRICE_COLLECT_QUEUE), items, max_attempts, now())


def moved(spark, rows):
    return spark.createDataFrame(
        rows, "queue_id bigint, kind string, error_code string, http_status int, message string, "
              "next_attempt_at timestamp, at timestamp, seq bigint")


def test_batches_are_disjoint_and_complete(spark):
    rows = enqueued(spark, 25)
    assert rows.count() == 10
    plan = queue.plan_batches(rows, now(), 6, 0, "w" * 200).collect()
    assert sorted(len([p for p in plan if p.batch_no == b]) for b in (0, 1)) == [4, 6]
    assert len({p.id for p in plan}) == 10
    assert plan[0].lease_until == at(1) and len(plan[0].reserved_by) == 128
    first = queue.next_batch(rows, 1, now(), 6)
    assert {r.id for r in first.collect()} == {p.id for p in plan if p.batch_no == 0}


def test_enqueue_is_idempotent(spark):
    rows = enqueued(spark, 10)
    items = spark.createDataFrame([(1, 99, " https://shop.example/3 ", "k")], "run_id bigint, seq bigint, url string, idempotency_key string")
    assert queue.enqueue(rows, items, 3, now()).count() == 0


def test_transitions_and_stats(spark):
    items = spark.createDataFrame([(7, i, ("u%d" % i) * 700, "k" * 200) for i in range(3)],
                                  "run_id bigint, seq bigint, url string, idempotency_key string")
    rows = queue.enqueue(empty(spark, S.PRICE_COLLECT_QUEUE), items, 0, now())
    ids = sorted(r.id for r in rows.collect())
    assert {r.max_attempts for r in rows.collect()} == {1}
    held = queue.reserve(rows, queue.plan_batches(rows, now(), 10, 90, "w"))
    assert {r.status for r in held.collect()} == {"reserved"}
    done = queue.apply_transitions(held, moved(spark, [
        (ids[0], "succeeded", None, None, None, None, at(1), 1),
        (ids[1], "retry", " c" * 50, 503, "m" * 600, at(60), at(2), 2),
        (ids[1], "dead", "Timeout", None, " ", None, at(3), 3),
        (ids[2], "dead", "c" * 90, 404, "m" * 600, None, at(4), 4),
    ]))
    got = {r.id: r for r in done.collect()}
    assert [got[i].status for i in ids] == ["succeeded", "dead", "dead"]
    assert [got[i].attempt for i in ids] == [0, 2, 1]
    assert (got[ids[1]].last_error_code, got[ids[1]].last_error_message, got[ids[1]].next_attempt_at) == ("Timeout", None, at(60))
    last = got[ids[2]]
    assert [len(v) for v in (last.url, last.idempotency_key, last.last_error_code, last.last_error_message)] == [1024, 128, 64, 512]
    assert last.finished_at == at(4) and last.lease_until is None
    assert tuple(queue.run_queue_stats(done, 7).first()) == (0, 0, 0, 1, 2)
    assert tuple(queue.run_queue_stats(done, 8).first()) == (0, 0, 0, 0, 0)
    assert not queue.has_outstanding(done).first().has_outstanding


def test_expired_lease_is_ready_again(spark):
    rows = enqueued(spark, 2)
    held = queue.reserve(rows, queue.plan_batches(rows, now(), 10, 5, "w"))
    assert queue.plan_batches(held, F.lit(at(6)), 10, 5, "w").count() == 0
    back = queue.reap_expired(held, F.lit(at(6)))
    row = back.first()
    assert (row.status, row.attempt, row.last_error_code, row.next_attempt_at) == ("retry", 0, "lease_expired", at(6))
    assert queue.plan_batches(back, F.lit(at(6)), 10, 5, "w").count() == 2
    assert queue.reap_expired(held, F.lit(at(5))).where("status = 'retry'").count() == 0


def test_zip_items(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["x", "y"])], "run_id bigint, urls array<string>, idempotency_keys array<string>")
    assert [tuple(r) for r in queue.zip_items(df).orderBy("pos").collect()] == [(1, 0, "a", "x"), (1, 1, "b", "y")]


def test_routing(spark):
    kind = ("queue_id bigint, run_id bigint, url string, attempt int, max_attempts int, jitter_ms int, "
            "issue " + routing.ISSUE_TYPE)
    rows = spark.createDataFrame(
        [(1, 9, "u", 0, 3, 10, ("x", "too_many_requests", 429, "m", True)),
         (2, 9, "u", 2, 3, 0, ("x", "timeout", None, "m", True)),
         (3, 9, "u", 0, 3, 0, ("x", "nonsense", 418, "m", False))], kind)
    items = rows.withColumn("issue", status.normalize_issue(F.col("issue"), True))
    moves, errors = routing.route_failures(items, now(), 500, 5000)
    got = {r.queue_id: r for r in moves.collect()}
    assert (got[1].kind, got[1].delay_ms, got[1].next_attempt_at) == ("retry", 1020, at(1.02))
    assert got[2].kind == "dead" and got[3].kind == "dead"
    assert sorted((e.queue_id, e.error_code, e.product_id) for e in errors.collect()) == [(2, "timeout", None), (3, "unknown", None)]


def test_run_end(spark):
    stats = spark.createDataFrame([(1, 0, 0, 1, 5, 0), (2, 0, 0, 0, 1, 2)],
                                  "run_id bigint, pending_count int, reserved_count int, retry_count int, succeeded_count int, dead_count int")
    plans = spark.createDataFrame([(1, "Sitemap", 8, 6), (2, "CategorySeed", 3, 3), (3, "Sitemap", 0, 0)],
                                  "run_id bigint, discovery_kind string, queued int, enqueued int")
    got = {r.run_id: r for r in routing.run_outcomes(stats, plans).collect()}
    assert (got[1].status, got[1].source, got[1].note) == ("ok", "sitemap", "queued=8, enqueued=6, succeeded=5, dead=0, pending=0, retry=1")
    assert (got[2].status, got[2].source, got[2].errors) == ("error", "category-seed", 2)
    assert got[3].status == "ok" and got[3].products_processed == 0


def test_breaker(spark):
    marks = [1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([("h", i, at(i), bool(m)) for i, m in enumerate(marks)],
                               "host string, id bigint, ts timestamp, transient boolean")
    assert sorted(r.id for r in breaker.breaker_trips(df, 3, 60).collect()) == [2, 7, 10]
    report = breaker.breaker_report(df, 3).first()
    assert (report.longest_streak, report.trips, report.approximate_rps) == (6, 3, 1.1)
    single = breaker.breaker_report(df.where("id = 0"), 3).first()
    assert single.approximate_rps == 0.0
