import datetime as dt
import gzip

from pricetrail import schemas as S
from pricetrail.functions.sql import register_sql_functions
from pricetrail.operators.grid import grid_query
from pricetrail.operators.legacy import append_missing
from pricetrail.sources import documents, tables

import pytest


def test_tables_round_trip(spark, tmp_path):
    row = (1, 2, 3, dt.datetime(2026, 1, 2), None, None, False, True, None)
    df = spark.createDataFrame([row], S.PRICE_SNAPSHOT)
    tables.write_snapshots(df, str(tmp_path))
    back = tables.read_table(spark, str(tmp_path), "price_snapshot")
    assert [tuple(r) for r in back.collect()] == [row]
    tables.write_table(tables.empty(spark, S.PRODUCT), str(tmp_path), "product")
    assert tables.read_table(spark, str(tmp_path), "product").count() == 0


def test_gzip_and_log(spark, tmp_path):
    folder = tmp_path / "maps"
    folder.mkdir()
    with gzip.open(folder / "a.xml.gz", "wt") as f:
        f.write("<urlset><url><loc>http://a</loc></url>\n<url><loc>http://b</loc></url></urlset>")
    docs = documents.sitemap_documents(documents.read_sitemap_files(spark, str(folder)))
    log = str(tmp_path / "log")
    documents.append_locs_log(docs, log)
    documents.append_locs_log(docs, log)
    assert spark.read.text(log).count() == 4


def test_camel_case(spark):
    df = spark.sql("select 1 as snapshot_id, array(named_struct('run_id', 2, 'old_price', cast(null as double))) as all_points")
    assert tables.json_payload(df).first().payload == '{"snapshotId":1,"allPoints":[{"runId":2,"oldPrice":null}]}'


def test_sql_functions(spark):
    register_sql_functions(spark)
    row = spark.sql(
        "select trim_nullable('  abc ', 2) a, trim_nullable('  ', 2) b, trim_required(null, 3) c, run_status(' OK ') d, "
        "queue_status('x') e, discount_percent(old_price => 24.50, price => 19.90) f, price_change_percent(21.50, 19.90) g"
    ).first()
    assert tuple(map(str, row)) == ("ab", "None", "", "ok", "pending", "18.8", "-7.4")
    spark.createDataFrame([(1, "dead"), (1, "dead"), (2, "retry")], "run_id bigint, status string").createOrReplaceTempView("price_collect_queue")
    register_sql_functions(spark, with_tables=True)
    assert tuple(spark.sql("select * from queue_run_stats(1)").first()) == (0, 0, 0, 0, 2)


def test_grid(spark):
    df = spark.createDataFrame([(i, f"N{i % 3}", i % 4 or None) for i in range(20)], "id int, name string, n int")
    rows, total = grid_query(df, [("n", "isnotnull"), ("name", "contains", "n1")], ("1", ["id", "city"]), [("n", "desc"), ("id", "asc")], 1, 3)
    assert [r.id for r in rows.collect()] == [19, 10, 1] and total.first().total == 4
    assert grid_query(df)[0].count() == 20
    with pytest.raises(ValueError):
        grid_query(df, [("n", "like", 1)])


def test_append_missing(spark):
    have = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string")
    assert [tuple(r) for r in append_missing(have, new, "id").collect()] == [(2, "c")]
