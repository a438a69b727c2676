import os

from pyspark.sql import functions as F

from pricetrail.operators.numbering import numbered
from pricetrail.session import cut, workspace


def test_a_workspace_leaves_nothing_behind(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") * 7 % 100).alias("k"))
    with workspace(spark) as path:
        numbered(cut(rows), "k", "n").write.parquet(f"{tmp_path}/out")
        local = path.removeprefix("file:")
        assert len(os.listdir(local)) == 2
    assert not os.path.exists(local)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("k").collect()
    assert [(r.k, r.n) for r in got] == [(i, i) for i in range(100)]


def test_numbers_of_an_empty_table(spark):
    assert numbered(spark.range(0), "id", "n").collect() == []
