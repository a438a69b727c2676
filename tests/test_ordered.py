import random

import pytest
from pyspark.sql import functions as F

from pricetrail.operators.components import connected_components
from pricetrail.operators.ordered import FEW_SEGMENTS, Ordered, segment_count


@pytest.mark.parametrize("inclusive", [False, True])
def test_split_keys_give_the_plain_answer(spark, inclusive):
    rng = random.Random(5)
    rows = [
        (rng.choice([1, 1, 1, 1, 2, 3, None]), rng.randint(0, 30), i, rng.choice([None, 1, 2, 3]))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "k int, t int, id int, v int").repartition(3)

    def run(limit):
        o = Ordered(df, ["k"], ["t", "id"], hot_rows=limit)
        out = o.running(
            last={"prev": F.col("v")}, high={"top": F.struct("v", "id")}, total={"sum": F.col("v"), "n": F.lit(1)},
            inclusive=inclusive,
        ).whole({"all_n": F.count("*"), "best": F.max_by("id", F.struct("t", "id"))})
        assert (o.segments > 0) == (limit < 600)
        return sorted(map(str, out.result.collect()))

    expected = run(10_000)
    assert run(50) == expected
    assert run(90) == expected


def test_a_low_limit_does_not_make_a_task_of_a_few_rows(spark):
    """The tasks follow the rows, and keys that lie in several segments get the plain answer."""
    df = spark.createDataFrame([(i % 90 if i % 3 else None, i, i % 7 or None) for i in range(3000)], "k int, id int, v int")

    def run(limit):
        o = Ordered(df, ["k"], ["id"], hot_rows=limit)
        out = o.running(last={"prev": F.col("v")}, total={"n": F.lit(1)}).whole({"all_n": F.count("*")})
        return o.segments, sorted(map(str, out.result.collect()))

    segments, rows = run(5)
    assert 2 <= segments <= FEW_SEGMENTS and rows == run(10_000)[1]
    assert segment_count(36_000_000, 40) <= 72 and segment_count(36_000_000, 5_000_000) == 16


def test_components(spark):
    rng = random.Random(3)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40) if i % 10 != 9]
    edges += [(f"h{rng.randint(0, 3)}", f"x{i}") for i in range(30)] + [("self", "self")]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for node in parent:
        groups.setdefault(find(node), set()).add(node)
    assert {frozenset(g) for g in groups.values()} == {
        frozenset(n for n in got if got[n] == c) for c in set(got.values())}
