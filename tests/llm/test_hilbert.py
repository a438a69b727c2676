import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetrail.llm import hilbert, queries

ROOT = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, curve int, rank string"


def cosine(a, b):
    dot = lambda x, y: sum(float(p) * float(q) for p, q in zip(x, y))
    return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))


def test_curve_visits_neighbouring_cells():
    side = 16
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = hilbert.hilbert_keys(cells, 4)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_recall(spark):
    found = queries.op3_nearest_vectors(spark, ROOT).toPandas()
    rows = spark.read.parquet(f"{ROOT}/embeddings.parquet").where("embedding is not null").toPandas()
    m = np.stack(rows["embedding"].values).astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = rows["vec_id"].to_numpy()
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        near = m @ m[i]
        near[i] = -9
        best = ids[np.lexsort((ids, -np.round(near, 12)))[:5]]
        mine = found[found["query_id"] == ids[i]].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and mine["score"].is_monotonic_decreasing
        hit += len(set(best) & set(mine["vec_id"]))
        total += 5
    assert hit / total >= 0.9


@pytest.mark.parametrize("block", [hilbert.BLOCK, 7])
def test_against_brute_force_where_windows_hold_all(spark, block):
    rnd = random.Random(12)
    vectors = {i: [rnd.gauss(0, 1) for _ in range(8)] for i in range(90)}
    for i in range(200, 240):  # one very common vector, and multiples of it
        vectors[i] = [1.0, 2.0, 0.0, -1.0, 0.5, 0.25, 4.0, 8.0]
    vectors[250] = [2 * x for x in vectors[200]]
    rows = [(i, v, 1, "x") for i, v in vectors.items()] + [(3, vectors[3], 1, "x")]
    bad = [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [float("inf")] + [1.0] * 7), (504, [None] + [1.0] * 7), (505, [1.0] * 9), (None, [1.0] * 8), (550, [])]
    frame = spark.createDataFrame(rows + [(*b, 1, "x") for b in bad], SCHEMA)
    got = {}
    for r in hilbert.nearest(frame, F.col("vec_id") % 10 == 0, share=1.0, block=block).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {i for i in vectors if i % 10 == 0}
    for q, ranks in got.items():
        as_float = {i: np.array(v, dtype=np.float32) for i, v in vectors.items()}
        scored = sorted((-cosine(as_float[q], v), i) for i, v in as_float.items() if i != q)
        assert [ranks[k][0] for k in range(1, 6)] == [i for _, i in scored[:5]]
        assert all(abs(ranks[k][1] + scored[k - 1][0]) < 1e-12 for k in range(1, 6))


def test_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], 1, "x"), (10, [1.0, 1.0], 1, "x"), (11, [0.0, 2.0], 1, "x")], SCHEMA)
    got = sorted(map(tuple, hilbert.nearest(frame, F.col("vec_id") % 10 == 0).select("query_id", "rank", "vec_id").collect()))
    assert got == [(0, 1, 10), (0, 2, 11), (10, 1, 0), (10, 2, 11)]
    assert hilbert.nearest(frame.limit(0), F.col("vec_id") % 10 == 0).collect() == []
