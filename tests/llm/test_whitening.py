import math
import random
from fractions import Fraction

import numpy as np
import pytest

from pricetrail.llm import whitening
from pricetrail.llm.queries import op12_whitened_embeddings


def brute(rows, components=16):
    """``(vec_id, component) -> (n, deviation, |whitened|, explained)`` by numpy's symmetric solver."""
    used = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in used})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    centred = np.array(fit) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    keep = values > 1e-9 * values[0]
    values, vectors = values[keep], vectors[:, keep]
    total = float((centred**2).sum() / n)
    out = []
    for i, x in used:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = (np.array(x) - mean) @ vectors / np.sqrt(values)
        out += [(i, k + 1, n, deviation, abs(w[k]), values[k] / total) for k in range(len(values))]
    return out


def check(got, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[4])
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=key)
    wanted = sorted(wanted, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in wanted]
    assert np.allclose([r[4] for r in got], [r[4] for r in wanted], rtol=1e-8, atol=1e-8)
    assert np.allclose([r[5] for r in got], [r[5] for r in wanted], rtol=1e-9)


def test_query_against_numpy(spark):
    got = op12_whitened_embeddings(spark, "/root/testdata/sf0.01").collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(got, brute(rows))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_odd_vectors(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-2, 2) for _ in range(5)]) for i in range(40)]
    rows += [(40, None), (41, [None] * 5), (42, [float("nan")] + [0.0] * 4), (43, [float("inf")] + [0.0] * 4), rows[0], (None, rows[1][1]), (44, [0.0] * 5)]
    frame = spark.createDataFrame([(i, v, 1, 2.0, "y") for i, v in rows], "vec_id long, embedding array<double>, n int, whitened double, y string")
    check(whitening.whitened_rows(frame).collect(), brute(rows))
    check(whitening.whitened_rows(frame, 2).collect(), [r for r in brute(rows) if r[1] <= 2])
    for few in (frame.limit(0), frame.limit(1), frame.where("vec_id = 41"), frame.select("vec_id", whitening.F.array().cast("array<double>").alias("embedding"))):
        assert whitening.whitened_rows(few).collect() == []
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        whitening.whitened_rows(mixed)


def test_dependent_dimensions_and_large_entries(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(30):
        a, b = rnd.uniform(-3e7, 3e7), rnd.uniform(-2, 2)
        a, b = math.floor(a * 64) / 64, math.floor(b * 64) / 64
        rows.append((i, [a, b, a, a + b]))  # two directions at most
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whitened_rows(frame).collect()
    assert {r["component"] for r in got} == {1, 2}
    assert max(r["identity_error"] for r in got) < 1e-4
    assert sorted(r["deviation"] or -1 for r in got if r["component"] == 1) == sorted(r[3] if r[3] < 2**63 else -1 for r in brute(rows) if r[1] == 1)


def test_equal_eigenvalues_share_their_space(spark):
    rows = [(i, [float(s * (i // 2 == j)) for j in range(4)]) for i, s in enumerate([1, -1] * 4)]
    got = whitening.whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1, 2, 3, 4}
    assert all(abs(r["explained"] - 0.25) < 1e-12 for r in got) and got[0]["identity_error"] < 1e-12


def exact_polynomial(a):
    """Faddeev and LeVerrier's recurrence in fractions."""
    n = len(a)
    m = [[Fraction(0)] * n for _ in range(n)]
    out = [Fraction(1)]
    for k in range(1, n + 1):
        m = [[sum(a[i][r] * m[r][j] for r in range(n)) + (out[-1] if i == j else 0) for j in range(n)] for i in range(n)]
        out.append(-sum(sum(a[i][r] * m[r][i] for r in range(n)) for i in range(n)) / k)
    return [int(c) for c in reversed(out)]


def test_polynomial_and_roots(spark):
    rnd = random.Random(5)
    for n, r in ((1, 1), (2, 2), (6, 6), (7, 3)):
        b = [[rnd.randint(-(10**6), 10**6) * (rnd.random() < 0.7) for _ in range(r)] for _ in range(n)]
        a = [[sum(x * y for x, y in zip(u, v)) for v in b] for u in b]
        poly = whitening.characteristic_polynomial(spark, a)
        assert poly == exact_polynomial(a)
    # (x - 2)^2 (x - 5) (x - 9)
    poly = [180, -236, 105, -18, 1]
    assert [(r.value >> 20, r.times) for r in whitening.real_roots(poly, 20, 4)] == [(9, 1), (5, 1), (2, 2)]
    assert [(r.value >> 20, r.times) for r in whitening.real_roots(poly, 20, 2)] == [(9, 1), (5, 1)]


def test_limbs():
    x = np.array([[0, 1, -1, 2**40 + 5, -(2**61) + 3]])
    assert sum(part.astype(np.int64).astype(object) * (1 << 20 * k) for k, part in enumerate(whitening._limbs(x))).tolist() == x.tolist()
