"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

Vectors become integers on a fixed grid. Spark adds up their exact scatter matrix over the distinct
vectors; its characteristic polynomial is found modulo many primes (Hessenberg reduction, one group of
primes a task) and put together by Chinese remaindering. All its roots are real, so Descartes' rule
counts those above any point exactly: bisection isolates them, then narrows them to a high precision.
Each component is the null space of scatter minus root, by elimination in fixed-point integers and a
step of inverse iteration. Only numbers of the matrix's size ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricetrail.session import cut

#: The grid: an entry ``c`` becomes ``floor(GRID * c) + SHIFT``.
GRID, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Bits to which roots are narrowed and to which null spaces are computed, relative to the largest root.
ROOT_BITS, WORK_BITS = 160, 320
#: Leading bits that the smallest root asked for has at least.
RELATIVE_BITS = 80
#: Primes are taken downwards from here; products of two residues stay below 2**62.
_PRIME_TOP = 2**31 - 1
#: Bits of one limb of an entry, and rows summed at once: sums of limb products stay exact in doubles.
_LIMB, _ROWS = 20, 4096
#: Primes of one row handed to a task.
_PRIMES = 16


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor non-finite entries."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def on_grid(vector: Column) -> Column:
    """Entries as longs on the grid, without the shift, which no covariance sees."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * GRID).cast("long"))


def _matrix(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """``x`` as signed limbs: the sum of ``limb[k] << (_LIMB * k)``."""
    out = []
    while True:
        low = ((x + (1 << (_LIMB - 1))) & ((1 << _LIMB) - 1)) - (1 << (_LIMB - 1))
        out.append(low.astype(np.float64))
        x = (x - low) >> _LIMB
        if not x.any():
            return out


def scatter(fit: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and sums of products of the vectors ``y`` of ``fit``, exact whatever their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        count = 0
        for batch in batches:
            y = _matrix(batch, "y", dims)
            count += len(y)
            for at in range(0, len(y), _ROWS):
                limbs = [np.column_stack((part, np.full(len(part), float(k == 0)))) for k, part in enumerate(_limbs(y[at : at + _ROWS]))]
                for a, left in enumerate(limbs):
                    for b, right in enumerate(limbs):
                        # The last row and column hold ones in limb 0 only, so they give sums and the count.
                        product = (left.T @ right).astype(np.int64)
                        sums[a, b] = sums[a, b] + product if (a, b) in sums else product
        i, j = np.indices((dims + 1, dims + 1)).reshape(2, -1)
        for (a, b), value in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(i), pa.array(j), pa.array(np.full(len(i), a + b)), pa.array(value.reshape(-1))], ["i", "j", "limb", "s"]
            )

    rows = fit.mapInArrow(run, "i long, j long, limb long, s long").groupBy("i", "j", "limb").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    full = [[0] * (dims + 1) for _ in range(dims + 1)]
    for r in rows:
        full[r["i"]][r["j"]] += int(r["s"]) << (_LIMB * r["limb"])
    return full[dims][dims], full[dims][:dims], [row[:dims] for row in full[:dims]]


def _primes(number: int) -> list[int]:
    """The largest primes below 2**31, by a sieve over windows."""
    small = np.flatnonzero(_sieve(isqrt(_PRIME_TOP) + 1))
    found: list[int] = []
    top = _PRIME_TOP
    while len(found) < number:
        low = top - 200_000
        mark = np.ones(top - low + 1, dtype=bool)
        for p in small.tolist():
            mark[-low % p :: p] = False
        found += (low + np.flatnonzero(mark))[::-1].tolist()
        top = low - 1
    return found[:number]


def _sieve(n: int) -> np.ndarray:
    mark = np.ones(n + 1, dtype=bool)
    mark[:2] = False
    for p in range(2, isqrt(n) + 1):
        if mark[p]:
            mark[p * p :: p] = False
    return mark


def _inverse(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inverses modulo primes, by Fermat's rule; zero gives zero."""
    out, power, base = np.ones_like(x), p - 2, x.copy()
    while power.any():
        out = np.where(power & 1, out * base % p, out)
        base = base * base % p
        power = power >> 1
    return out


def charpoly_mod(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients of det(x I - a) modulo each prime, lowest power first.

    ``a`` holds one residue matrix for each prime of ``p``.
    """
    h, m, n = a.copy(), len(p), a.shape[1]
    q, rows = p[:, None], np.arange(len(p))
    for k in range(1, n - 1):  # reduce column k - 1 below row k
        below = h[:, k:, k - 1]
        pivot = k + np.argmax(below != 0, axis=1)
        for x in (h, h.transpose(0, 2, 1)):  # the same swap of rows and columns
            held = x[rows, pivot].copy()
            x[rows, pivot] = x[rows, k]
            x[rows, k] = held
        factor = h[:, k + 1 :, k - 1] * _inverse(h[:, k, k - 1], p)[:, None] % q
        h[:, k + 1 :] = (h[:, k + 1 :] - factor[:, :, None] * h[:, None, k] % q[:, :, None]) % q[:, :, None]
        carried = np.zeros((m, n), dtype=np.int64)
        for r in range(factor.shape[1]):
            carried += h[:, :, k + 1 + r] * factor[:, r, None] % q
        h[:, :, k] = (h[:, :, k] + carried) % q
    polys = np.zeros((n + 1, m, n + 1), dtype=np.int64)
    polys[0, :, 0] = 1
    for k in range(n):
        new = np.zeros((m, n + 1), dtype=np.int64)
        new[:, 1:] = polys[k, :, :-1]
        new = (new - h[:, k, k, None] * polys[k] % q) % q
        chain = np.ones(m, dtype=np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * h[:, i + 1, i] % p
            new = (new - (chain * h[:, i, k] % p)[:, None] * polys[i] % q) % q
        polys[k + 1] = new
    return polys[n]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(x I - matrix), lowest power first, of a positive semidefinite integer matrix.

    The k-th symmetric sum of its eigenvalues is at most C(n, k) (trace / n)^k, which says how many
    primes suffice; Spark deals the primes to tasks.
    """
    n, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    mean = trace // n + 1
    bound = 2 * max(comb(n, k) * mean**k for k in range(n + 1)) + 1
    primes = _primes(bound.bit_length() // 30 + 1)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine in batch.column(0).to_pylist():
                p = np.array(mine, dtype=np.int64)
                residues = np.array([[[v % x for v in row] for row in shared.value] for x in mine], dtype=np.int64)
                found = charpoly_mod(residues, p)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * (n + 1), pa.int32()), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(p), flat], ["p", "c"])

    groups = [(primes[at : at + _PRIMES],) for at in range(0, len(primes), _PRIMES)]
    given = spark.createDataFrame(groups, "p array<long>").repartition(min(len(groups), max(2, spark.sparkContext.defaultParallelism)))
    rows = given.mapInArrow(run, "p long, c array<long>").collect()
    modulus = 1
    for r in rows:
        modulus *= r["p"]
    parts = [(modulus // r["p"]) * pow(modulus // r["p"], -1, r["p"]) for r in rows]
    signed = lambda v: v - modulus if 2 * v > modulus else v
    return [signed(sum(part * r["c"][k] for part, r in zip(parts, rows)) % modulus) for k in range(n + 1)]


def _above(poly: list[int], at: int) -> int:
    """How many roots (with multiplicity) of a polynomial with only real roots lie above ``at``.

    Descartes' rule counts exactly where all roots are real: sign changes of the polynomial shifted to ``at``.
    """
    c = poly[::-1]  # highest first
    n = len(c) - 1
    if at:
        for last in range(n, 0, -1):
            for k in range(1, last + 1):
                c[k] += at * c[k - 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(poly: list[int], at: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * at + c
    return out


@dataclass
class Root:
    value: int  # the root times two to the power of the bits asked for
    times: int


def real_roots(poly: list[int], bits: int, most: int) -> list[Root]:
    """The largest roots, falling, each within 2**-bits of the true one, until ``most`` are counted.

    ``poly`` (lowest power first) has only real roots, none negative. A root of higher multiplicity
    is one entry; roots closer than 2**-bits count as one.
    """
    n = len(poly) - 1
    # Roots times 2**bits are the roots of this polynomial, so whole numbers are fine enough points.
    scaled = [c << (bits * (n - k)) for k, c in enumerate(poly)]
    top = (-poly[n - 1]) << bits  # the sum of the roots bounds each
    out: list[Root] = []
    todo = [(-1, top + 1, n)]  # open at the low end, roots in (low, high]
    counted = 0
    while todo and counted < most:
        low, high, times = todo.pop()
        if high - low > 1 and times > 1:
            mid = (low + high) // 2
            upper = _above(scaled, mid) - _above(scaled, high)
            if times - upper:
                todo.append((low, mid, times - upper))
            if upper:
                todo.append((mid, high, upper))
            continue
        if high - low > 1:  # one simple root: the sign decides
            sign = _value(scaled, high) > 0
            if _value(scaled, high) == 0:
                low = high - 1
            while high - low > 1:
                mid = (low + high) // 2
                value = _value(scaled, mid)
                if value == 0:
                    low, high = mid - 1, mid
                elif (value > 0) == sign:
                    high = mid
                else:
                    low = mid
        out.append(Root(high, times))
        counted += times
    return out


def null_space(matrix: list[list[int]], root: Root, root_bits: int, bits: int) -> list[list[int]]:
    """Orthonormal vectors, times 2**bits, of the null space of ``matrix - root``.

    Complete pivoting leaves the pivots that vanish for last; back substitution from them is a step of
    inverse iteration from the best start, and one more step with tiny pivots in their place follows.
    """
    n, one = len(matrix), 1 << bits
    scale = max(max(abs(v) for v in row) for row in matrix) or 1
    a = np.array([[(v << bits) // scale for v in row] for row in matrix], dtype=object)
    shift = (root.value << (bits - root_bits)) // scale
    for i in range(n):
        a[i, i] -= shift
    columns, swaps, below = list(range(n)), [], []
    solid = n - root.times
    for k in range(solid):
        rest = np.abs(a[k:, k:])
        i, j = divmod(int(np.argmax(rest)), n - k)
        a[[k, k + i]] = a[[k + i, k]]
        a[:, [k, k + j]] = a[:, [k + j, k]]
        columns[k], columns[k + j] = columns[k + j], columns[k]
        swaps.append(k + i)
        factor = (a[k + 1 :, k] << bits) // a[k, k]
        below.append(factor)
        a[k + 1 :, k:] -= (factor[:, None] * a[None, k, k:]) >> bits
    tiny = max(1, one >> root_bits)

    def back(right: np.ndarray) -> np.ndarray:
        """Solve the upper triangle; what vanished counts as ``tiny`` on the diagonal."""
        x = right.copy()
        for k in range(n - 1, -1, -1):
            if k >= solid:
                x[k] = (x[k] << bits) // tiny
            else:
                x[k] = ((x[k] - (int((a[k, k + 1 :] * x[k + 1 :]).sum()) >> bits)) << bits) // a[k, k]
        return x

    def unit(x: np.ndarray) -> np.ndarray:
        return (x << bits) // (isqrt(int((x * x).sum())) or 1)

    found: list[np.ndarray] = []
    for last in range(solid, n):
        start = np.array([0] * n, dtype=object)
        start[last] = one >> root_bits
        x = unit(back(start))
        b = np.empty(n, dtype=object)
        b[columns] = x  # in the matrix's own order, as the right side of the next step
        for k in range(solid):
            b[[k, swaps[k]]] = b[[swaps[k], k]]
            b[k + 1 :] -= (below[k] * b[k]) >> bits
        x = unit(back(b)) if root.times == 1 else x
        own = np.empty(n, dtype=object)
        own[columns] = x
        for other in found:
            own = own - ((int((own * other).sum()) >> bits) * other >> bits)
        found.append(unit(own))
    return [v.tolist() for v in found]


@dataclass
class Whitening:
    """``n`` fitted vectors with ``sums`` by dimension; unit ``vectors`` and eigenvalues of the covariance by component."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centred(self, y: np.ndarray) -> np.ndarray:
        """``n y - sums`` exactly: longs where they are sure to fit, else Python's numbers."""
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 2**62 else object
        return self.n * y.astype(kind) - np.array(self.sums, dtype=kind)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        mean_free = self.centred(y).astype(np.float64) / self.n
        return mean_free @ self.vectors.T / np.sqrt(self.values)


def fitted(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct vectors ``y`` of ``fit``; components without variance are left out."""
    spark = fit.sparkSession
    n, sums, products = scatter(fit, dims)
    # n squared times the covariance, exact.
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    trace = sum(matrix[i][i] for i in range(dims))
    vectors, values = [], []
    if trace:
        poly = characteristic_polynomial(spark, matrix)
        while poly[0] == 0:  # what has no variance
            poly = poly[1:]
        bits = max(32, ROOT_BITS - trace.bit_length())
        roots = real_roots(poly, bits, components)
        while min(r.value for r in roots) >> RELATIVE_BITS == 0:  # small ones need as many leading bits
            bits *= 2
            roots = real_roots(poly, bits, components)
        for root in roots:
            for vector in null_space(matrix, root, bits, max(WORK_BITS, 2 * bits)):
                vectors.append([v / (1 << max(WORK_BITS, 2 * bits)) for v in vector])
                values.append(_ratio(root.value, n * n << bits))
    vectors, values = vectors[:components], values[:components]
    total = _ratio(trace, n * n) if n else 0.0
    return Whitening(n, sums, np.array(vectors, dtype=np.float64).reshape(-1, dims), np.array(values), np.array(values) / total if total else np.zeros(0))


def _ratio(a: int, b: int) -> float:
    return a / b  # true division of integers rounds once, whatever their size


def _checked(fit: DataFrame, dims: int, model: Whitening) -> float:
    """The largest entry by which the covariance of the whitened fit list is off the identity, centred first."""
    shared = fit.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            total += shared.value.whitened(_matrix(batch, "y", dims)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total)], ["i", "s"])

    mean = np.zeros(k)
    for r in fit.mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        mean[r["i"]] = r["s"] / model.n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = shared.value.whitened(_matrix(batch, "y", dims)) - mean
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.reshape(-1))], ["i", "s"])

    covariance = np.zeros(k * k)
    for r in fit.mapInArrow(products, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        covariance[r["i"]] = r["s"] / model.n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max(initial=0.0))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_rows(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of ``embeddings`` (``vec_id, embedding``) and each component up to ``components``.

    The whitening is fitted on the distinct vectors, so repeated vectors count once in it and still give
    rows each. Vectors that are null or hold null or non-finite entries give no rows; vectors of several
    lengths raise ``ValueError``. Components without variance are left out, so fewer than two distinct
    vectors, vectors without entries and an empty table give no rows. Eigenvalues that are equal share
    their space: any orthonormal vectors of it are its components. ``deviation`` is null where it doesn't
    fit a long. A null ``vec_id`` stays null; other columns are not read; a vector is one row of one task,
    so very long ones (the polynomial has their length as degree) are for small tables only.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), on_grid(F.col("embedding")).alias("y"))
    sizes = rows.agg(F.min(F.size("y")).alias("a"), F.max(F.size("y")).alias("b")).first()
    dims = sizes["b"] or 0
    if not dims:
        return spark.createDataFrame([], SCHEMA)
    if sizes["a"] != dims:
        raise ValueError(f"vectors of {sizes['a']} to {dims} entries")
    fit = cut(rows.select("y").distinct())
    model = fitted(fit, dims, components)
    k = len(model.values)
    if not k:
        return spark.createDataFrame([], SCHEMA)
    error = _checked(fit, dims, model)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                y = _matrix(part, "y", dims)
                own = shared.value
                off = own.centred(y)
                # A sum of squares that might pass a long is added up in Python's numbers.
                wide = off.dtype == object or dims * int(np.abs(off).max(initial=0)) ** 2 >= 2**63
                deviation = (off.astype(object) if wide else off) ** 2
                whole = [v if v < 2**63 else None for v in deviation.sum(axis=1).tolist()]
                m = len(y)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, own.n)),
                     pa.array(whole, pa.int64()).take(pa.array(each)), pa.array(own.whitened(y).reshape(-1)), pa.array(np.tile(own.explained, m)),
                     pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, SCHEMA)
