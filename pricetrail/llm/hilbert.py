"""Approximate nearest neighbours by cosine on shifted space-filling curves.

Unit vectors are projected to a few dimensions, several times over with other axes and shifts, and
each projection orders all rows along a Hilbert curve. Spark sorts every curve by range partitioning;
a row's rank puts it into a block of its curve, a query looks at the blocks of its window around its
own rank, and what the windows of all curves find is merged and ranked by exact scores. Rows with
equal vectors are one class here, so a very common vector is looked at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricetrail.llm.frames import unit
from pricetrail.session import cut

CURVES = 16
DIMS = 8
BITS = 7
#: Each side of a query's window holds at least this share of all classes. The vectors these tables
#: hold have no directions that matter more than others, so recall follows the share looked at.
SHARE = 0.02
#: Rows of a block, at most and at least.
BLOCK = 4096
LEAST = 64
#: Vectors that the ranges of the projections are read from, on average.
SAMPLE = 4000
K = 5
SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (rows of ``bits``-bit coordinates)."""
    axes = [column.astype(np.uint64) for column in cells.T]
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > 1:
        low = q - one
        for i in range(len(axes)):
            flip = (axes[i] & q) > 0
            swap = np.where(flip, np.uint64(0), (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(flip, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap if i else axes[0]
        q >>= one
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn, q = np.zeros(len(cells), dtype=np.uint64), one << np.uint64(bits - 1)
    while q > 1:
        turn = np.where((axes[-1] & q) > 0, turn ^ (q - one), turn)
        q >>= one
    key = np.zeros(len(cells), dtype=np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << one) | (((axis ^ turn) >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class Curves:
    """Axes, ranges and shifts of all curves, from a sample of vectors."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int) -> None:
        rng = np.random.default_rng(SEED)
        self.bits, rows = bits, _unit_rows(sample)
        width = rows.shape[1]
        self.axes, self.low, self.span = [], [], []
        for _ in range(curves):
            square = np.linalg.qr(rng.normal(size=(width, width)))[0]
            axes = square[:, : min(dims, width)]
            seen = rows @ axes
            low, high = np.quantile(seen, (0.001, 0.999), axis=0)
            span = np.maximum(high - low, 1e-12)
            # The range fills half of the curve's cube; the shift says which half.
            self.axes.append(axes)
            self.low.append(low - rng.uniform(0, 1, len(span)) * span)
            self.span.append(2 * span)

    def keys(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        rows, top = _unit_rows(vectors), (1 << self.bits) - 1
        for axes, low, span in zip(self.axes, self.low, self.span):
            cells = np.clip((rows @ axes - low) / span * (top + 1), 0, top)
            yield hilbert_keys(cells.astype(np.int64), self.bits)


def _cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of rows that take part: a known id, finite components, not all zero, the usual length."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    )
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (usual["n"] if usual else 0))


def _block_scores(top: int):
    """Rows sorted by curve, block and kind: for each query its best classes of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(part: pa.Table) -> pa.RecordBatch:
            asks = part.column("asks").to_numpy()
            ids, rows = part.column("class_id").to_numpy(), _unit_rows(_matrix(part.column("embedding").combine_chunks()))
            found, queries = rows[~asks], rows[asks]
            names, askers = ids[~asks], ids[asks]
            by_id = np.argsort(names)
            names, found = names[by_id], found[by_id]
            out = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
            if len(names) and len(askers):
                score = queries @ found.T
                n = min(top, len(names))
                best = np.argsort(-score, axis=1, kind="stable")[:, :n]
                out = [np.repeat(askers, n), names[best].reshape(-1), np.take_along_axis(score, best, 1).reshape(-1)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query", "class_id", "score"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            curve, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((curve[1:] != curve[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(curve)]):
                key = (curve[a], block[a])
                if last is not None and key != last and held:
                    yield scored(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield scored(pa.Table.from_batches(held))

    return run


def nearest(
    vectors: DataFrame, queries: Column, k: int = K, curves: int = CURVES, share: float = SHARE, dims: int = DIMS, bits: int = BITS,
    block: int = BLOCK, least: int = LEAST,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row that ``queries`` selects.

    Reads ``vec_id, embedding``; other columns are not read. Vectors that are null, zero, of an unusual
    length or hold null or non-finite components take no part, nor do rows without an id. Ties go to
    the smaller vec_id; with fewer candidates all are returned; equal vectors have equal scores; rows
    that repeat an id and its vector are one; an empty table gives no rows. A vector of any length is one
    value of one row.
    """
    rows = usable(vectors)
    # One class for each vector. Beyond k + 1 rows of a class, those with larger ids are never among the nearest.
    first = W.partitionBy("embedding").orderBy("vec_id")
    classes = cut(
        rows.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
        .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(F.col("ids")[0].alias("class_id"), "ids", "embedding")
    )
    asked = rows.where(queries).distinct().withColumn("hash", F.xxhash64("embedding"))
    named = classes.select(F.xxhash64("embedding").alias("hash"), "embedding", "class_id")
    asked = cut(asked.join(named, ["hash", "embedding"]).select(F.col("vec_id").alias("query_id"), "class_id"))
    count = classes.count()
    if not count:
        return asked.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"))
    picked = classes.where(unit("class_id", seed=SEED) < max(SAMPLE, 1) / count).select("embedding").toPandas()["embedding"]
    if not len(picked):
        picked = classes.limit(1).select("embedding").toPandas()["embedding"]
    shape = classes.sparkSession.sparkContext.broadcast(Curves(np.array([np.asarray(v, dtype=np.float64) for v in picked]), curves, dims, bits))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, keys in enumerate(shape.value.keys(_matrix(batch.column(1)))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), c)), pa.array(keys), batch.column(0)], ["curve", "key", "class_id"]
                )

    parts = max(curves, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = classes.select("class_id", "embedding").mapInArrow(place, "curve long, key long, class_id long")
    ordered = cut(
        placed.repartitionByRange(parts, "curve", "key", "class_id").sortWithinPartitions("curve", "key", "class_id")
        .select("curve", "class_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    )
    # Few rows, one for each partition: where its ranks begin.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    window = max(least, int(np.ceil(share * count)))
    size = min(block, window)
    reach = -(-window // size)
    rank = F.col("begin") + F.col("at") - F.col("curve") * count
    blocks = ordered.join(F.broadcast(offsets), "part").select("curve", "class_id", F.floor(rank / size).alias("block"))
    with_vectors = blocks.join(classes.select("class_id", "embedding"), "class_id")
    looked = with_vectors.join(asked.select("class_id").distinct(), "class_id", "left_semi")
    asks = looked.select(
        "curve", F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)).alias("block"), F.lit(True).alias("asks"), "class_id", "embedding"
    ).where((F.col("block") >= 0) & (F.col("block") <= (count - 1) // size))
    both = with_vectors.select("curve", "block", F.lit(False).alias("asks"), "class_id", "embedding").union(asks)
    found = (
        both.repartition("curve", "block").sortWithinPartitions("curve", "block")
        .mapInArrow(_block_scores(2 * k + 2), "query long, class_id long, score double")
        .groupBy("query", "class_id").agg(F.max("score").alias("near"))
    )
    best = W.partitionBy("query").orderBy(F.desc("near"), "class_id")
    merged = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 2 * k + 2)
    left = classes.select(F.col("class_id").alias("query"), F.col("embedding").alias("a"))
    right = classes.select("class_id", "ids", F.col("embedding").alias("b"))
    exact = merged.join(left, "query").join(right, "class_id").select("query", "ids", _cosine(F.col("a"), F.col("b")).alias("score"))
    nearest_ids = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        exact.select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("place", F.row_number().over(nearest_ids)).where(F.col("place") <= k + 1)
        .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    )
    own = asked.join(lists, asked["class_id"] == lists["query"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        own.select("query_id", F.posexplode(others).alias("at", "n"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "n.vec_id", "n.score")
    )
