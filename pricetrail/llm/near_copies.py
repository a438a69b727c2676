"""Near copies: documents linked by the exact similarity of their sets of five-word shingles.

SimHash's Golay keys and MinHash bands propose pairs, exact sets decide, so no pair below the limit is
linked. Texts with one set of shingles are one node. Nodes that agree in all values of a band share a
bucket; in a bucket all pairs are compared by short signatures, and a small bucket hands on every pair
that may be similar enough, a larger one a forest of the most similar pairs. Buckets above ``PAIRWISE``
members are dealt out anew for each band. Then, round by round until no new link appears, the members of
larger buckets are compared with the bucket's best-linked ones, unless links connect them already. What
neither forest nor hub proposed comes last: every pair of a bucket's members that no links connect.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from pricetrail.llm.arrays import lowered, steps, words_of, xxh64
from pricetrail.llm.components import connected_components
from pricetrail.llm.frames import small_or_not, text_batches
from pricetrail.llm.simhash import fingerprint_links, majority
from pricetrail.session import cut

SHINGLE = 5
#: Two documents are near copies from this share of common shingles on, as a fraction.
SIMILAR = (4, 5)
SEED = 42
#: A pair at the limit shares a bucket with a probability of 1 - (1 - 0.8 ** 4) ** 25 > 0.999998.
BANDS, ROWS = 25, 4
#: Values that may differ between the signatures of a pair at the limit: four deviations more than expected.
DIFFERENT = 36
#: Members of a bucket up to which every pair is handed on, and those compared with each other.
ALL_PAIRS = 16
PAIRWISE = 512
#: The side of members that are compared with all of their own part.
ONE_PART = 2
#: Best-linked members of a bucket that all others are compared with in one round.
HUBS = 1

_RANDOM = np.random.default_rng(11)
_FACTORS = _RANDOM.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(11400714819323198485)


def shingles_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    words = words_of(lowered(data), offsets)
    n = np.diff(words.first)
    if not words.count:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(n) + 1, dtype=np.int64)
    text, begin = words.joined()
    end = begin + words.lens
    per_text = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    first = np.concatenate(([0], np.cumsum(per_text)))
    owner = np.repeat(np.arange(len(n)), per_text)
    head = words.first[:-1][owner] + np.arange(first[-1]) - first[:-1][owner]
    last = np.minimum(head + shingle, words.first[1:][owner]) - 1
    hashes = xxh64(text, begin[head], end[last] - begin[head], SEED)
    order = np.lexsort((hashes, owner))
    hashes = hashes[order]
    fresh = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
    return hashes[fresh], np.searchsorted(owner[fresh], np.arange(len(n) + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def nodes_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for each set; the empty set has zero."""
    at = np.concatenate(([np.uint64(0)], np.cumsum(_mixed(hashes), dtype=np.uint64)))
    total = at[first[1:]] - at[first[:-1]]
    return np.where(np.diff(first) > 0, _mixed(total + np.diff(first).astype(np.uint64)), np.uint64(0)).view(np.int64)


def signatures_of(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of each set and a signature of one byte for each value; the empty set has zeros."""
    n, some = len(first) - 1, np.flatnonzero(np.diff(first) > 0)
    keys, bytes_ = np.zeros((n, BANDS), dtype=np.uint64), np.zeros((n, BANDS * ROWS), dtype=np.uint8)
    if not len(some):
        return keys.view(np.int64), bytes_
    for band in range(BANDS):
        key = np.full(len(some), band + 1, dtype=np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            x = hashes ^ _SHIFTS[i]
            x *= _FACTORS[i]
            x ^= x >> np.uint64(31)
            x *= _MIX
            low = np.minimum.reduceat(x, first[some])
            bytes_[some, i] = (_mixed(low) >> np.uint64(56)).astype(np.uint8)
            key = _mixed(key ^ low)
        keys[some, band] = key
    return keys.view(np.int64), bytes_


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``, the MD5 of the text: with the id it says which rows are the same."""
    return docs.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def _prints(docs: DataFrame) -> DataFrame:
    """``doc_id, key, node, n, fp, keys, signature`` of every row: its set, the set's size, SimHash, band keys and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches, "text"):
            hashes, first = shingles_of(data, offsets)
            keys, signature = signatures_of(hashes, first)
            size = np.diff(first)
            fp = majority(hashes, np.repeat(np.arange(part.num_rows), size), size)
            at = pa.array(np.arange(part.num_rows + 1) * BANDS, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(nodes_of(hashes, first)), pa.array(size, pa.int64()), pa.array(fp.view(np.int64)),
                 pa.ListArray.from_arrays(at, pa.array(keys.reshape(-1))), pa.array([s.tobytes() for s in signature], pa.binary())],
                ["doc_id", "key", "node", "n", "fp", "keys", "signature"],
            )

    frame = text_batches(_named(docs.select("doc_id", "text")).select("doc_id", "key", "text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(run, f"doc_id {kind}, key binary, node long, n long, fp long, keys array<long>, signature binary")


def _sets(docs: DataFrame, prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` of ``nodes``: one text of each is read for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches, "text"):
            hashes, first = shingles_of(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes_of(hashes, first)), lists], ["node", "shingles"])

    keys = cut(prints.select("node", "key").join(small_or_not(nodes, 64), "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")).select("key").distinct())
    texts = _named(docs.select("text")).join(small_or_not(keys, 64), "key", "left_semi").select("text")
    return text_batches(texts).mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def candidates_in(n: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket's members that may be similar enough: all, or a forest of the most similar ones."""
    num, den = SIMILAR
    pairs, far = [], []
    for a in range(len(n) - 1):
        other = np.arange(a + 1, len(n))
        near = other[den * np.minimum(n[a], n[other]) >= num * np.maximum(n[a], n[other])]
        unlike = (signature[near] != signature[a]).sum(axis=1)
        near, unlike = near[unlike <= DIFFERENT], unlike[unlike <= DIFFERENT]
        pairs.append(np.stack((np.full(len(near), a), near)))
        far.append(unlike)
    if not pairs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    (x, y), far = np.concatenate(pairs, axis=1), np.concatenate(far)
    if len(n) <= ALL_PAIRS:
        return x, y
    root, taken = list(range(len(n))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in np.argsort(far, kind="stable").tolist():
        a, b = top(int(x[at])), top(int(y[at]))
        if a != b:
            root[max(a, b)] = min(a, b)
            taken.append(at)
            if len(taken) == len(n) - 1:
                break
    return x[taken], y[taken]


def rest_in(side: np.ndarray, n: np.ndarray, component: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of different components that may be similar enough; members of one side meet only if it is ``ONE_PART``."""
    num, den = SIMILAR
    x, y = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for a in range(len(n) - 1 if (component != component[0]).any() else 0):
        other = slice(a + 1, len(n))
        meets = (component[other] != component[a]) & ((side[other] != side[a]) | (side[a] == ONE_PART))
        near = a + 1 + np.flatnonzero(meets & (den * np.minimum(n[a], n[other]) >= num * np.maximum(n[a], n[other])))
        near = near[(signature[near] != signature[a]).sum(axis=1) <= DIFFERENT]
        x.append(np.full(len(near), a))
        y.append(near)
    return np.concatenate(x), np.concatenate(y)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows that come sorted by the first, the last a signature; a group may span batches."""
    held: tuple[np.ndarray, ...] = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.num_columns - 1
        flat = np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)
        new = (*(batch.column(i).to_numpy() for i in range(k)), flat)
        held = tuple(np.concatenate(x) for x in zip(held, new)) if held else new
        last = int(np.searchsorted(held[0], held[0][-1]))
        if last:
            yield tuple(x[:last] for x in held)
            held = tuple(x[last:] for x in held)
    if held:
        yield held


def _bounds(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))).tolist()
    return list(zip(cuts[:-1], cuts[1:]))


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, node, n, signature`` come sorted by key."""
    for keys, nodes, n, signature in _whole_groups(batches):
        a, b = [], []
        for start, end in _bounds(keys):
            for at in range(start, end, 2 * PAIRWISE) if end - start > 1 else ():  # dealt out, a bucket can be a little larger
                mine = slice(at, min(at + 2 * PAIRWISE, end))
                x, y = candidates_in(n[mine], signature[mine])
                a.append(nodes[mine][x])
                b.append(nodes[mine][y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _rest_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, side, node, n, component, signature`` come sorted by key."""
    for keys, side, nodes, n, component, signature in _whole_groups(batches):
        for start, end in _bounds(keys):
            mine = slice(start, end)
            x, y = rest_in(side[mine], n[mine], component[mine], signature[mine])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[mine][x]), pa.array(nodes[mine][y])], ["a", "b"])


def _hub_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``a, n, s, b, m, t``: those whose sizes and signatures allow the limit, as ``a, b``."""
    num, den = SIMILAR
    for batch in batches:
        if not batch.num_rows:
            continue
        a, n, _, b, m, _ = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        s, t = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS) for i in (2, 5))
        near = (den * np.minimum(n, m) >= num * np.maximum(n, m)) & ((s != t).sum(axis=1) <= DIFFERENT)
        yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], ["a", "b"])


def _verified(docs: DataFrame, prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` of nodes whose sets are similar enough, written."""
    involved = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    sets = cut(_sets(docs, prints, involved))
    one, two = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    num, den = SIMILAR
    common = F.size(F.array_intersect("sa", "sb"))
    enough = (num + den) * common >= num * (F.size("sa") + F.size("sb"))
    return cut(pairs.join(one, "a").join(two, "b").where(enough).select("a", "b"))


def _by_golay(nodes: DataFrame) -> DataFrame:
    """``a, b``: nodes with one SimHash, and those that its Golay keys link, through the smallest node of each."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("low")))
    same = nodes.select("fp", "node").join(prints, "fp").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    one, two = (prints.select(F.col("fp").alias(x), F.col("low").alias(f"l{x}")) for x in "ab")
    near = fingerprint_links(prints.select("fp")).join(one, "a").join(two, "b")
    return same.union(near.select(F.col("la").alias("a"), F.col("lb").alias("b")))


def linked_nodes(docs: DataFrame, prints: DataFrame, pairwise: int = PAIRWISE, hubs: int = HUBS) -> DataFrame:
    """``node, component`` of nodes that verified links connect."""
    nodes = cut(prints.where("n > 0").dropDuplicates(["node"]).select("node", "n", "fp", "keys", "signature"))
    exploded = nodes.select(F.explode("keys").alias("key"), "node")
    sizes = cut(exploded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    crowded = cut(sizes.where(F.col("m") > min(ALL_PAIRS, pairwise)))
    # Nodes alone in their bucket have nobody to meet, so only the others' signatures are sent.
    met = cut(exploded.join(sizes, "key"))
    # A node's keys, at most one for each band, meet its signature as one row.
    of_node = met.groupBy("node").agg(F.collect_list(F.struct("key", "m")).alias("met"))
    keyed = of_node.join(nodes.select("node", "n", "signature"), "node").select(F.inline("met"), "node", "n", "signature")
    # Members of a large bucket meet others in each band.
    parts = F.ceil(F.col("m") / (pairwise // 2))
    dealt = keyed.withColumn(
        "key", F.when(F.col("m") <= pairwise, F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("key", "node"), parts)))
    )
    near = dealt.select("key", "node", "n", "signature").repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_pairs, "a long, b long")
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = cut(ordered(near.union(_by_golay(nodes))))
    links = _verified(docs, prints, tried)
    found = connected_components(links)
    if crowded.isEmpty():
        return found
    labels = cut(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    members = keyed.where(F.col("m") > min(ALL_PAIRS, pairwise)).drop("m")
    degree = cut(links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("degree")))
    for turn in itertools.count():
        # Buckets whose members are all connected are done.
        live = members.join(labels, "node")
        apart = live.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        members = cut(live.join(small_or_not(cut(apart), 64), "key", "left_semi"))
        place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("degree"), "node"))
        ranked = members.join(degree, "node").withColumn("k", place).where(F.col("k") <= (turn + 1) * hubs).where(F.col("k") > turn * hubs)
        hub = cut(ranked.select("key", *(F.col(c).alias(d) for c, d in (("node", "b"), ("n", "m"), ("signature", "t"), ("component", "cb")))))
        if hub.isEmpty():
            break
        near = (
            members.join(small_or_not(hub, 200), "key").where("component <> cb")
            .select(F.col("node").alias("a"), "n", F.col("signature").alias("s"), "b", "m", "t").dropDuplicates(["a", "b"])
        )
        met = cut(ordered(near.mapInArrow(_hub_pairs, "a long, b long")))
        more, tried = _verified(docs, prints, met), tried.union(met)
        if more.isEmpty():
            break
        labels, members = cut(_joined(labels, more)), members.drop("component")
    rest = ordered(_parts_met(members, pairwise).mapInArrow(_rest_pairs, "a long, b long"))
    rest = cut(rest.join(tried, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return labels
    more = _verified(docs, prints, rest)
    return labels if more.isEmpty() else cut(_joined(labels, more))


def _parts_met(members: DataFrame, pairwise: int) -> DataFrame:
    """``members`` in parts of about ``pairwise``, once for each part that theirs meets: ``key`` names two parts of a bucket or one."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / pairwise).alias("parts"))
    own = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("parts"))
    placed = members.join(sizes, "key").withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("met"), ONE_PART).otherwise((F.col("own") > F.col("met")).cast("int")).cast("long")
    key = F.xxhash64("key", F.least("own", "met"), F.greatest("own", "met"))
    return placed.select(key.alias("key"), side.alias("side"), "node", "n", "component", "signature").repartition("key").sortWithinPartitions("key")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after components that ``links`` connect became one."""
    one, two = (labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    between = links.join(one, "a").join(two, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
    wider = connected_components(cut(between)).select(F.col("node").alias("component"), F.col("component").alias("wider"))
    return labels.join(wider, "component", "left").select("node", F.coalesce("wider", "component").alias("component"))


def _grouped(docs: DataFrame, pairwise: int, hubs: int) -> tuple[DataFrame, DataFrame]:
    """The prints of ``docs`` and ``node, component_id, key``: the id and text that come first in each node's group."""
    prints = cut(_prints(docs))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"))
    lows = cut(prints.groupBy("node").agg(F.min(first).alias("low")))
    named = lows.join(linked_nodes(docs, prints, pairwise, hubs), "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("low").alias("first"))
    return prints, cut(named.join(ids, "component").select("node", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("key")))


def near_copy_groups(docs: DataFrame, pairwise: int = PAIRWISE, hubs: int = HUBS) -> DataFrame:
    """``doc_id, component_id`` of every row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest doc_id that links reach, itself included. Null and blank texts have
    no shingles and are one group; a text of fewer than five words is one shingle; repeated rows stay
    repeated; a null doc_id belongs to its group but names it only if the group has no other; an empty
    table gives no rows. A text of any length is read whole; its set is one value of one row.
    """
    prints, groups = _grouped(docs, pairwise, hubs)
    return prints.select("doc_id", "node").join(groups, "node").select("doc_id", "component_id")


def first_of_each_group(docs: DataFrame, pairwise: int = PAIRWISE, hubs: int = HUBS) -> DataFrame:
    """The rows of ``docs``, all their columns, that are the first of their group: one for each group.

    The first has the group's smallest doc_id (null is the largest), then the smallest MD5 of its text;
    of rows with one id and text any one stays. Other texts with the same id are groups of their own.
    """
    prints, groups = _grouped(docs, pairwise, hubs)
    d = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias("d")
    rows = prints.groupBy(d("doc_id"), "key").agg(F.count("*").alias("m"))
    stay = cut(groups.select(d("component_id"), "key").distinct().join(rows, ["d", "key"]))
    named = _named(docs.select(F.struct("*").alias("row"), d("doc_id"), "text")).drop("text")
    # Only rows that share id and text with others are brought together.
    once = named.join(small_or_not(stay.where("m = 1").drop("m"), 128), ["d", "key"], "left_semi").select("row.*")
    several = stay.where("m > 1").drop("m")
    if several.isEmpty():
        return once
    return once.unionByName(named.join(small_or_not(several, 128), ["d", "key"], "left_semi").dropDuplicates(["d", "key"]).select("row.*"))
