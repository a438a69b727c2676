"""Near-duplicates by SimHash, found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Every 23-bit word (a segment
with zeros before it) lies within distance 4 of one or six words of the binary Golay code, and two
words that differ in at most two bits share at least one of them. Of at most two differing bits, no
more than two segments can hold one, so some segment ``i`` is equal and segment ``i + 1`` differs in
two bits at most: joining on (segment ``i``, a nearby codeword of segment ``i + 1``) loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricetrail.llm.arrays import lowered, once, steps, words_of, xxh64
from pricetrail.llm.frames import text_batches
from pricetrail.llm.components import connected_components
from pricetrail.session import cut

SHINGLE = 3
SEED = 42
BITS = 2
#: Rows of shingle bits summed at once.
_CHUNK = 200_000
#: Segments as (first bit, bits).
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Members of one bucket compared with each other in numpy; larger buckets go by masks.
PAIRWISE = 512
#: Members above which a bucket's masks are dealt out to many tasks.
HOT_BUCKET = 100_000


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of texts given as bytes and offsets; a text without words has zero."""
    words = words_of(lowered(data), offsets)
    n = np.diff(words.first)
    out = np.zeros(len(n), dtype=np.uint64)
    if not words.count:
        return out
    text, begin = words.joined()
    end = begin + words.lens
    per_text = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    first = np.concatenate(([0], np.cumsum(per_text)))
    owner = np.repeat(np.arange(len(n)), per_text)
    head = words.first[:-1][owner] + np.arange(first[-1]) - first[:-1][owner]
    last = np.minimum(head + shingle, words.first[1:][owner]) - 1
    hashes = xxh64(text, begin[head], end[last] - begin[head], SEED)
    return majority(hashes, owner, per_text)


def majority(hashes: np.ndarray, owner: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Of each text's hashes the bits that are set in over half; ``owner`` ascends, a text without any has zero."""
    ones = np.zeros((len(per_text), 64), dtype=np.int64)
    for a in range(0, len(hashes), _CHUNK):
        part = hashes[a : a + _CHUNK]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[a : a + _CHUNK]
        cuts = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        ones[mine[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    over = (2 * ones > per_text[:, None]).astype(np.uint8)
    packed = np.packbits(over, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(-1).astype(np.uint64)


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches, "text"):
            fp = fingerprints_of(data, offsets, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])

    return text_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, fp long")


def golay_patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: up to six error patterns of weight at most four, and how many there are."""
    generator = 0b110001110101  # fixed value: a generator polynomial of the binary Golay code
    tail = np.zeros(23, dtype=np.int64)  # remainder of x^i
    for i in range(23):
        value = 1 << i
        for bit in range(22, 10, -1):
            if value >> bit & 1:
                value ^= generator << (bit - 11)
        tail[i] = value
    patterns = np.zeros((2048, 6), dtype=np.int64)
    count = np.zeros(2048, dtype=np.int64)
    from itertools import combinations

    for weight in range(5):
        for places in combinations(range(23), weight):
            syndrome = 0
            for p in places:
                syndrome ^= int(tail[p])
            patterns[syndrome, count[syndrome]] = sum(1 << p for p in places)
            count[syndrome] += 1
    return patterns, count


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper twelve bits and of the lower eleven, to be combined by xor."""
    generator = 0b110001110101
    upper = np.zeros(4096, dtype=np.int64)
    for message in range(4096):
        value = message << 11
        for bit in range(22, 10, -1):
            if value >> bit & 1:
                value ^= generator << (bit - 11)
        upper[message] = value
    return upper, np.arange(2048)


def codewords(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (twelve bits) of the codewords near each 23-bit word: a matrix and the number in each row."""
    patterns, count = once("golay patterns", golay_patterns)
    upper, lower = once("golay syndromes", _syndromes)
    syndrome = upper[segments >> 11] ^ lower[segments & 2047]
    return (segments[:, None] ^ patterns[syndrome]) >> 11, count[syndrome]


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of each fingerprint and the row each key belongs to."""
    parts = [((fp >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    keys, rows = [], []
    for i in range(3):
        near, count = codewords(parts[(i + 1) % 3])
        key = (np.int64(i) << 40) | (parts[i][:, None] << 12) | near
        valid = np.arange(near.shape[1]) < count[:, None]
        keys.append(key[valid])
        rows.append(np.nonzero(valid)[0])
    return np.concatenate(keys), np.concatenate(rows)


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member linked with each of ``n`` members, over all pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, high, low)
            while True:
                shorter = root[root]
                if (shorter == root).all():
                    break
                root = shorter
            keep = root[a] != root[b]
            a, b = a[keep], b[keep]
    return root


def _near_pairs(fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a in range(0, len(fp), 64):
        close = np.bitwise_count(fp[a : a + 64, None] ^ fp[None, :]) <= bits
        x, y = np.nonzero(close)
        yield x + a, y


def masks_of(bits: int, width: int = 64) -> np.ndarray:
    """All masks that leave out ``bits`` of the ``width`` bits."""
    if bits == 0:
        return np.array([2**64 - 1], dtype=np.uint64)
    one = ~(np.uint64(1) << np.arange(width, dtype=np.uint64))
    out = one
    for _ in range(bits - 1):
        out = np.unique((out[:, None] & one[None, :]).reshape(-1))
    return out


def _masked_pairs(fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members that agree outside a mask, each with the next one: linear in the members."""
    free = np.bitwise_or.reduce(fp) & ~np.bitwise_and.reduce(fp)
    masks = np.unique(masks_of(bits) | ~free)
    for mask in masks:
        order = np.argsort(fp & mask, kind="stable")
        value = (fp & mask)[order]
        same = np.flatnonzero(value[1:] == value[:-1])
        yield order[same], order[same + 1]


def links_in(fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what at most ``bits`` differing bits connect: fewer than there are members."""
    pairs = _near_pairs(fp, bits) if len(fp) <= PAIRWISE else _masked_pairs(fp, bits)
    root = _roots(len(fp), pairs)
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return fp[linked], fp[root[linked]]


def _bucket_links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a bucket may span batches."""

        def out(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            size = np.diff(cuts)
            a, b = [], []
            two = cuts[:-1][size == 2]
            close = np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits if len(two) else np.zeros(0, dtype=bool)
            a.append(fps[two[close]])
            b.append(fps[two[close] + 1])
            for start, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist()):
                x, y = links_in(fps[start : start + n], bits)
                a.append(x)
                b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        keys, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last:
                yield from out(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield from out(keys, fps)

    return run


def fingerprint_links(fps: DataFrame, bits: int = BITS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that connect all within ``bits`` (0 to 2).

    Not every pair is returned, but whatever a chain of pairs connects is connected. Buckets above
    ``hot_bucket`` members are dealt out by masks: members that agree outside a mask are linked to
    the smallest of them, each mask a group of its own that is combined before it is shuffled.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the bucket keys find at most two differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                fp = batch.column(0).slice(at, 50_000).to_numpy().view(np.uint64)
                keys, rows = bucket_keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows].view(np.int64))], ["key", "fp"])

    keys = fps.select("fp").mapInArrow(keyed, "key long, fp long")
    hot = cut(keys.groupBy("key").count().where(F.col("count") > hot_bucket).select("key"))
    some = not hot.isEmpty()
    plain = keys.join(hot, "key", "left_anti") if some else keys
    links = plain.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(bits), "a long, b long")
    if some:
        masks = F.array(*[F.lit(int(m)) for m in masks_of(bits).view(np.int64)])
        masked = (
            keys.join(hot, "key", "left_semi")
            .withColumn("mask", F.explode(masks))
            .select("key", "mask", "fp", (F.col("fp").bitwiseAND(F.col("mask"))).alias("rest"))
        )
        low = masked.groupBy("key", "mask", "rest").agg(F.min("fp").alias("b"), F.max("fp").alias("top"))
        star = masked.join(low.where("b <> top").drop("top"), ["key", "mask", "rest"]).where("fp <> b")
        links = links.union(star.select(F.col("fp").alias("a"), "b"))
    return links.distinct()


def near_duplicate_groups(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest doc_id that links reach, itself included. Documents with one
    fingerprint are one node, whatever their number. Null and blank texts have fingerprint zero and
    are linked like any other; repeated rows stay repeated; a null doc_id belongs to its group but
    names it only if the group has no other; an empty table gives no rows; other columns are not read. A
    text of any length is read whole, by one task.
    """
    prints = cut(with_fingerprints(docs, shingle))
    fps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    links = cut(fingerprint_links(fps, bits, hot_bucket))
    nodes = connected_components(links)
    named = (
        fps.join(nodes.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("component", F.coalesce("component", "fp"))
    )
    ids = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_print = cut(named.join(ids, "component").select("fp", "component_id"))
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp):
    """Sixteen lower-case digits of a long's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
