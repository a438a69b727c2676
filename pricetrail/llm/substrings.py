"""Substring dedup: words of long passages that an earlier document has too are removed.

A window of 50 words holds a whole block of 25 words wherever blocks begin at multiples of 25. So every
document's fixed blocks are an index, and all rolling 25-word windows probe it. Index and probes are one
shuffle of hashes: a chunk of documents sends each of its hashes once, packed by hash bucket, and a bucket
tells its chunks which of their hashes some block has and another place repeats. Such anchors are extended
both ways to maximal exact repeats: the 50-word windows around them are compared by 80 and more bits, and
the smallest document of each wins. What it confirms is merged to spans of words. No pairs of documents
are formed, and a passage costs each chunk of documents one entry for each of its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pricetrail.llm.arrays import Words, flat, ragged, runs, steps, words_of, xxh64
from pricetrail.llm.frames import BROADCAST_BYTES, text_batches
from pricetrail.session import cut

WINDOW = 50
#: Bytes of text of one chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 2_500_000
#: Characters of text for each bucket: a bucket's hashes are held by one task.
BUCKET_CHARS = 10_000_000
#: Stands for a null doc_id, which no document is smaller than.
_LAST = 2**63 - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HASH_BITS = 38
_ROW = "bucket int, kind int, chunk long, a binary, b binary, c binary, d binary, e binary, f binary, g binary"
_SPANS = "doc long, key binary, spans array<int>"


def _packed(values: np.ndarray) -> bytes:
    """Non-negative numbers as planes of bytes, as many as the largest needs."""
    wide = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(wide.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + wide.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1).astype(np.int64)


def _steps_of(sorted_values: np.ndarray) -> bytes:
    return _packed(np.diff(sorted_values, prepend=0))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def grams(values: np.ndarray, size: int) -> np.ndarray:
    """A rolling hash of each ``size`` consecutive values: a polynomial modulo 2**64, then mixed."""
    n = len(values)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum(values * _powers(n, _BASE), dtype=np.uint64)))
        back = _powers(n - size + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        return _mixed((total[size:] - total[:-size]) * back)


@dataclass
class Chunk:
    """Some documents' words; ``mine`` marks those long enough and not repeated within the chunk."""

    number: int
    doc: np.ndarray
    key: pa.Array
    words: Words
    mine: np.ndarray
    owner: np.ndarray

    def hashes(self, seed: int) -> np.ndarray:
        """A hash of each word."""
        codes, distinct = self.words.encoded()
        data, offs = flat(distinct)
        return xxh64(data, offs[:-1], np.diff(offs), seed)[codes]

    def places(self, size: int) -> np.ndarray:
        """Words of marked documents at which ``size`` of the document's words begin."""
        last = self.words.first[1:][self.owner] - size
        return np.flatnonzero((np.arange(self.words.count) <= last) & self.mine[self.owner])

    def dictionary(self, window: int) -> tuple[bytes, bytes, bytes, bytes]:
        """First words, ids, keys and numbers of words of the marked documents."""
        at = np.flatnonzero(self.mine)
        first = self.words.first
        keys = b"".join(self.key.take(pa.array(at)).to_pylist())
        return _steps_of(first[at]), self.doc[at].astype("<i8").tobytes(), keys, _packed(np.diff(first)[at])


def _chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[Chunk, pa.RecordBatch]]:
    """Rows ``doc, key, text`` in chunks; a chunk's number is that of its task and its place in it."""
    task = TaskContext.get()
    base = (task.partitionId() if task else 0) << 32
    for i, (part, data, offsets) in enumerate(steps(batches, "text", CHUNK_BYTES)):
        words = words_of(data, offsets)
        doc, key = part.column(0).to_numpy(), part.column(1)
        code = key.dictionary_encode().indices.to_numpy()
        order = np.lexsort((code, doc))
        fresh = np.ones(len(doc), dtype=bool)
        fresh[order[1:]] = (doc[order[1:]] != doc[order[:-1]]) | (code[order[1:]] != code[order[:-1]])
        yield Chunk(base + i, doc, key, words, fresh & (np.diff(words.first) >= window), words.owner()), part


def _groups(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by the keys, the last one first, and where each group begins in it."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    if not len(order):
        return order, order
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    return order, np.flatnonzero(new)


def _sent(chunk: Chunk, window: int, buckets: int, bucket: np.ndarray, place: np.ndarray, blobs, known: np.ndarray, lead: np.ndarray, follow: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket with entries at ``place``, and one for the chunk itself.

    ``known`` are places already confirmed, ``follow`` share the answer of their ``lead``.
    ``blobs`` gives the columns of chosen entries.
    """
    order = np.lexsort((place, bucket))
    begin = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1]))) if len(order) else order
    rows = []
    for part in np.split(order, begin[1:]) if len(order) else []:
        rows.append((int(bucket[part[0]]), 0, chunk.number, *blobs(part), None, None, None))
    by_lead = np.argsort(lead, kind="stable")
    first, ids, keys, lens = chunk.dictionary(window)
    rows.append((chunk.number % buckets, 1, chunk.number, first, ids, keys, lens, _steps_of(np.sort(known)), _steps_of(lead[by_lead]), _packed(follow[by_lead])))
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _ROW.split(", ")])


def _anchors(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows for the buckets: each rolling hash of a chunk once, with whether a block of the chunk has it and whether it repeats."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in _chunks(batches, window):
            if not chunk.mine.any():
                continue
            place = chunk.places(block)
            value = grams(chunk.hashes(42), block)[place]
            fixed = (place - chunk.words.first[:-1][chunk.owner[place]]) % block == 0
            order, begin = _groups((value,))
            size = np.diff(np.append(begin, len(order)))
            is_block, many = np.logical_or.reduceat(fixed[order], begin), size > 1
            lead = place[order][begin]
            each = np.repeat(np.arange(len(begin)), size)
            local = is_block & many
            rest = np.ones(len(order), dtype=bool)
            rest[begin] = False
            rest &= ~local[each]
            entry = ((value[order][begin] & np.uint64((1 << _HASH_BITS) - 1)) << np.uint64(2)) | (is_block.astype(np.uint64) << np.uint64(1)) | many.astype(np.uint64)
            bucket = (value[order][begin] >> np.uint64(_HASH_BITS)).astype(np.int64) % buckets
            blobs = lambda part: (_packed(entry[part]), _steps_of(lead[part]), None, None)
            yield _sent(chunk, window, buckets, bucket, lead, blobs, place[order][local[each]], lead[each[rest]], place[order][rest])

    return text_batches(docs).mapInArrow(run, _ROW)


def _anchor_answers(entry: list[np.ndarray], place: list[np.ndarray], _: list) -> Iterator[np.ndarray]:
    """Of each chunk the places whose hash a block has and another place repeats."""
    row = np.repeat(np.arange(len(entry)), [len(e) for e in entry])
    flags = np.concatenate(entry)
    order, begin = _groups((flags >> 2,))
    size = np.diff(np.append(begin, len(order)))
    is_block = np.logical_or.reduceat((flags & 2 > 0)[order], begin)
    many = np.logical_or.reduceat((flags & 1 > 0)[order], begin) | (size > 1)
    hit = np.empty(len(order), dtype=bool)
    hit[order] = np.repeat(is_block & many, size)
    hit &= flags & 3 != 3  # these know already
    bounds = np.searchsorted(row, np.arange(len(entry) + 1))
    for i, at in enumerate(place):
        yield at[hit[bounds[i] : bounds[i + 1]]]


def _windows(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows for the buckets: the windows at the candidate places, each once for a chunk and its smallest document.

    ``docs`` has ``doc, key, text, spans``: ranges of places within the document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in _chunks(batches, window):
            spans = part.column(3)
            ends = spans.offsets.to_numpy().astype(np.int64)
            ranges = spans.flatten().to_numpy().astype(np.int64).reshape(-1, 2)
            owner = np.repeat(np.arange(part.num_rows), np.diff(ends) // 2)
            keep = chunk.mine[owner]
            ranges, owner = ranges[keep], owner[keep]
            place = ragged(chunk.words.first[:-1][owner] + ranges[:, 0], ranges[:, 1] - ranges[:, 0])
            if not len(place):
                continue
            one, two = (grams(chunk.hashes(seed), window)[place] for seed in (42, 43))
            doc = chunk.doc[chunk.owner[place]]
            # Within a hash the smallest document comes first, within it the first place.
            order, begin = _groups((place, doc, two, one))
            value = np.stack((one[order], two[order]))
            new = np.concatenate(([True], (value[:, 1:] != value[:, :-1]).any(axis=0)))
            group = np.cumsum(new) - 1
            least = doc[order][new][group]
            smallest = doc[order] == least
            head = np.flatnonzero(new)
            lead = place[order][head]
            rest = smallest & ~new
            entry_one, entry_two, ids = one[order][head], two[order][head], doc[order][head]
            bucket = (entry_two >> np.uint64(16)).astype(np.uint64) % np.uint64(buckets)

            def blobs(some: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
                low = int(ids[some].min())
                head_bytes = low.to_bytes(8, "little", signed=True)
                return (
                    entry_one[some].astype("<u8").tobytes(), _steps_of(lead[some]),
                    (entry_two[some] & np.uint64(0xFFFF)).astype("<u2").tobytes(),
                    head_bytes + _packed(ids[some].astype(np.uint64) - np.uint64(low % (1 << 64))),
                )

            yield _sent(chunk, window, buckets, bucket.astype(np.int64), lead, blobs, place[order][~smallest], lead[group[rest]], place[order][rest])

    return text_batches(docs).mapInArrow(run, _ROW)


def _window_answers(one: list[np.ndarray], place: list[np.ndarray], more: list[tuple[bytes, bytes]]) -> Iterator[np.ndarray]:
    """Of each chunk the places whose window a smaller document has."""
    row = np.repeat(np.arange(len(one)), [len(e) for e in one])
    two = np.concatenate([np.frombuffer(c, dtype="<u2") for c, _ in more])
    with np.errstate(over="ignore"):
        doc = np.concatenate([(_unpacked(d[8:]).astype(np.uint64) + np.frombuffer(d[:8], dtype="<u8")).view(np.int64) for _, d in more])
    order, begin = _groups((doc, two, np.concatenate(one)))
    value = np.stack((np.concatenate(one)[order], two[order].astype(np.uint64)))
    new = np.concatenate(([True], (value[:, 1:] != value[:, :-1]).any(axis=0)))
    hit = np.empty(len(order), dtype=bool)
    hit[order] = doc[order] > doc[order][new][np.cumsum(new) - 1]
    bounds = np.searchsorted(row, np.arange(len(one) + 1))
    for i, at in enumerate(place):
        yield at[hit[bounds[i] : bounds[i + 1]]]


def _answered(rows: DataFrame, anchors: bool) -> DataFrame:
    """``chunk, kind`` rows: 1 as they came, 2 the places that a bucket confirms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _ROW.split(", ")]
        for batch in runs(batches, lambda b: b.column(0).to_numpy()):
            kind = batch.column(1).to_numpy()
            yield batch.filter(pa.array(kind == 1))
            for bucket in np.unique(batch.column(0).to_numpy()):
                mine = batch.filter(pa.array((kind == 0) & (batch.column(0).to_numpy() == bucket)))
                if not mine.num_rows:
                    continue
                a, b, c, d = (mine.column(3 + i).to_pylist() for i in range(4))
                places = [_from_steps(x) for x in b]
                if anchors:
                    found = _anchor_answers([_unpacked(x) for x in a], places, [])
                else:
                    found = _window_answers([np.frombuffer(x, dtype="<u8") for x in a], places, list(zip(c, d)))
                chunk = mine.column(2).to_pylist()
                out = [(0, 2, n, _steps_of(p), *[None] * 6) for n, p in zip(chunk, found) if len(p)]
                if out:
                    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 7]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

    return text_batches(rows.repartition("bucket").sortWithinPartitions("bucket", "kind")).mapInArrow(run, _ROW)


def _merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges sorted by document and ends, joined where they touch: document of each, and the ends in turn."""
    if not len(doc):
        return doc, np.zeros(0, dtype=np.int64)
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (low[1:] > high[:-1]))))
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], np.stack((low[new], high[last]), axis=1).reshape(-1)


def _spans(answers: DataFrame, before: int, after: int, window: int) -> DataFrame:
    """``doc, key, spans``: confirmed places from ``before`` words before to ``after`` words behind, joined.

    With ``after`` 1 the spans are places where windows may begin, so they end where the last window does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, lambda b: b.column(2).to_numpy()):
            number, kind = batch.column(2).to_numpy(), batch.column(1).to_numpy()
            columns = [batch.column(3 + i) for i in range(7)]
            for at in np.flatnonzero(kind == 1).tolist():
                a, b, c, d, e, f, g = (x[at].as_py() for x in columns)
                answered = [_from_steps(columns[0][int(i)].as_py()) for i in np.flatnonzero((number == number[at]) & (kind == 2))]
                hits = np.concatenate(answered) if answered else np.zeros(0, dtype=np.int64)
                lead, follow = _from_steps(f), _unpacked(g)
                place = np.sort(np.concatenate((_from_steps(e), hits, follow[np.isin(lead, hits)])))
                if not len(place):
                    continue
                first, ids, lens = _from_steps(a), np.frombuffer(b, dtype="<i8"), _unpacked(d)
                doc = np.searchsorted(first, place, side="right") - 1
                own = place - first[doc]
                low, high = np.maximum(own - before, 0), own + after
                if after == 1:
                    high = np.minimum(high, lens[doc] - window + 1)
                doc, ends = _merged(doc, low, high)
                some, begin = np.unique(doc, return_index=True)
                offsets = np.append(begin, len(doc)) * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array([c[16 * i : 16 * i + 16] for i in some.tolist()], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ends, pa.int32()))],
                    ["doc", "key", "spans"],
                )

    dealt = answers.repartition("chunk").sortWithinPartitions("chunk", "kind")
    # Chunks that hold the same row know the same of it.
    return cut(text_batches(dealt).mapInArrow(run, _SPANS).dropDuplicates(["doc", "key"]))


def _with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """``docs`` and their spans; the spans are sent to all tasks where their counted size is small."""
    size = spans.agg((F.count("*") * 64 + F.coalesce(F.sum(F.size("spans")), F.lit(0)) * 4).alias("n")).first()["n"]
    if size <= BROADCAST_BYTES:
        return docs.join(F.broadcast(spans), ["doc", "key"], how)
    # Sorted, so that a task that runs again makes the same chunks.
    return docs.join(spans, ["doc", "key"], how).sortWithinPartitions("doc", "key")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc, key, spans``: by document and MD5 of its text the ranges of words that earlier documents have too.

    ``docs`` has ``doc, key, text``. A range's words are covered by windows of ``window`` words that
    begin in a document with a smaller ``doc`` too.
    """
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = max(16, -(-chars // BUCKET_CHARS))
    block = window // 2
    anchored = _spans(cut(_answered(_anchors(docs, window, buckets), True)), block, 1, window)
    suspects = _with_spans(docs, anchored, "inner").select("doc", "key", "text", "spans")
    return _spans(cut(_answered(_windows(suspects, window, buckets), False)), 0, window, window)


def without_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs`` (``doc_id, text``).

    Words are runs of bytes other than white space, compared unchanged. A word goes if one of its
    windows of ``window`` words, an even number, also begins in a document with a smaller doc_id. A null doc_id is
    larger than all others (it counts as the largest long), documents with one id remove nothing from each other, and repeated
    rows stay repeated. Null, blank and shorter texts lose nothing; an empty table gives no rows; other
    columns are not read. Windows are equal if 80 bits of hashes and their bucket are. A text is read whole and is one value of
    one task; a very long one is a chunk of its own. ``keep_text`` adds ``kept``, the words that stay.
    """
    if window < 2 or window % 2:
        raise ValueError("a window has an even number of words")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.unhex(F.md5(text)).alias("key"), text.alias("text")
    )
    spans = repeated_spans(rows.select("doc", "key", "text"), window)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches, "text"):
            words = words_of(data, offsets)
            given = part.column(2)
            lens = np.diff(given.offsets.to_numpy().astype(np.int64)) if len(given) else np.zeros(0, dtype=np.int64)
            lens = np.where(given.is_null().to_numpy(zero_copy_only=False), 0, lens) // 2
            ranges = given.drop_null().flatten().to_numpy().astype(np.int64).reshape(-1, 2)
            owner = np.repeat(np.arange(part.num_rows), lens)
            stays = np.ones(words.count, dtype=bool)
            stays[ragged(words.first[:-1][owner] + ranges[:, 0], ranges[:, 1] - ranges[:, 0])] = False
            joined, _ = words.joined()
            out = joined[np.repeat(stays, words.lens + 1)]
            ends = np.concatenate(([0], np.cumsum((words.lens + 1) * stays)))[words.first]
            kept = [out[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            n = np.diff(words.first)
            left = np.concatenate(([0], np.cumsum(stays)))[words.first]
            columns = [part.column(0), pa.array(n), pa.array(n - np.diff(left)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    met = _with_spans(rows, spans, "left").select("doc_id", "text", "spans")
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    return text_batches(met).mapInArrow(run, schema)


#: The same in SQL: every window of every document as text.
ORACLE = """
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), p AS (
  SELECT r, doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i, words FROM w
), h AS (
  SELECT r, doc_id, i, word, CASE WHEN i + 49 <= len(words) THEN md5(array_to_string(words[i:i + 49], ' ')) END AS said FROM p
), least AS (
  SELECT said, min(doc_id) AS d FROM h WHERE said IS NOT NULL GROUP BY said
), hit AS (
  SELECT h.r, h.i, h.word, coalesce(l.d < h.doc_id OR (h.doc_id IS NULL AND l.d IS NOT NULL), false) AS repeated
  FROM h LEFT JOIN least l ON h.said = l.said
), gone AS (
  SELECT r, i, word, max(repeated) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS covered FROM hit
), kept AS (
  SELECT r, count(*) AS n, count(*) FILTER (covered) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT covered) AS text FROM gone GROUP BY r
)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.r = k.r
"""
