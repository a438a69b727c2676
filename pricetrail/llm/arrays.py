"""Text columns as flat byte arrays inside Arrow steps: words, spans and XXH64 over spans."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

T = TypeVar("T")

#: Bytes of text that one numpy step handles; a longer single text is a step of its own.
STEP_BYTES = 2_000_000

#: White space between words: space and the bytes 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with the bytes and the offsets of their texts; null reads as empty.

    Small batches are joined and large ones cut, so that a part holds about ``limit`` bytes.
    """
    held, size = [], 0
    for batch in _released(batches):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(column)))).as_py() or 0
        if size >= limit:
            yield from _parts(pa.concat_batches(held), column, limit)
            held, size = [], 0
    if held:
        yield from _parts(pa.concat_batches(held), column, limit)


def _parts(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    text = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        # Only the part in hand is copied.
        data, offsets = flat(pc.fill_null(text.slice(start, stop - start).cast(pa.large_binary()), b""))
        yield batch.slice(start, stop - start), data, offsets
        start = stop


def runs(batches: Iterator[pa.RecordBatch], of: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sorted batches again, cut only where ``of`` (a batch to an array of keys) changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = of(batch)
        change = np.flatnonzero(key[1:] != key[:-1])
        begins = bool(held) and key[0] != of(held[-1].slice(held[-1].num_rows - 1))[0]
        if begins:
            yield pa.concat_batches(held)
            held = []
        if len(change):
            last = int(change[-1]) + 1
            yield pa.concat_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def once(name: str, build: Callable[[], T]) -> T:
    """What ``build`` gives, kept for the life of the process and never sent with a function."""
    kept = vars(sys).setdefault("_pricetrail_once", {})
    if name not in kept:
        kept[name] = build()
    return kept[name]


def _trim():
    """The C library's call that gives freed memory back, where there is one."""

    def find():
        try:
            return ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):
            return lambda _: 0

    return once("malloc_trim", find)


def _released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what earlier ones took is given back, as a worker outlives its tasks."""
    for i, batch in enumerate(batches):
        if i % 8 == 7:
            _trim()(0)
        yield batch
    pa.default_memory_pool().release_unused()
    _trim()(0)


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary array and its offsets, both from zero."""
    _, offsets, data = text.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(text) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte as it is."""
    return _LOWER[data]


@dataclass
class Words:
    """Words of many texts: ``data`` holds them without the space between, ``offs`` their ends.

    Word ``i`` is ``data[offs[i]:offs[i + 1]]``; text ``d`` has words ``first[d]`` to ``first[d + 1]``.
    ``starts`` are the words' places in the bytes they were read from.
    """

    data: np.ndarray
    offs: np.ndarray
    first: np.ndarray
    starts: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offs) - 1

    @property
    def lens(self) -> np.ndarray:
        return np.diff(self.offs)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """A code for each word and the distinct words by code."""
        words = binary(self.data, self.offs).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Words with one space after each, and where each begins."""
        out = np.full(len(self.data) + self.count, 32, dtype=np.uint8)
        out[np.arange(len(self.data)) + np.repeat(np.arange(self.count), self.lens)] = self.data
        return out, self.offs[:-1] + np.arange(self.count)


def binary(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(), len(offs) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offs, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of bytes other than white space; a text's end ends a word."""
    if not len(data):
        return Words(data, np.zeros(1, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=np.int64))
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] |= solid[cuts]
    starts = np.flatnonzero(begins)
    kept = np.concatenate(([0], np.cumsum(solid)))
    offs = np.append(kept[starts], kept[-1])
    return Words(data[solid], offs, np.searchsorted(starts, offsets), starts)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places ``starts[i], starts[i] + 1, ...`` of every span one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = starts - np.concatenate(([0], np.cumsum(lens)[:-1]))
    return np.arange(total) + np.repeat(shift, lens)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``, zero for an empty part."""
    if values.dtype == bool or values.dtype.kind in "iu":
        values = values.astype(np.int64)
    total = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


#: The five primes of the published XXH64 definition.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (
        11400714785074694791, 14029467366897019727, 1609587929392839161,
        9650029242287828579, 2870177450012600261,
    )
)


def _left(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _lane(x: np.ndarray) -> np.ndarray:
    return _left(x * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every span ``data[starts[i]:starts[i] + lens[i]]``."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    wide = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    half = np.ndarray((len(data) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    seed64 = np.uint64(seed)
    with np.errstate(over="ignore"):
        out = np.full(len(starts), seed64 + _P5, dtype=np.uint64)
        at = starts.astype(np.int64).copy()
        left = lens.astype(np.int64).copy()
        long = np.flatnonzero(left >= 32)
        if len(long):
            acc = [np.full(len(long), v, dtype=np.uint64) for v in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
            live = np.arange(len(long))
            while len(live):
                rows = long[live]
                for k in range(4):
                    acc[k][live] = _left(acc[k][live] + wide[at[rows] + 8 * k] * _P2, 31) * _P1
                at[rows] += 32
                left[rows] -= 32
                live = live[left[rows] >= 32]
            h = _left(acc[0], 1) + _left(acc[1], 7) + _left(acc[2], 12) + _left(acc[3], 18)
            for k in range(4):
                h = (h ^ _lane(acc[k])) * _P1 + _P4
            out[long] = h
        out += lens.astype(np.uint64)
        rows = np.flatnonzero(left >= 8)
        while len(rows):
            out[rows] = _left(out[rows] ^ _lane(wide[at[rows]]), 27) * _P1 + _P4
            at[rows] += 8
            left[rows] -= 8
            rows = rows[left[rows] >= 8]
        rows = np.flatnonzero(left >= 4)
        out[rows] = _left(out[rows] ^ (half[at[rows]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[rows] += 4
        left[rows] -= 4
        rows = np.flatnonzero(left >= 1)
        while len(rows):
            out[rows] = _left(out[rows] ^ (padded[at[rows]].astype(np.uint64) * _P5), 11) * _P1
            at[rows] += 1
            left[rows] -= 1
            rows = rows[left[rows] >= 1]
        out ^= out >> np.uint64(33)
        out *= _P2
        out ^= out >> np.uint64(29)
        out *= _P3
        out ^= out >> np.uint64(32)
    return out
