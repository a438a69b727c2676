import random

import numpy as np
import pyarrow as pa
import xxhash

from pricetrail.llm.arrays import lowered, steps, words_of, xxh64

TEXTS = [None, "", "  ", "one", " One\tTWO\n\nthree ", "é漢😀 ß x", "\x0b\x0c\r a", "a" * 100]


def read(texts, limit=10**9):
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    return list(steps(iter([batch]), "text", limit))


def test_words_are_runs_between_ascii_white_space():
    (_, data, offsets), = read(TEXTS)
    words = words_of(lowered(data), offsets)
    got = [
        [bytes(words.data[words.offs[i] : words.offs[i + 1]]) for i in range(words.first[d], words.first[d + 1])]
        for d in range(len(TEXTS))
    ]
    assert got == [(t or "").encode().lower().split() for t in TEXTS]


def test_small_steps_cover_all_rows():
    parts = read(TEXTS, 5)
    assert sum(p.num_rows for p, _, _ in parts) == len(TEXTS)
    assert b"".join(bytes(d) for _, d, _ in parts) == "".join(t or "" for t in TEXTS).encode()


def test_hash_equals_the_public_library():
    rnd = random.Random(3)
    spans = [bytes(rnd.randrange(256) for _ in range(n)) for n in [*range(0, 80), 200, 1000]]
    data = np.frombuffer(b"".join(spans), dtype=np.uint8)
    lens = np.array([len(s) for s in spans])
    starts = np.cumsum(lens) - lens
    assert xxh64(data, starts, lens, 42).tolist() == [xxhash.xxh64_intdigest(s, 42) for s in spans]
