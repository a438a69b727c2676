import hashlib
import random

import duckdb
import pytest

from pricetrail.llm import substrings
from pricetrail.llm.queries import op11_substring_dedup

ROOT = "/root/testdata/sf0.01"


def brute(rows, window):
    """``(doc_id, n_words, n_removed, kept)`` of every row, sorted."""
    order = lambda d: (d is None, d or 0)
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, (True, 1)), order(d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < order(d):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), kept.decode()))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


def read(frame):
    rows = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"], r["kept_sha256"]) for r in frame.collect()]
    assert all(hashlib.sha256(r[3].encode()).hexdigest() == r[4] for r in rows)
    return sorted((r[:4] for r in rows), key=lambda r: ((r[0] is None, r[0] or 0), r[1:]))


def planted(rnd, n=120):
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "漢字"]
    text = lambda k: rnd.choices(vocabulary, k=k)
    passages = [text(rnd.randint(6, 60)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            parts += text(rnd.randint(0, 30))
            if rnd.random() < 0.6:
                p = list(rnd.choice(passages))
                if rnd.random() < 0.3:
                    p[rnd.randrange(len(p))] = "changed"
                parts += p[rnd.randint(0, 4) :]
        if rnd.random() < 0.1:
            parts += ["la"] * rnd.randint(5, 80)  # a passage that repeats itself
        rows.append((rnd.randint(0, n), rnd.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(5, None), (6, ""), (7, " \n "), rows[3], rows[4], (None, rows[5][1]), (None, rows[6][1]), (-3, rows[7][1]), (None, " ".join(passages[0] + passages[1]))]
    rows += [(1000 + i, rows[8][1]) for i in range(30)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("window, chunk, threshold", [(10, 4_000_000, 32_000_000), (10, 700, 0), (4, 2_000, 0), (2, 300, 32_000_000)])
def test_against_brute_force(spark, monkeypatch, window, chunk, threshold):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", threshold)
    rows = planted(random.Random(window))
    frame = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, key string, doc int, bucket int").repartition(3)
    assert read(substrings.without_repeats(frame, window, keep_text=True)) == brute(rows, window)


def test_very_long_text_and_nothing(spark):
    rnd = random.Random(4)
    long = [f"v{rnd.randrange(10**6)}" for _ in range(60_000)]
    rows = [(9, " ".join(long)), (3, " ".join(long[100:40_000])), (12, " ".join(long[59_960:] + ["x"] * 20 + long[:55]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert read(substrings.without_repeats(frame, keep_text=True)) == brute(rows, 50)
    assert substrings.without_repeats(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        substrings.without_repeats(frame, 5)


def test_query_against_sql(spark):
    got = sorted(tuple(r) for r in op11_substring_dedup(spark, ROOT).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{ROOT}/documents.parquet'")
        wanted = sorted(con.execute(substrings.ORACLE).fetchall())
    assert got == wanted and sum(r[2] for r in got) > 0


def test_packed_numbers():
    import numpy as np

    for values in ([], [0], [255, 256, 2**40], [2**62]):
        assert substrings._unpacked(substrings._packed(np.array(values, dtype=np.int64))).tolist() == values
