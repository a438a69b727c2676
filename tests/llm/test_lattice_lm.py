import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from pricetrail.llm import lattice_lm, queries
from pricetrail.llm.frames import held_out

PATH = public_tokenizers.path("piece_bpe_32k.model")
ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return lattice_lm.load(PATH)


def flat(words):
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    return data, np.concatenate(([0], np.cumsum([len(w) for w in words])))


def brute(word, model, vocabulary):
    """All segmentations of a word: the summed probability and the expected uses of each piece."""
    text = "▁" + word.decode()
    pieces = {"".join(map(chr, c[:n])): i for i, (c, n) in enumerate(zip(vocabulary.chars, vocabulary.lens))}
    ways = []

    def walk(at, used, logp):
        if at == len(text):
            ways.append((logp, used))
            return
        for n in range(1, 17):
            part = text[at : at + n]
            if len(part) == n and part in pieces:
                walk(at + n, [*used, pieces[part]], logp + model.pieces[pieces[part]])
        if text[at] not in pieces:
            raw = text[at].encode()
            walk(at + 1, [*used, *[len(pieces) + b for b in raw]], logp + sum(model.bytes[b] for b in raw))

    walk(0, [], 0.0)
    total = math.log(sum(math.exp(p) for p, _ in ways))
    uses = collections.Counter()
    for p, used in ways:
        for u in used:
            uses[u] += math.exp(p - total)
    return total, uses


def test_lattice_against_all_segmentations(vocabulary):
    words = ["the", "thething", "é", "漢a", "😀x", "a", "\0b", "undoing", "ing", "xqzj"]
    words = [w.encode() for w in words]
    model = lattice_lm.Model.start(vocabulary, 1000.0, 10.0)
    times = np.arange(1, len(words) + 1, dtype=np.float64)
    scores = lattice_lm.word_scores(*flat(words), model, vocabulary)
    counts = lattice_lm.expected_counts(*flat(words), times, model, vocabulary)
    uses = collections.Counter()
    for word, score, n in zip(words, scores, times):
        total, used = brute(word, model, vocabulary)
        assert score == pytest.approx(total, rel=1e-9)
        for u, x in used.items():
            uses[u] += x * n
    wanted = np.zeros(len(counts))
    for u, x in uses.items():
        wanted[u] = x
    assert np.allclose(counts, wanted, atol=1e-9)
    every = np.concatenate((model.pieces, model.bytes, [model.end]))
    assert np.exp(every).sum() == pytest.approx(1.0)


def base_by_hand(rows, learned):
    counts, ends = collections.Counter(), 0
    words = lambda t: (t or "").encode().lower().split()
    for d, t in rows:
        if learned(d):
            counts.update(words(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    log = lambda c: math.log10((c + 1) / (n + v + 1))
    return {d: (len(words(t)) + 1, sum(counts[w] > 0 for w in words(t)) + (ends > 0), n, sum(log(counts[w]) for w in words(t)) + log(ends)) for d, t in rows}


def test_query_against_brute_force(spark, vocabulary):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    wanted = base_by_hand(rows, lambda d: zlib.crc32(str(d).encode()) % 7 != 2)
    got = {r["doc_id"]: r for r in queries.op8_lattice_scores(spark, ROOT).collect()}
    assert set(got) == set(wanted)
    for d, (n, known, train, base) in wanted.items():
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (n, known, train)
        assert got[d]["base_score"] == pytest.approx(base, abs=1e-6)
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 7 == 2)


def test_scores_add_up_and_common_words_make_no_difference(spark, vocabulary):
    rnd = random.Random(14)
    rows = [(i, " ".join(rnd.choice(["the", "cat", "Sat", "on", "mats", "zyx", "é"]) for _ in range(rnd.randrange(30))), 1, "x") for i in range(80)]
    rows += [(100, None, 1, "x"), (101, "", 1, "x"), (102, "q" * 20000, 1, "x"), (5, rows[5][1], 1, "x"), (None, "the cat", 1, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, c int, word string")
    learned = ~held_out("doc_id", 7, 2)
    full = lattice_lm.score_documents(frame, learned, PATH).collect()
    none = lattice_lm.score_documents(frame, learned, PATH, common=0).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 7), round(r["score"], 7)) for r in rows)
    assert key(full) == key(none) and len(full) == len(rows)
    by = {r["doc_id"]: r for r in full}
    assert by[100]["score"] == by[101]["score"] and by[100]["n_tokens"] == 1 and math.isfinite(by[102]["score"])
    assert lattice_lm.score_documents(frame.limit(0), learned, PATH).collect() == []
    untrained = lattice_lm.score_documents(frame.where("doc_id < 9"), held_out("doc_id", 1, 5), PATH).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in untrained)


def test_fitting_raises_the_likelihood(spark, vocabulary):
    words = spark.createDataFrame([(b"theme", 50), (b"thing", 40), (b"other", 9), (b"never", 0)], "word binary, c long")
    data, offs = flat([b"theme", b"thing", b"other"])
    times, scores = np.array([50, 40, 9]), []
    for rounds in (0, 1, 3):
        model = lattice_lm.fit(words, 99.0, 5.0, PATH, rounds)
        scores.append(float((lattice_lm.word_scores(data, offs, model, vocabulary) * times).sum()))
    assert scores[0] < scores[1] < scores[2]
