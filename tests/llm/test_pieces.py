import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from pricetrail.llm import pieces
from pricetrail.llm.arrays import steps

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(PATH)


def texts():
    rnd = random.Random(1)
    bits = ["a", "b", "the", " ", "  ", "▁", "\n", "é", "漢", "😀", "ing", "\t", "ra", "\0"]
    odd = [None, "", " ", "  ", "a▁b", "▁", "x" * 1000, " " * 777, "the" * 300, "<0x41></s><unk>", "a▁▁b  c"]
    return odd + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(300))) for _ in range(300)]


def encode(some, vocabulary, seen=None):
    batch = pa.record_batch([pa.array(some, pa.string())], ["text"])
    ids, back = [], []
    for _, data, offsets in steps(iter([batch]), "text", 3000):
        out, first = pieces.encode(data, offsets, vocabulary, seen)
        ids += [out[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        raw, ends = pieces.decode(out, first, vocabulary)
        back += [bytes(raw[a:b]).decode() for a, b in zip(ends[:-1], ends[1:])]
    return ids, back


@pytest.mark.parametrize("long", [3, pieces.LONG_CHUNK])
def test_ids_equal_the_library(vocabulary, monkeypatch, long):
    monkeypatch.setattr(pieces, "LONG_CHUNK", long)
    some = texts()
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids, back = encode(some, vocabulary, pieces.Seen())
    assert ids == model.encode([t or "" for t in some])
    assert back == [(t or "").replace("▁", " ") for t in some]


def test_seen_chunks_are_forgotten(vocabulary, monkeypatch):
    some = texts()
    plain, _ = encode(some, vocabulary)
    monkeypatch.setattr(pieces, "SEEN_CHUNKS", 50)
    assert encode(some, vocabulary, pieces.Seen())[0] == plain


def test_suffix_array_and_matches(vocabulary):
    rnd = random.Random(2)
    text = np.array([rnd.choice([97, 98, 99]) for _ in range(200)])
    places = pieces.suffix_array(text, 4)
    assert [tuple(text[p : p + 4]) for p in places] == sorted(tuple(text[p : p + 4]) for p in range(200))
    starts, lens, rows = pieces.match(np.array([ord(c) for c in "the▁thing"]), vocabulary)
    found = {("the▁thing"[s : s + n]) for s, n in zip(starts, lens)}
    assert {"the", "▁th", "ing", "▁thing"} <= found
    assert all("".join(map(chr, vocabulary.chars[r][: vocabulary.lens[r]])) == "the▁thing"[s : s + n] for s, n, r in zip(starts, lens, rows))


def test_best_scores_when_the_vocabulary_is_of_unigram_kind(vocabulary):
    weights = {(0, 1): -1.0, (1, 2): -1.0, (0, 2): -1.5, (2, 3): -1.0, (1, 3): -0.2}
    edges = sorted(weights)
    ends = pieces._relax_scores(
        3, np.array([a for a, _ in edges]), np.array([b - a for a, b in edges]), np.array([weights[e] for e in edges]), -9.0
    )
    assert ends.tolist() == [1, 3]


def test_table(spark):
    rows = [(1, None, "x", 1), (2, "", "y", 2), (2, "", "y", 2), (3, "a  b\n", None, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, pieces string, text_ int")
    got = sorted(pieces.encoded_documents(frame, PATH).collect(), key=str)
    assert [(r["doc_id"], r["n_pieces"], r["round_trip"]) for r in got] == [(1, 0, True), (2, 0, True), (2, 0, True), (3, 4, True)]
    assert [r["pieces"] is None for r in got] == [True, False, False, False]
    assert pieces.encoded_documents(frame.limit(0), PATH).collect() == []
