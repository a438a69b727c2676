import random

import public_tokenizers
import pytest

from pricetrail.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return token_counts.Encoder(PATH)


def texts(n):
    rnd = random.Random(11)
    bits = ["a", "b", "the", " ", "  ", "\n", "\n\n", "\t", "é", "漢", "😀", "1", "23", "'s", "'", "!", "...", "\u00a0", "\u3000", "\x1c", "\x85",
            "<|endoftext|>", "<|endof", "text|>", "_", "ß", "İ", "\r\n", "٣", "\u0300"]
    odd = ["a" * 3000, " " * 3000, "\n" * 3000, "ab " * 2000, "", "<|endoftext|>" * 50, "漢" * 1000,
           "x" * 200 + " " * 500 + "y" * 900 + "\n" * 400 + "<|endoftext|>" * 30]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 900))) for _ in range(n)] + odd


@pytest.mark.parametrize("chunk,overlap", [(80, 16), (200, 20), (400, 64), (1000, 512)])
def test_chunks_splice_exactly(encoder, chunk, overlap):
    some = [t for t in texts(150) if t]
    wanted = [len(e) for e in encoder.tokenizer.encode_batch(some, add_special_tokens=False)]
    assert [encoder.long_count(t, chunk, overlap) for t in some] == wanted


def test_table(spark, encoder, monkeypatch):
    monkeypatch.setattr(token_counts, "SEEN_WORDS", 300)
    some = [*texts(200), None, "word " * 60000]
    wanted = [len(e) for e in encoder.tokenizer.encode_batch([t or "" for t in some], add_special_tokens=False)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(some)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.token_counts(frame, PATH).collect()}
    assert got == {i: (len((t or "").encode()), n, n > 1024) for i, (t, n) in enumerate(zip(some, wanted))}
    assert token_counts.token_counts(frame.limit(0), PATH).collect() == []
