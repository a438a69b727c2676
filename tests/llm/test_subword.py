import math
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from pricetrail.llm import queries, subword
from pricetrail.llm.frames import held_out

ROOT = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """The rows that training may not see are told apart, and ids are held out as asked."""
    scored = queries.op4_quality_scores(spark, ROOT)
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    rows = scored.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    mine = [r for r in rows if r["held_out"]]
    assert len(mine) > 500 and sum(r["predicted"] == r["quality"] for r in mine) / len(mine) >= 0.98


def test_features_are_shared_by_words_with_common_parts():
    import pyarrow as pa

    buckets, owners = subword.word_features(pa.array([b"reading", b"read", "é".encode(), b"x" * 5000], pa.large_binary()))
    of = lambda i: set(buckets[owners == i].tolist())
    assert len(of(0) & of(1)) >= 4 and len(of(2)) >= 2 and buckets.min() >= 2


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, labelled):
    rows = [(i, ("good fine text number %d" if i % 2 else "bad &&& junk !!! %d") % i, "x", 1) for i in range(60)]
    rows += [(100, None, "x", 1), (101, " \n", "x", 1), (102, "z" * 300000, "x", 1), (1, rows[1][1], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score int")
    marks = [(i, i % 2) for i in range(60)] + [(3, None), (None, 1), (7, 5)] if labelled else []
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = subword.fitted(subword.labelled_sample(docs, labels, "quality", ~held_out("doc_id", 4, 2), 50))
    got = {r["doc_id"]: r["score"] for r in subword.quality_scores(docs, model).collect()}
    assert len(got) == 63 and all(0 <= s <= 1 for s in got.values()) and got[100] == got[101]
    if labelled:
        assert min(got[i] for i in range(1, 60, 2)) > max(got[i] for i in range(0, 60, 2))
    else:
        assert set(got.values()) == {0.5}
    assert subword.quality_scores(docs.where(F.lit(False)), model).collect() == []


def plain_score(model, text):
    """The score feature by feature: words and their n-grams with marked ends, repeats of the word before, the text itself."""
    words = text.encode().split()
    if not words:
        return model.prior
    logits = [float(model.logit[subword._TEXT])]
    for i, word in enumerate(words):
        marked = b"<" + word + b">"
        logits.append(float(model.logit[2 + xxhash.xxh64_intdigest(marked, subword.SEED) % (subword.BUCKETS - 2)]))
        for size in subword.NGRAMS:
            for at in range(len(marked) - size + 1):
                h = 2166136261 + size
                for byte in marked[at : at + size]:
                    h = (h ^ byte) * 16777619 % 2**32
                h ^= h >> 15
                logits.append(float(model.logit[2 + h % (subword.BUCKETS - 2)]))
        if i and words[i - 1] == word:
            logits.append(float(model.logit[subword._AGAIN]))
    return 1 / (1 + math.exp(-sum(logits) / len(logits)))


def test_scores_against_brute_force(spark):
    """Every whole text of the table, with the model that the query learns."""
    root = "/root/testdata/sf0.001"
    model = queries.quality_model(spark, root)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    got = {r["doc_id"]: r["score"] for r in queries.op4_quality_scores(spark, root).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        assert math.isclose(got[d], plain_score(model, text), rel_tol=1e-6, abs_tol=1e-9), d


def test_one_example_for_each_labelled_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = subword.labelled_sample(docs, labels, "quality", F.lit(True), 10).collect()
    assert sorted(map(tuple, got)) == [("", 1), ("c", 0)]
