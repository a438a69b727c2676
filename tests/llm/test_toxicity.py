import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricetrail.llm import queries, toxicity

ROOT = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = queries.op7_toxicity_scores(spark, ROOT).join(spark.read.parquet(f"{ROOT}/labels.parquet"), "doc_id").collect()
    mine = [r for r in rows if r["held_out"]]
    assert len(mine) > 500 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r["toxic"] for r in mine) / len(mine) >= 0.95
    ranked = sorted(mine, key=lambda r: r["score"])
    ones = [i for i, r in enumerate(ranked) if r["toxic"]]
    auc = (sum(ones) - len(ones) * (len(ones) - 1) / 2) / (len(ones) * (len(ranked) - len(ones)))
    assert auc >= 0.95


@pytest.mark.parametrize("block", [4, 64])
def test_blocks_give_the_exact_neighbours(block):
    rng = np.random.default_rng(13)
    n, terms = 300, 40
    dense = np.where(rng.random((n, terms)) < 0.1, rng.random((n, terms)), 0.0)
    dense = dense[dense.sum(axis=1) > 0]
    dense[5] = dense[6] = dense[7]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    docs, cols = np.nonzero(dense)
    ids = rng.permutation(len(dense)) * 3
    index = toxicity.Index(ids, rng.integers(0, 2, len(dense)), docs, cols, dense[docs, cols], terms, block)
    for i in range(len(dense)):
        own = int(ids[i]) if i % 2 else None
        near = np.round(dense @ dense[i], 12)
        order = [j for j in np.lexsort((ids, -near)) if near[j] > 0 and ids[j] != own][:15]
        mine = np.flatnonzero(dense[i])
        found, scores = index.nearest(mine, dense[i][mine], own, 15)
        assert index.ids[found].tolist() == ids[order].tolist()
        assert np.allclose(scores, near[order])


def test_ngrams_are_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "PREFIXES", ())
    hashes, owners = toxicity.ngrams(pa.array([b"abc", b"b"], pa.large_binary()))
    wanted = lambda s: int.from_bytes(bytes([len(s)]) + s.encode(), "big")
    assert sorted(hashes[owners == 0].tolist()) == sorted(map(wanted, ["<abc", "abc>", "<abc>"]))
    assert hashes[owners == 1].tolist() == []


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, labelled):
    rows = [(i, (f"you utter nitwit number {i}" if i % 3 == 0 else f"a kind word number {i}"), "x", 1) for i in range(300)]
    rows += [(1000, None, "x", 1), (1001, " \n", "x", 1), (1002, "z" * 300000, "x", 1), (1003, "NITWIT", "x", 1), (None, "nitwit", "x", 1), (3, rows[3][1], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, terms int")
    marks = [(i, int(i % 3 == 0)) for i in range(300)] + [(4, None), (None, 1), (5, 7)] if labelled else []
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {}
    for r in toxicity.toxicity_scores(docs, labels, F.col("doc_id") % 5 != 0).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    score = {k: v[0]["score"] for k, v in got.items()}
    assert all(0 <= s <= 1 for s in score.values()) and score[1000] == score[1001]
    if labelled:
        assert min(score[i] for i in range(0, 300, 3)) >= 0.7 > max(score[i] for i in range(300) if i % 3)
        assert score[1003] >= 0.7 and score[None] >= 0.7 and 3 not in got[3][0]["evidence"]
    else:
        assert set(score.values()) == {0.5}
    assert toxicity.toxicity_scores(docs.limit(0), labels, F.lit(True)).collect() == []


def test_telling_terms_that_mostly_mark_label_0(spark):
    rows = [(f"text{i} " + ("zq" if i < 50 else "of") + f" end{i}", int(i < 20 or i > 969)) for i in range(1000)]
    chosen = toxicity.choose_terms(spark.createDataFrame(rows, "text string, label int"))
    assert int.from_bytes(b"\x04<zq>", "big") in chosen.tolist()  # 20 of its 50 examples have label 1, 50 of all 1000


def test_a_passage_that_examples_share(spark):
    passage = "grumblewort snickerdoodle flabbergastric quibblesome zanthropic wumplewacket"
    rows = [(i, f"kind{i * 7919 % 1000} calm{i * 104729 % 1000} " + (passage if i % 10 == 0 else "")) for i in range(300)] + [(1000, passage), (1001, "of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)], "doc_id long, toxic int")
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels, F.lit(True)).collect()}
    assert score[1000] >= 0.7 > score[1001]
