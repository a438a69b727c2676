import random

import corpus_pipeline
from pricetrail.llm import line_rules, near_copies

ROOT = "/root/testdata/sf0.01"


def test_stages_keep_their_promises(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, ROOT).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs.collect())
    before, after = seen["quality_classifier"]
    kept = {r["doc_id"] for r in after}
    marked = [r["doc_id"] for r in before if r["doc_id"] in labels]
    assert sum((d in kept) == bool(labels[d]) for d in marked) / len(marked) >= 0.97
    before, after = seen["quality_rules"]
    rows = spark.createDataFrame(before)
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in line_rules.judged(rows).where("kept").collect())
    before, after = seen["near_dedup"]
    groups = near_copies.near_copy_groups(spark.createDataFrame(before)).select("component_id").distinct().collect()
    assert sorted(r["doc_id"] for r in after) == sorted(r[0] for r in groups)
    before, after = seen["mix_sources"]
    size = lambda rows: sum(len((r["text"] or "").encode().split()) for r in rows)
    assert abs(size(after) - 1.5 * size(before)) < 0.1 * size(before)
    assert all(sum(r["doc_id"] == d for r in after) <= 2 for d in {r["doc_id"] for r in before})
    before, after = seen["encode_pieces"]
    assert len(before) == len(after) and all(r["round_trip"] for r in after)


def test_odd_documents(spark):
    rnd = random.Random(15)
    rows = [(i, " ".join(f"word{rnd.randrange(400)}" for _ in range(30)), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (None, "x y z", "en", None, 5), rows[0], (102, "w" * 200000, "en", "s1", 1)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, k int")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            frame_out = stage(spark, frame, ROOT)
            if name != "encode_pieces":
                assert tuple(frame_out.columns) == corpus_pipeline.COLUMNS
            frame_out.collect()


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "lang", "source", "pieces", "n_pieces", "round_trip"] and out.count() > 0
