import pytest

from pricetrail.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies int, bucket int, packed int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], SCHEMA)


def targets_by_hand(sizes, weights, share, most):
    """Shares by weight; what exceeds a cap is shared again among the others, until none does."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, capped = share * sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


@pytest.mark.parametrize("fan", [4, 64])
def test_targets_and_totals(spark, fan):
    rows = [(i, " ".join(["w"] * (1 + (i * 37) % 50)), None if i % 7 == 0 else f"s{i % 5}") for i in range(400)]
    rows += [(1000 + i, "", "s1") for i in range(5)] + [(2000, None, "empty"), (2001, " \n", "empty")]
    got = mixing.mix_plan(docs(spark, rows), fan=fan).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    wanted = targets_by_hand(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
    for source, size in sizes.items():
        mine = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in mine} == {size}
        assert all(abs(r["target"] - wanted[source]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - wanted[source]) <= 50
        ratio = wanted[source] / size if size else 0
        assert all(r["copies"] in (int(ratio + 1e-9), int(ratio + 1e-9) + 1) and r["copies"] <= 2 for r in mine)
        assert all(r["taken"] == r["size"] * r["copies"] for r in mine)


def test_same_choice_every_time_and_unbiased(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), f"s{i % 3}") for i in range(120)]
    frame = docs(spark, rows)
    first = sorted((r["doc_id"], r["copies"]) for r in mixing.mix_plan(frame).collect())
    again = sorted((r["doc_id"], r["copies"]) for r in mixing.mix_plan(frame.repartition(7)).collect())
    assert first == again
    taken, expected = {}, {}
    for seed in range(12):
        for r in mixing.mix_plan(frame, seed=seed * 100, fan=8).collect():
            taken[r["size"]] = taken.get(r["size"], 0) + r["copies"]
            expected[r["size"]] = expected.get(r["size"], 0) + r["target"] / r["source_size"]
    # Each size has 13 or 14 documents, twelve times: the mean follows the chance within a few standard errors.
    for size in taken:
        assert abs(taken[size] - expected[size]) < 0.2 * expected[size]


def test_equal_rows_share_copies_and_documents_repeat(spark):
    rows = [(1, "a b c", "x")] * 6 + [(None, "d e", None), (None, "d e", None), (2, "f", "y")]
    plan = mixing.mix_plan(docs(spark, rows)).collect()
    copies = [r["copies"] for r in plan if r["doc_id"] == 1]
    assert len(plan) == len(rows) and max(copies) - min(copies) <= 1
    mixed = mixing.mixed_documents(docs(spark, rows))
    assert mixed.columns == docs(spark, rows).columns
    assert sorted(str(r["doc_id"]) for r in mixed.collect()) == sorted(str(r["doc_id"]) for r in plan for _ in range(r["copies"]))


def test_empty_table(spark):
    assert mixing.mix_plan(docs(spark, [])).collect() == []
    assert mixing.mixed_documents(docs(spark, [])).collect() == []
