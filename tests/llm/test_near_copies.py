import hashlib
import itertools
import random

import pytest

import corpus_pipeline
from pricetrail.llm import near_copies


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def components(rows):
    """For each row the number of its group, over all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def brute(rows):
    """The ids and texts that stay, one for each group of rows."""
    first = {}
    for c, (d, t) in zip(components(rows), rows):
        rank = (d is None, d or 0, hashlib.md5((t or "").encode()).hexdigest())
        first[c] = min(first.get(c, (rank, d, t)), (rank, d, t), key=lambda x: x[0])
    return sorted(((d is None, d or 0, t or "") for _, d, t in first.values()))


def read(frame):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in frame.collect())


def planted(rnd):
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(40):
        words = rnd.choices(vocabulary, k=rnd.randint(60, 400))
        rows.append(" ".join(words))
        for _ in range(rnd.randint(0, 4)):
            other = list(words)
            for at in rnd.sample(range(len(words)), rnd.randint(1, max(2, len(words) // 30))):
                other[at] = rnd.choice(vocabulary)
            rows.append(" ".join(other))
    base = rnd.choices(vocabulary, k=200)
    for i in range(60):  # a bucket larger than ``pairwise``
        rows.append(" ".join([*base[: 190 + i % 8], f"end{i}"]))
    rows += ["", " \n", "one two", "ONE  two", "three four five six", rows[0], rows[0].upper()]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_stage_against_brute_force(spark):
    rows = planted(random.Random(7))
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    wanted = brute(rows)
    assert read(dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame, "")) == wanted
    assert read(near_copies.first_of_each_group(frame, pairwise=24)) == wanted


def star(rnd, copies):
    """A text and copies of it that are similar enough to it, but less so to each other."""
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(copies):
        own = list(base)
        for at in rnd.sample(range(len(base)), 8):
            own[at] = f"own{i}at{at}"
        rows.append((i + 1, " ".join(own)))
    return rows


@pytest.mark.parametrize("pairwise", [near_copies.PAIRWISE, 24])
def test_large_star_keeps_its_links(spark, pairwise):
    rows = star(random.Random(11), 450)
    base = shingles(rows[0][1])
    like = sum(5 * len(base & shingles(t)) >= 4 * len(base | shingles(t)) for _, t in rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    groups = near_copies.near_copy_groups(frame, pairwise)
    assert groups.where("component_id = 0").count() >= 0.99 * like > 400


def twins(rnd, pairs):
    """Texts that are similar enough to one other only, and almost so to all the rest, with which they share buckets."""
    base = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(pairs):
        places = rnd.sample(range(5, 1995, 10), 50)
        for twin, mine in (("a", places[8:29]), ("b", places[29:])):
            own = list(base)
            for at in places[:8]:
                own[at] = f"both{i}at{at}"
            for at in mine:
                own[at] = f"own{i}{twin}at{at}"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("pairwise", [near_copies.PAIRWISE, 24])
def test_no_link_is_lost_where_all_members_of_a_bucket_are_almost_similar(spark, pairwise):
    rows = twins(random.Random(3), 40)
    groups = components(rows)
    assert len(set(groups)) > 30
    low = {}
    for c, (d, _) in zip(groups, rows):
        low[c] = min(low.get(c, d), d)
    got = near_copies.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string"), pairwise).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: low[c] for c, (d, _) in zip(groups, rows)}


def test_no_group_is_lost_with_null_or_repeated_ids(spark):
    rows = [(None, "a a a"), (None, "b b b"), (1, "c c c"), (None, "c c c"), (4, None), (3, " "), (7, "A b"), (7, "a b"), (7, "other text"), (7, "other text")]
    rows += [(20 + i, f"text {i} of its own") for i in range(12)] + [(20 + i, f"text {i + 1} of its own") for i in range(12)]
    rows += [(20 + i, f"yet another {i}") for i in range(12)]
    frame = spark.createDataFrame([(*r, {"k": 1}, "clash", 5) for r in rows], "doc_id long, text string, attrs map<string,int>, key string, row int")
    assert read(near_copies.first_of_each_group(frame)) == brute(rows)
    assert near_copies.first_of_each_group(frame).columns == frame.columns
    assert near_copies.first_of_each_group(frame.limit(0)).collect() == []


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-50])), (3, " ".join(words[:60_000]))]
    assert read(near_copies.first_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
