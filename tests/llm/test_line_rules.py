import random

import pytest

from pricetrail.llm import line_rules

SYMBOLS = set("#*$%&|<>")


def brute(rows, line_docs, min_left):
    """One text after another, straight from the definitions."""
    norm = lambda line: b" ".join(line.encode().lower().split())
    lines = {}
    for _, text, source in {(0, t or "", s) for _, t, s in rows}:
        for line in {norm(x) for x in text.split("\n")} - {b""}:
            lines[source, line] = lines.get((source, line), 0) + 1
    out = []
    for doc_id, text, source in rows:
        text = text or ""
        words = text.encode().split()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        seen, dup, left = set(), 0, 0
        for line in text.split("\n"):
            if not line.encode().split():
                continue
            dup += line in seen
            seen.add(line)
            n = lines[source, norm(line)]
            if n <= line_docs:
                left += len(line.encode().split())
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out.append((
            doc_id, len(words), sum(len(w.decode()) for w in words), sum(c in SYMBOLS for c in text), dup, len(covered), failed, left,
            not failed and left >= 10 and left >= min_left * len(words),
        ))
    return out


def rows_of(rnd):
    common = ["Read More here ok", "all rights reserved by us and by all of our many good friends here"]
    rows = []
    for i in range(150):
        parts = [" ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(0, 14))) for _ in range(rnd.randrange(1, 6))]
        if i % 2:
            parts.append(rnd.choice([common[0], common[0].upper(), " read  more\there ok"]))
        if i % 3 == 0:
            parts += [common[1]] * rnd.randrange(1, 3)
        rows.append((i, "\n".join(parts), rnd.choice(["a", "b", None])))
    rows += [(200, None, "a"), (201, "", None), (202, " \n\t\n", "a"), rows[3], rows[3], (203, "spam " * 40000, "b"), (204, "é漢 #x " * 9, "b")]
    return rows


@pytest.mark.parametrize("limits", [(10, 0.3), (3, 0.7)])
def test_against_brute_force(spark, limits):
    rows = [r for r in rows_of(random.Random(8)) if r[0] != 203]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, host string, line int")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept")
    got = line_rules.judged(frame, *limits).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, *limits), key=str)


def test_long_text(spark):
    frame = spark.createDataFrame([(203, "spam " * 40000, "b")], "doc_id long, text string, source string")
    row = line_rules.judged(frame).first()
    assert (row["n_words"], row["n_repeat_words"], row["kept"]) == (40000, 40000, False)


def test_cleaned_texts_and_both_ways(spark):
    rows = rows_of(random.Random(9))
    schema = "doc_id long, text string, source string, n_chars long, host string, clean string"
    frame = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], schema)
    held = line_rules.cleaned(frame, 5).collect()
    joined = line_rules.cleaned(frame, 5, held_lines=0).collect()
    assert held and sorted(map(str, held)) == sorted(map(str, joined))
    kept = [r["doc_id"] for r in line_rules.judged(frame, 5).where("kept").collect()]
    assert sorted(r["doc_id"] for r in held) == sorted(kept)
    assert all(r["n_chars"] == len(r["text"]) and "read more here ok" not in r["text"].lower() for r in held)
    assert line_rules.cleaned(frame).columns == frame.columns


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_rules.judged(frame).collect() == [] and line_rules.cleaned(frame).collect() == []


def test_limit_is_the_same_in_a_host_of_any_size(spark):
    """A passage of a few documents stays, one of more goes, whether the host has 40 or 4000 others."""
    for others in (40, 4000):
        rows = [(i, f"own words of document {i} which are many enough to stay here\n" + ("few share this line" if i < 8 else "many share this line" if i < 30 else ""), "h") for i in range(others)]
        frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = {r["doc_id"]: r["n_left"] for r in line_rules.judged(frame, 10).collect()}
        assert got[3] == got[35] + 4 and got[20] == got[35]


def test_default_limit_removes_lines_of_eleven_documents(spark):
    """Ten documents may share a line, eleven may not: the limit that the rules began with."""
    for sharers, stays in ((10, True), (11, False)):
        rows = [(i, f"own words of document {i} which are many enough to stay here\n" + ("a line that some share" if i < sharers else ""), "h") for i in range(300)]
        got = {r["doc_id"]: r["n_left"] for r in line_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert got[0] == got[299] + 5 * stays
