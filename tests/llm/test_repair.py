import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from pricetrail.llm import repair
from pricetrail.llm.queries import op13_repaired_conversations

SPACE = " \t\n\x0b\x0c\r"
ORDER = {"": {"u": "u", "s": "s"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def harm(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """Counts, cost, audit and digest of one conversation: least (cost, audit) of every suffix and last role."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        if bare:
            seen.add((role, text))

    @lru_cache(None)
    def best(i, last, inserted):
        """The least (cost, audit, lines) from row ``i`` on after the role ``last``; at most two inserts before a row."""
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserted < 2:
            for role in ORDER[last].values():
                if role in NAMES:
                    cost, audit, lines = best(i, role, inserted + 1)
                    options.append((cost + 2, "I" + audit, (f"{NAMES[role]}:", *lines)))
        if i < len(rows):
            cost, audit, lines = best(i + 1, last, 0)
            options.append((cost + 3, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                _, _, name, text = rows[i]
                more = faults[i] == "truncated"
                for role in ORDER[last].values():
                    if name[:1] == role:
                        cost, audit, lines = best(i + 1, role, 0)
                        options.append((cost + more, "K" + audit, (f"{name}:{text}", *lines)))
                    if role in NAMES:
                        cost, audit, lines = best(i + 1, role, 0)
                        options.append((cost + more + 2, "R" + audit, (f"{NAMES[role]}:{text}", *lines)))
        return min(options, default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):  # keep the recursion short
        for last in ORDER:
            best(i, last, 0)
    cost, audit, lines = best(0, "", 0)
    initials = [r[2][:1] for r in rows]
    turns = {r[1] for r in rows} - {None}
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def read(frame):
    rows = frame.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}


def test_query_against_brute_force(spark):
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = by_conversation(harm(given))
    wanted = {conv: brute(after.get(conv, [])) for conv in {r[0] for r in given}}
    assert read(op13_repaired_conversations(spark, "/root/testdata/sf0.01")) == wanted


def invented(rnd, conversations):
    rows = []
    texts = ["Good.", "Fine!", "Why?", "cut off", "", " \t", "Good. \n", "a", "Longer text."]
    for conv in range(conversations):
        for turn in range(rnd.choice([0, 1, 2, 3, 5, 9, 40])):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sage"])
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn + 5]), role, rnd.choice([*texts, None])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits, fan, chunk", [(10, 1024, 10**6), (2, 2, 10), (3, 4, 1)])
def test_pieces_change_nothing(spark, monkeypatch, bits, fan, chunk):
    monkeypatch.setattr(repair, "PIECE_BITS", bits)
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rnd = random.Random(bits)
    rows = invented(rnd, 60) + [(None, i, "user", f"Text {i}.") for i in range(5)]
    rows += [(1000, i, rnd.choice(["user", "assistant", "system"]), f"{rnd.randrange(60)}{rnd.choice('.!?x')}") for i in range(150)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    wanted = {conv: brute(part) for conv, part in by_conversation(plain).items()}
    got = read(repair.repaired(frame, fan))
    assert got == wanted


def test_damage_of_odd_rows(spark):
    rows = invented(random.Random(77), 50) + [(None, None, None, None), (None, 3, "user", "x" * 300_000 + ".")] * 2
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"{SCHEMA}, audit string, pos long")
    after = by_conversation(harm(rows))
    assert read(repair.damaged_and_repaired(frame)) == {conv: brute(after.get(conv, [])) for conv in {r[0] for r in rows}}
    assert repair.damaged_and_repaired(frame.limit(0)).collect() == []
    assert repair.repaired(frame.limit(0)).collect() == []


def test_everything_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(7, turn, "user", "Gone.")], SCHEMA)
    assert read(repair.damaged_and_repaired(frame)) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
