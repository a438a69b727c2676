import itertools
import random

import numpy as np
import xxhash

from pricetrail.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, prints, bits):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(ids))]


def test_every_near_pair_shares_a_codeword():
    patterns, count = simhash.golay_patterns()
    assert sorted(set(count.tolist())) == [1, 6] and (count == 6).sum() == 1771
    rng = np.random.default_rng(4)
    for word in rng.integers(0, 1 << 23, 12).tolist():
        flips = [0] + [1 << i for i in range(23)] + [(1 << i) | (1 << j) for i, j in itertools.combinations(range(23), 2)]
        near, n = simhash.codewords(np.array([word ^ f for f in flips]))
        mine = set(near[0][: n[0]].tolist())
        assert all(mine & set(near[k][: n[k]].tolist()) for k in range(len(flips)))


def test_every_near_pair_shares_a_bucket():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    for a, b in itertools.combinations(range(0, 64, 7), 2):
        other = base ^ np.uint64((1 << a) | (1 << b))
        keys = [set() for _ in range(600)]
        for offset, part in ((0, base), (300, other)):
            k, rows = simhash.bucket_keys(part)
            for key, row in zip(k.tolist(), rows.tolist()):
                keys[offset + row].add(key)
        assert all(keys[i] & keys[300 + i] for i in range(300))


def test_links_in_large_and_small_buckets_connect_alike(monkeypatch):
    rnd = random.Random(6)
    seeds = [rnd.getrandbits(64) for _ in range(4)]
    prints = list({s ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) & (2**64 - 1) for s in seeds for _ in range(60)})
    fp = np.array(prints, dtype=np.uint64)
    wanted = brute_groups(list(range(len(fp))), prints, 2)

    def groups():
        a, b = simhash.links_in(fp)
        at = {int(p): i for i, p in enumerate(fp)}
        root = simhash._roots(len(fp), iter([(np.array([at[int(x)] for x in a]), np.array([at[int(x)] for x in b]))]))
        return root.tolist()

    small = groups()
    monkeypatch.setattr(simhash, "PAIRWISE", 1)
    assert small == groups() == wanted


def fixture(rnd):
    texts, base = [], " ".join(f"w{rnd.randrange(5000)}" for _ in range(400))
    for _ in range(60):
        words = base.split()
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = f"n{rnd.randrange(99)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(1, 60))) for _ in range(60)]
    texts += [None, "", "  \n", "One", "one", "one two", texts[0].upper(), texts[70], texts[70], "long " * 30000]
    return texts


def test_against_brute_force(spark):
    texts = fixture(random.Random(7))
    rows = [((i * 7919) % 1000, t, 1, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp int, component string").repartition(5)
    prints = [brute_print(t) for t in texts]
    wanted = sorted(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], brute_groups([r[0] for r in rows], prints, 2)))
    for hot in (simhash.HOT_BUCKET, 3):
        got = simhash.near_duplicate_groups(frame, hot_bucket=hot)
        got = got.select("doc_id", simhash.hexadecimal("fp").alias("f"), "component_id").collect()
        assert sorted(map(tuple, got)) == wanted


def test_nulls_repeats_and_nothing(spark):
    schema = "doc_id long, text string, d string, packed int"
    frame = spark.createDataFrame([(None, "a b c d", "x", 1), (5, "a b c d", "y", 2), (5, "a b c d", "y", 2), (None, "q", "z", 3)], schema)
    got = sorted(map(str, simhash.near_duplicate_groups(frame).select("doc_id", "component_id").collect()))
    assert got == sorted(map(str, [*[f"Row(doc_id={d}, component_id={c})" for d, c in ((None, 5), (5, 5), (5, 5), (None, None))]]))
    assert simhash.near_duplicate_groups(frame.limit(0)).collect() == []
