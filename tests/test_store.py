import datetime as dt
import random
import time
from decimal import Decimal as D

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricetrail.operators import identity
from pricetrail.operators.observations import store_observations

OBS = ("seq bigint, run_id bigint, queue_id bigint, external_id string, name string, url string, slug string, "
       "pack_value decimal(18,6), pack_unit string, price decimal(18,2), old_price decimal(18,2), "
       "promo_flag boolean, in_stock boolean, observed_at timestamp")
PROD = ("id bigint, external_id string, name string, url string, slug string, pack_value decimal(18,6), "
        "pack_unit string, created_at timestamp, updated_at timestamp")
SNAP = ("id bigint, run_id bigint, product_id bigint, captured_at timestamp, price decimal(18,2), "
        "old_price decimal(18,2), promo_flag boolean, in_stock boolean, queue_id bigint")
T0 = dt.datetime(2026, 1, 1)


def obs(seq, url="u", ext="e", price="10", old="12", promo=True, stock=True, hours=None, name="n"):
    when = T0 + dt.timedelta(hours=seq if hours is None else hours)
    return (seq, 1, seq, ext, name, url, "s", None, "kg", price and D(price), old and D(old), promo, stock, when)


def one_by_one(rows, products, snapshots):
    """The sequential meaning: match by url, else by id (smallest), overwrite, compare with the newest."""
    prods = {p[0]: dict(ext=p[1], url=p[3], updated=p[8], name=p[2]) for p in products}
    snaps = [(s[3], s[0], s[2], (s[4], s[5], s[6], s[7])) for s in snapshots]
    pbase = max([p[0] for p in products], default=0) + 1
    sbase = max([s[0] for s in snapshots], default=0) + 1
    out = []
    for place, r in enumerate(sorted(rows)):
        seq, ext, name, url, price, old, promo, stock, when = r[0], r[3], r[4], r[5], r[9], r[10], r[11], r[12], r[13]
        found = [(0 if p["url"] == url else 1, i) for i, p in prods.items()
                 if p["url"] == url or (ext is not None and p["ext"] == ext)]
        pid = min(found)[1] if found else pbase + place
        kept = prods.get(pid, {}).get("ext")
        prods[pid] = dict(ext=ext if ext is not None else kept, url=url, updated=when, name=name)
        mine = [s for s in snaps if s[2] == pid]
        newest = max(mine)[:2] if mine else None
        last = next((s for s in mine if s[:2] == newest), None)
        sid, created = (last[1] if last else None), False
        state = (price, old, promo, stock)
        if url != "" and (price is not None or old is not None or stock):
            if last is None or last[3] != state:
                sid, created = sbase + place, True
                snaps.append((when, sid, pid, state))
        out.append((seq, pid, sid, created))
    return out, {i: (p["ext"], p["url"], p["updated"], p["name"]) for i, p in prods.items()}


def run(spark, rows, products=(), snapshots=(), hot_rows=None):
    done = store_observations(
        spark.createDataFrame(rows, OBS), spark.createDataFrame(list(products), PROD),
        spark.createDataFrame(list(snapshots), SNAP), F.lit(T0), hot_rows=hot_rows,
    )
    results = sorted(tuple(r) for r in done.results.collect())
    table = {r.id: (r.external_id, r.url, r.updated_at, r.name) for r in done.products.collect()}
    return results, table, done


def test_new_unchanged_and_changed(spark):
    rows = [obs(0), obs(1), obs(2, old="13"), obs(3, old="13", price="9")]
    results, table, done = run(spark, rows)
    assert [r[3] for r in results] == [True, False, True, True]
    assert len({r[1] for r in results}) == 1 and results[1][2] == results[0][2]
    assert list(table.values())[0][2] == T0 + dt.timedelta(hours=3)
    assert done.snapshots.count() == 3


def test_long_text_is_trimmed_and_cut(spark):
    row = list(obs(0, url="  " + "u" * 1100, ext=" " + "e" * 90 + " ", name="n" * 600))
    row[6], row[8] = "s" * 600, " " + "k" * 40
    _, _, done = run(spark, [tuple(row)])
    p = done.products.first()
    assert [len(v) for v in (p.external_id, p.name, p.url, p.slug, p.pack_unit)] == [64, 512, 1024, 512, 16]


def test_invalid_state_updates_the_product_only(spark):
    results, table, done = run(spark, [obs(0, price=None, old=None, stock=False)])
    assert results[0][2:] == (None, False) and len(table) == 1 and done.snapshots.count() == 0


def test_late_row_is_compared_with_the_newest_and_kept_at_its_time(spark):
    rows = [obs(0, hours=10), obs(1, hours=5, price="8"), obs(2, hours=6, price="10"), obs(3, hours=11, price="8"),
            obs(4, hours=7, price="10"), obs(5, hours=8, price="8")]
    assert run(spark, rows)[0] == one_by_one(rows, [], [])[0]


def _random_rows(rng, n, urls, exts, jitter):
    rows = []
    for seq in range(n):
        hours = seq + (rng.randint(-12, 12) if rng.random() < jitter else 0)
        rows.append(obs(
            seq, url=rng.choice(urls), ext=rng.choice(exts), price=rng.choice(["1", "2", None]),
            old=rng.choice([None, "3"]), promo=rng.random() < 0.3, stock=rng.random() < 0.5, hours=hours,
            name=f"n{seq}",
        ))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_random_batches_match_one_by_one(spark, seed):
    rng = random.Random(seed)
    width = 3 + 3 * seed
    urls = [f"u{i}" for i in range(width)] + [""]
    exts = [f"e{i}" for i in range(width)] + [None]
    rows = _random_rows(rng, 60, urls, exts, 0.3 if seed % 2 else 0.0)
    # Some urls and ids that belong together and never meet others.
    rows += [obs(100 + i, url=f"solo{i % 4}", ext=f"own{i % 4}", price=str(i % 3 + 1)) for i in range(12)]
    rows += [obs(200 + i, url=f"move{i % 3}", ext="mover", price=str(i % 2 + 1)) for i in range(9)]
    products = [
        (5, "e0", "old", "u1", None, None, None, T0, None), (6, "e0", "old", "zz", None, None, None, T0, None),
        (7, None, "old", "solo1", None, None, None, T0, None), (8, "mover", "old", "elsewhere", None, None, None, T0, None),
    ]
    snapshots = [(50, 1, 5, T0, D("1"), None, False, True, None), (51, 1, 7, T0, D("2"), D("12"), True, True, None),
                 (52, 1, 7, T0, D("1"), D("12"), True, True, None)]
    expected, table = one_by_one(rows, products, snapshots)
    results, got, _ = run(spark, rows, products, snapshots)
    assert results == expected
    assert got == table


def test_random_batch_with_split_keys(spark):
    rng = random.Random(11)
    rows = _random_rows(rng, 80, ["u0", "u1", "u2"], ["e0", "e1", None], 0.4)
    expected, table = one_by_one(rows, [], [])
    results, got, _ = run(spark, rows, hot_rows=15)
    assert results == expected and got == table


def test_ids_stay_small_over_many_batches(spark):
    """Arrival numbers near the largest long: three batches, one after another, as if row by row."""
    products, snapshots, expected = [], [], None
    for batch in range(3):
        base = 2**61 + batch * 2**60
        rows = [list(obs(base + i * 1_000_003, url=f"u{batch}-{i % 3}", ext=f"e{batch}-{i % 3}", price=str(i + 1), hours=batch * 50 + i)) for i in range(6)]
        for r in rows:
            r[2] = 1
        rows = [tuple(r) for r in rows]
        results, _, done = run(spark, rows, products, snapshots)
        expected, _ = one_by_one(rows, products, snapshots)
        assert results == expected
        products = [tuple(r) for r in done.products.collect()]
        snapshots += [tuple(r) for r in done.snapshots.collect()]
    assert len({p[0] for p in products}) == 9 and max(p[0] for p in products) <= 18
    assert len({s[0] for s in snapshots}) == 18 and max(s[0] for s in snapshots) <= 18


@pytest.mark.parametrize("seed", [0, 1, 4, 5])
def test_tangled_addresses_match_one_by_one(spark, seed):
    """A blank address and moving products tie many addresses and ids together."""
    rng = random.Random(100 + seed)
    rows = []
    for seq in range(150):
        kind = rng.random()
        url = "" if kind < 0.35 else f"u{rng.randrange(12)}" if kind < 0.9 else f"new{seq}"
        ext = None if rng.random() < 0.15 else f"e{rng.randrange(4 + 3 * seed)}"
        rows.append(obs(seq, url=url, ext=ext, price=rng.choice(["1", "2"]), name=f"n{seq}"))
    products = [(i, f"e{i % 5}", "old", f"u{i}" if i % 2 else f"gone{i}", None, None, None, T0, None) for i in range(1, 9)]
    if seed % 2:
        products.append((20, "e1", "old", "", None, None, None, T0, None))
    expected, table = one_by_one(rows, products, [])
    results, got, _ = run(spark, rows, products, hot_rows=40 if seed > 3 else None)
    assert [r[:2] for r in results] == [r[:2] for r in expected]
    assert results == expected and got == table


def test_many_blank_addresses_are_spread(spark):
    """A hundred thousand rows with a blank address: few rows are read in order, the others by ordered passes."""
    from pricetrail.operators import identity

    n = 100_000
    rng = random.Random(9)
    rows = []
    for i in range(n):
        own = rng.randrange(3000)
        rows.append((i, "" if rng.random() < 0.9 else f"u{own}", f"e{own}" if rng.random() < 0.99 else f"e{rng.randrange(3000)}"))
    frame = spark.createDataFrame(rows, "seq bigint, url string, external_id string")
    products = spark.createDataFrame([(1, "", "e0")], "id bigint, url string, external_id string")
    line = identity._timeline(frame, products, 20_000)
    assert line.where("seq >= 0 AND (looks OR keep)").count() < n // 20
    got = {r.seq: r.product_id for r in identity.resolve_products(frame, products, F.lit(10), hot_rows=20_000).select("seq", "product_id").collect()}
    by_url, by_ext, state = {"": 1}, {"e0": {1}}, {1: ("", "e0")}
    for seq, url, ext in rows:
        p = by_url.get(url) or min(by_ext.get(ext, ()), default=None) or 10 + seq
        old_url, old_ext = state.get(p, (None, None))
        if by_url.get(old_url) == p and old_url != url:
            del by_url[old_url]
        by_ext.get(old_ext, set()).discard(p)
        by_url[url], state[p] = p, (url, ext)
        by_ext.setdefault(ext, set()).add(p)
        assert got[seq] == p, seq


def test_texts_are_written_once(spark, monkeypatch):
    """Numbering and places once wrote every observation with its texts again."""
    from pricetrail.operators import identity, numbering, observations

    written = []
    for module in (observations, identity, numbering):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: (written.append(df.columns), cut(df))[1])
    results, _, _ = run(spark, [obs(i, url=f"u{i % 3}", ext=f"e{i % 3}") for i in range(9)])
    assert len(results) == 9 and sum("name" in columns for columns in written) == 1


@pytest.mark.parametrize("hot_rows", [None, 30])
def test_many_late_products_and_arrivals_below_zero(spark, hot_rows):
    """Products that are settled side by side, a long one, and rows that move between products, from -2**62 on."""
    rng = random.Random(21)
    rows = _random_rows(rng, 40, ["a", "b"], ["x", "y", None], 0.4)
    for seq in range(40, 340):
        own = 0 if rng.random() < 0.2 else rng.randrange(30)
        rows.append(obs(seq, url=f"own{own}", ext=f"id{own}", price=rng.choice(["1", "2", None]), old=rng.choice([None, "3"]),
                        promo=rng.random() < 0.5, stock=rng.random() < 0.5, hours=rng.randrange(60), name=f"n{seq}"))
    rows = [(r[0] - 2**62, *r[1:]) for r in rows]
    products = [(4, "id1", "old", "own1", None, None, None, T0, None), (9, "x", "old", "zz", None, None, None, T0, None)]
    snapshots = [(50, 1, 4, T0 + dt.timedelta(hours=20), D("1"), None, False, True, None)]
    expected, table = one_by_one(rows, products, snapshots)
    results, got, _ = run(spark, rows, products, snapshots, hot_rows)
    assert results == expected and got == table


def test_rows_decided_side_by_side_match_one_by_one():
    """Batches cut anywhere, groups that go on in the next one."""
    import numpy as np

    from pricetrail.operators.observations import decide_in_order

    rng = np.random.default_rng(5)
    group = np.sort(rng.choice(60, 900, p=np.r_[[0.3], np.full(59, 0.7 / 59)]))
    at, order, valid = rng.integers(0, 9, 900), np.arange(900), rng.random(900) < 0.8
    state = rng.integers(0, 2, (900, 3))
    expected, best, last = [], None, None
    for g, when, own, good, now in zip(group.tolist(), at.tolist(), order.tolist(), valid.tolist(), map(tuple, state.tolist())):
        best, last = (best if g == last else None), g
        keeps = good and (best is None or best[2] != now)
        expected.append((keeps, own if keeps else best[1] if best else None))
        if keeps and (best is None or (when, own) > best[:2]):
            best = (when, own, now)
    got, held, begin = [], None, 0
    for end in [1, 2, 70, 400, 401, 820, 900]:
        s = slice(begin, end)
        if begin and group[begin] != group[begin - 1]:
            held = None
        stored, meant, none, held = decide_in_order(group[s], at[s], order[s], valid[s], state[s], held)
        got += [(bool(k), None if n else int(m)) for k, m, n in zip(stored, meant, none)]
        begin = end
    assert got == expected


def test_the_smallest_holder_of_an_id_is_found_without_looking_at_all():
    """Each pair of rows takes the smallest product with an id, and gives it another id."""
    n = 20_000
    known = [("c", -1, f"u{i}", "e", i, True) for i in range(n)]
    rows = [("c", 2 * i + k, f"new{i}", "ef"[k], None, True) for i in range(n) for k in range(2)]
    columns = list(zip(*known, *rows))
    schema = pa.schema({"component": pa.string(), "seq": pa.int64(), "url": pa.string(), "external_id": pa.string(), "stored_id": pa.int64(), "keep": pa.bool_()})
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
    began = time.process_time()
    out = pa.Table.from_batches(identity._fold(iter([batch])))
    assert time.process_time() - began < 6
    assert out["product_id"].to_pylist() == [i // 2 for i in range(2 * n)] and out["born_seq"].null_count == 2 * n
