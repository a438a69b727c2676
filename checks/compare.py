"""Run the registered queries beside their SQL and compare: python -m checks.compare DIR [name ...]"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from pricetrail.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return str(value)


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def main(root: str, wanted: list[str]) -> int:
    spark = build_session("compare", "local[8]", 8, {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and name not in wanted:
            continue
        try:
            began = time.time()
            df = fn(spark, root)
            got_names, got = _table(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - began
            if name not in ORACLE:
                print(f"rows  {name}: {len(got)} rows, {took:.1f}s")
                continue
            cur = db.execute(ORACLE[name])
            exp_names, exp = _table([d[0] for d in cur.description], cur.fetchall())
            if got_names != exp_names:
                raise AssertionError(f"columns {got_names} != {exp_names}")
            if got != exp:
                only_got, only_exp = sorted(set(got) - set(exp)), sorted(set(exp) - set(got))
                raise AssertionError(
                    f"{len(got)} vs {len(exp)} rows, {len(only_got)}/{len(only_exp)} differ\n"
                    f"   {got_names}\n   spark {only_got[:3]}\n   sql   {only_exp[:3]}"
                )
            print(f"ok    {name}: {len(got)} rows, {took:.1f}s")
        except Exception as error:
            bad += 1
            print(f"FAIL  {name}: {str(error)[:1500]}")
        sys.stdout.flush()
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
