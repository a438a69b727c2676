"""Url filters by a sort-merge range join on reversed hosts.

A host's canonical key is the host reversed and closed by a dot, so a rule's host and all its
subdomains are one interval of keys: those that begin with the rule's key. Rules and urls are sorted
together by key in range partitions; a sweep keeps a stack of the rules whose intervals are open,
nested into each other, and asks only those for the longest rule whose path begins the url's path.
Rules that are open where a partition begins are those whose key begins its first key; they are
found by a join on the prefixes of that one key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricetrail.session import cut

DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.coalesce(rest, F.lit(""))


def host_key(host: Column | str) -> Column:
    return F.concat(F.reverse(host), F.lit("."))


def _open_prefixes(key: Column) -> Column:
    """The keys whose intervals hold ``key``: its beginnings that end with a dot."""
    parts = F.split(key, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "."), F.lit("."))
    )


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by partition and key, a key's rules before its urls."""
        stack: list[tuple[str, list[tuple[int, int, str, str, str]]]] = []
        part = None
        for batch in batches:
            out: list[tuple] = []
            for p, key, page, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    stack, part = [], p
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if verdict is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((len(host) + len(path), len(host), path, host + path, verdict))
                    continue
                best = max((r for _, rules in stack for r in rules if path.startswith(r[2])), default=None)
                out.append((page, host, path, best[3] if best else None, best[4] if best else default))
            yield pa.RecordBatch.from_pydict(
                {n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(
                    (("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())))}
            )

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` under ``rules`` (``host, path, verdict``).

    The longest rule wins; of equally long ones that with the longer host; of a rule given twice, the
    verdict that sorts last. Reads ``page_id, url``; other columns are not read. A null url, or one
    without ``://``, has an empty host and path and fits no rule of a host; repeated rows stay
    repeated; an url of any length is one value; an empty table gives no rows, and without rules all have the default verdict.
    """
    urls = pages.select("page_id", F.col("url").alias("u")).select("page_id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    of_rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        host_key("host").alias("key"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict"
    )
    rows = of_rules.union(urls.select(host_key("host").alias("key"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The path and the id take part in the ranges, so one very common host fills many partitions.
    dealt = cut(
        rows.withColumn("kind", F.col("verdict").isNull()).repartitionByRange(parts, "key", "kind", "path", "page_id")
        .withColumn("part", F.spark_partition_id())
    )
    opening = (
        dealt.groupBy("part").agg(F.min("key").alias("first"))
        .select("part", "first", F.explode(_open_prefixes(F.col("first"))).alias("key"))
        .join(of_rules, "key")
        # Rules of the first key itself may lie in this partition too; given twice they do no harm.
        .select("part", "key", "page_id", "host", "path", "verdict")
    )
    swept = dealt.select("part", "key", "page_id", "host", "path", "verdict").union(opening)
    return (
        swept.repartition("part").sortWithinPartitions("part", "key", F.col("verdict").isNull(), "path", "page_id")
        .mapInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")
    )


#: The rules the registered query is asked to apply.
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def _oracle() -> str:
    fits = " UNION ALL ".join(
        f"SELECT page_id, rid, host, path, '{h}{p}' AS rule, '{v}' AS verdict, {len(h) + len(p)} AS n, {len(h)} AS hn FROM u "
        f"WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, v in RULES
    )
    return f"""
WITH s AS (
  SELECT page_id, row_number() OVER () AS rid, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), u AS (
  SELECT page_id, rid,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM s
), fit AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY n DESC, hn DESC) AS r FROM ({fits}))
SELECT u.page_id, u.host, u.path, fit.rule, coalesce(fit.verdict, '{DEFAULT}') AS verdict
FROM u LEFT JOIN fit ON u.rid = fit.rid AND fit.r = 1
"""


ORACLE = _oracle()
