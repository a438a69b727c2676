"""Mixing sources to target weights by weighted pivotal rounding.

A source's target over its size is the expected number of copies of each of its documents. The whole
part is taken as it is. The fractional parts are rounded against each other: of two documents one
gains words and the other loses as many, at random and without bias, until one of them has a whole
number of copies. Each group of such steps leaves one document undecided at most; the undecided ones
of many groups meet at the next level of a tree, until one is left for each source. So the words
taken of a source differ from its target by less than one document. Only DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricetrail.llm.frames import small_or_not, unit
from pricetrail.session import cut

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes.
SHARE = 1.5
#: A source gives at most so many times its words.
MOST = 2.0
#: Documents rounded against each other in one group, on average.
FAN = 64
SEED = 20
#: Masses this near a whole number are whole.
_EPS = 1e-9

_UNIT = "struct<doc_id:bigint,size:bigint,n:bigint,base:bigint,p:double>"


def word_count(text: Column | str) -> Column:
    """Runs of characters other than space and 0x09 to 0x0D; null counts zero."""
    words = F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, units, target`` from ``source, source_size, units``: one row a source.

    Sources are ranked by code point, null last. Weighted shares above ``most`` times a source's size
    are cut there; the ones cut are those with the smallest cap for their weight, so one running sum
    in that order finds the level that the others share. The table has one row a source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    order = W.orderBy("ratio", "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    level = (
        ranked.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    )
    # The first source, in this order, whose cap is not below the level ends the capped ones.
    first = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return level.withColumn("level", first).select(
        "source", "source_size", "units",
        F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"),
    )


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold(seed: int):
    """One step: the undecided document against the next; the decided ones are appended to ``out``."""

    def decided(u: Column, p: Column) -> Column:
        return F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["n"].alias("n"), (u["base"] + p.cast("long")).alias("copies"))

    def kept(u: Column, p: Column) -> Column:
        return F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["n"].alias("n"), u["base"].alias("base"), p.alias("p"))

    def clean(p: Column) -> Column:
        return F.when(p < _EPS, 0.0).when(p > 1 - _EPS, 1.0).otherwise(p)

    def whole(p: Column) -> Column:
        return (p == 0.0) | (p == 1.0)

    def step(acc: Column, b: Column) -> Column:
        a = acc["left"]

        def moved(m: Column) -> Column:
            up = m["u"] * (m["up"] + m["down"]) < m["down"]
            return F.struct(
                clean(F.when(up, a["p"] + m["up"] / a["size"]).otherwise(a["p"] - m["down"] / a["size"])).alias("a"),
                clean(F.when(up, b["p"] - m["up"] / b["size"]).otherwise(b["p"] + m["down"] / b["size"])).alias("b"),
            )

        def settled(r: Column) -> Column:
            none = F.lit(None).cast(_UNIT)
            done = F.filter(
                F.array(F.when(whole(r["a"]), decided(a, r["a"])), F.when(whole(r["b"]), decided(b, r["b"]))),
                lambda x: x.isNotNull(),
            )
            left = F.when(~whole(r["a"]), kept(a, r["a"])).when(~whole(r["b"]), kept(b, r["b"])).otherwise(none)
            return F.struct(left.alias("left"), F.concat(acc["out"], done).alias("out"))

        masses = F.struct(
            F.least((1 - a["p"]) * a["size"], b["p"] * b["size"]).alias("up"),
            F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"]).alias("down"),
            unit(a["doc_id"], a["size"], b["doc_id"], b["size"], seed=seed).alias("u"),
        )
        paired = _let(_let(masses, moved), settled)
        return F.when(a.isNull(), F.struct(kept(b, b["p"]).alias("left"), acc["out"].alias("out"))).otherwise(paired)

    return step


def _level(units: DataFrame, seed: int) -> DataFrame:
    """Groups of ``source, node`` rounded inside: ``out`` is decided, ``left`` is not."""
    start = F.struct(
        F.lit(None).cast(_UNIT).alias("left"),
        F.array().cast("array<struct<doc_id:bigint,size:bigint,n:bigint,copies:bigint>>").alias("out"),
    )
    return (
        units.groupBy("source", "node", "source_size", "target")
        .agg(F.sort_array(F.collect_list(F.struct("h", "unit"))).alias("units"))
        .withColumn("acc", F.aggregate("units", start, lambda acc, x: _fold(seed)(acc, x["unit"])))
        .select("source", "node", "source_size", "target", "acc.left", "acc.out")
    )


def mix_counts(
    units: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
    seed: int = SEED, fan: int = FAN,
) -> DataFrame:
    """``source, doc_id, size, n, copies, source_size, target`` from rows ``source, doc_id, size``.

    ``n`` equal rows share ``copies`` copies. The choice depends on the rows and the seed only.
    """
    units = cut(units.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    targets = cut(source_targets(sizes, weights, share, most))
    largest = targets.agg(F.max("units")).first()[0] or 0
    nodes = F.greatest(F.ceil(F.col("units") / fan), F.lit(1)).cast("long")
    mass = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("n")
    joined = (
        units.join(small_or_not(targets.withColumnRenamed("source", "s"), 1024), units["source"].eqNullSafe(F.col("s")))
        .withColumn("mass", mass)
        .withColumn("base", F.floor(F.col("mass") + _EPS))
        .withColumn("p", F.col("mass") - F.col("base"))
        .withColumn("p", F.when(F.col("p") < _EPS, 0.0).otherwise(F.col("p")))
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size"))
        .withColumn("node", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), nodes))
    )
    columns = ("source", "doc_id", "size", "n", "copies", "source_size", "target")
    # A document without words moves no mass: its own chance decides.
    free = (F.col("size") == 0) | (F.col("p") == 0.0)
    alone = (F.col("base") + (unit("doc_id", seed=seed + 2) < F.col("p")).cast("long")).alias("copies")
    done = [joined.where(free).select("source", "doc_id", "size", "n", alone, "source_size", "target")]
    level = joined.where(~free).select(
        "source", "node", "source_size", "target", "h", F.struct("doc_id", "size", "n", "base", "p").alias("unit")
    )
    width, depth = -(-largest // fan), 0
    while True:
        rounded = cut(_level(level, seed + 10 + depth))
        done.append(rounded.select("source", "source_size", "target", F.inline("out")).select(*columns))
        left = rounded.where("left is not null")
        if width <= 1:
            root = unit("left.doc_id", "left.size", seed=seed + 3) < F.col("left.p")
            done.append(left.select(
                "source", "left.doc_id", "left.size", "left.n",
                (F.col("left.base") + root.cast("long")).alias("copies"), "source_size", "target",
            ))
            break
        width, depth = -(-width // fan), depth + 1
        level = left.select(
            "source", F.floor(F.col("node") / fan).alias("node"), "source_size", "target",
            F.xxhash64("left.doc_id", "left.size").alias("h"), F.col("left").alias("unit"),
        )
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def _each_row(counts: DataFrame) -> DataFrame:
    """One row for each of the ``n`` equal rows, which share the copies as evenly as can be."""
    return (
        counts.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .withColumn("copies", F.floor(F.col("copies") / F.col("n")) + (F.col("row") <= F.col("copies") % F.col("n")).cast("long"))
    )


def mix_plan(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row of ``docs``.

    Reads ``doc_id, text, source``; other columns are not read. A null or blank text has size zero
    and takes no words; a null source is a source of its own, the last; equal rows share their
    copies as evenly as can be; an empty table gives no rows. A text of any length only counts its words.
    """
    counts = mix_counts(docs.select("source", "doc_id", word_count("text").alias("size")), **how)
    return _each_row(counts).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def _row_key(doc_id: str, size: str, source: str) -> Column:
    """One text for id, size and source, nulls told apart: the join and the window share its partitioning."""
    return F.concat_ws(
        "|", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.col(size).cast("string"), F.coalesce(F.concat(F.lit("="), source), F.lit("-"))
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns, as often as the plan takes it.

    Handles nulls, equal rows and empty tables as ``mix_plan``; extra columns stay, whatever their names.
    """
    packed = docs.select(
        F.col("source").alias("s"), F.col("doc_id").alias("d"), word_count("text").alias("z"), F.struct("*").alias("packed"),
    )
    units = packed.select(F.col("s").alias("source"), F.col("d").alias("doc_id"), F.col("z").alias("size"))
    counts = mix_counts(units, **how).select(
        _row_key("doc_id", "size", "source").alias("key"), "n", "copies"
    )
    row = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("packed")))
    both = packed.select(_row_key("d", "z", "s").alias("key"), "packed").withColumn("k", row).join(counts.where("copies > 0"), "key")
    mine = F.floor(F.col("copies") / F.col("n")) + (F.col("k") <= F.col("copies") % F.col("n")).cast("long")
    again = F.explode(F.array_repeat(F.lit(0), mine.cast("int")))
    return both.select("packed", again).select("packed.*")
