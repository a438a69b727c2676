"""The observation store: products upserted, snapshots appended on change."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from pricetrail import schemas as S
from pricetrail.functions import pricing, text
from pricetrail.operators import identity
from pricetrail.operators.history import STATE
from pricetrail.operators.numbering import ranked, with_places
from pricetrail.operators.ordered import Ordered, hot_row_limit
from pricetrail.session import cut


@dataclass(frozen=True)
class StoreResult:
    """``results`` per observation, ``snapshots`` to append, the new ``products`` table and its ``changed`` rows."""

    results: DataFrame
    snapshots: DataFrame
    products: DataFrame
    changed: DataFrame


def normalize_observations(observations: DataFrame, now: Column) -> DataFrame:
    length = S.TEXT_LENGTHS
    return observations.select(
        F.col("seq").cast("bigint").alias("seq"),
        "run_id",
        "queue_id",
        text.trim_nullable(F.col("external_id"), length["external_id"]).alias("external_id"),
        text.trim_required(F.col("name"), length["name"]).alias("name"),
        text.trim_required(F.col("url"), length["url"]).alias("url"),
        text.trim_nullable(F.col("slug"), length["slug"]).alias("slug"),
        F.col("pack_value").cast(S.PACK).alias("pack_value"),
        text.trim_nullable(F.col("pack_unit"), length["pack_unit"]).alias("pack_unit"),
        F.col("price").cast(S.MONEY).alias("price"),
        F.col("old_price").cast(S.MONEY).alias("old_price"),
        F.coalesce("promo_flag", F.lit(False)).alias("promo_flag"),
        F.coalesce("in_stock", F.lit(False)).alias("in_stock"),
        F.coalesce(F.col("observed_at"), now).alias("observed_at"),
    )


def _next_id(df: DataFrame) -> Column:
    return F.coalesce(df.agg(F.max("id") + 1).scalar(), F.lit(1)).cast("bigint")


def store_observations(
    observations: DataFrame,
    products: DataFrame,
    snapshots: DataFrame,
    now: Column | None = None,
    latest: DataFrame | None = None,
    next_snapshot_id: int | None = None,
    hot_rows: int | None = None,
) -> StoreResult:
    """Apply a batch of observations in ``seq`` order (unique).

    New ids are the next free id plus the place of the creating row in the batch, counted
    from zero: they follow arrival and never outgrow the rows that ever arrived. Pass ``latest`` (one newest snapshot per product) and
    ``next_snapshot_id`` to leave the stored history unread.

    The texts of an observation are written once, as they come. Its product is decided by pairs of url and id, and only
    its key, state and times are put in order of arrival and then by product. Places follow from what is written then.
    """
    now = F.current_timestamp() if now is None else now
    arrived = cut(normalize_observations(observations, now))
    owners = identity.owners(arrived, products, hot_rows)
    base = F.lit(next_snapshot_id).cast("bigint") if next_snapshot_id is not None else _next_id(snapshots)
    if latest is None:  # one pass over the history gives both
        latest = cut(newest_with_highest(snapshots.select("product_id", "captured_at", "id", *STATE)))
        if next_snapshot_id is None:
            base = _next_id(latest.select(F.col("max_id").alias("id")))
    rows, ranks = _stored_rows(arrived, owners, latest, hot_rows)

    placed = with_places(rows, ranks, "rank", {"_place": "snapshot_rank", "_first": "first_rank"})
    product = F.coalesce("stored_id", _next_id(products) + F.col("_first"))
    out = placed.where("rank >= 0").select(
        "seq", product.alias("product_id"),
        F.coalesce(base + F.col("_place"), F.when(F.col("snapshot_rank") < 0, F.col("known_id"))).alias("snapshot_id"),
        F.col("stored").alias("snapshot_created"), "run_id", "queue_id", "observed_at", *STATE,
    )
    results = out.select("seq", "product_id", "snapshot_id", "snapshot_created")
    new_snapshots = out.where("snapshot_created").select(
        F.col("snapshot_id").alias("id"), "run_id", "product_id",
        F.col("observed_at").alias("captured_at"), *STATE, "queue_id",
    )
    born = placed.where("born IS NOT NULL AND rank = first_rank").select(
        "born", product.alias("id"), F.col("observed_at").alias("born_at")
    )
    told = _last_told(arrived, owners, born)
    return StoreResult(
        results, new_snapshots, _merged(products, told, "full_outer"), _merged(products, told, "right_outer")
    )


def newest_with_highest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot per product, as one aggregate, with the highest id its product ever had (``max_id``)."""
    rest = [c for c in snapshots.columns if c not in ("product_id", "captured_at", "id")]
    newest = snapshots.groupBy("product_id").agg(
        F.max(F.struct("captured_at", "id", *rest)).alias("newest"), F.max("id").alias("max_id")
    )
    return newest.select("product_id", "newest.*", "max_id")


def _state() -> Column:
    return F.struct(*[F.col(n) for n in STATE])


PRODUCT_KEY = ["stored_id", "born"]


def _sizes(owners: identity.Owners) -> DataFrame:
    """The rows of each product, from the pairs."""
    counted = owners.pairs.select(*PRODUCT_KEY, "rows")
    if owners.open is not None:
        counted = counted.unionByName(owners.open.select(*PRODUCT_KEY, F.lit(1).cast("bigint").alias("rows")))
    return counted.groupBy(*PRODUCT_KEY).agg(F.sum("rows").alias("_n"))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("int"), F.lit(2))


def _truth(code: Column) -> Column:
    return F.when(code < 2, code == 1)


def _stored_rows(
    arrived: DataFrame, owners: identity.Owners, latest: DataFrame, hot_rows: int | None
) -> tuple[DataFrame, DataFrame]:
    """Rows by product and ``rank`` of arrival (the known row has -1): which are stored, and whose snapshot they mean.

    Also the ranks alone. Flags travel as one number: a field of a row costs as much as an amount.
    """
    flags = _flag("promo_flag") * 3 + _flag("in_stock")
    needed = ["seq", "url", "external_id", "run_id", "queue_id", "observed_at", *STATE]
    mine = identity.join_pairs(arrived.select(*needed), owners.pairs.select("url", "external_id", *PRODUCT_KEY))
    if owners.open is not None:
        mine = mine.unionByName(owners.open.select(*needed, *PRODUCT_KEY))
    narrow = mine.select(
        "seq", *PRODUCT_KEY, "run_id", "queue_id", "observed_at", "price", "old_price",
        (flags + F.when(pricing.has_valid_state(
            F.col("url"), F.col("price"), F.col("old_price"), F.col("in_stock")
        ), 9).otherwise(0)).alias("flags"),
    )
    arriving, sizes = ranked(narrow, "seq", "rank"), cut(_sizes(owners))
    if not sizes.where(F.col("_n") > hot_row_limit(arrived, hot_rows)).isEmpty():
        arriving = cut(arriving)  # products that are split are read twice
    known = latest.join(sizes.select(F.col("stored_id").alias("product_id")).distinct(), "product_id", "left_semi").select(
        F.lit(-1).cast("bigint").alias("rank"), F.col("product_id").alias("stored_id"), F.col("id").alias("known_id"),
        F.col("captured_at").alias("observed_at"), "price", "old_price", (flags + 9).alias("flags"),
    )
    both = arriving.unionByName(known, allowMissingColumns=True)
    ordered = Ordered(both, PRODUCT_KEY, ["rank"], hot_rows=hot_rows, sizes=sizes)

    valid, state = F.col("flags") >= 9, F.struct("price", "old_price", "flags")
    ordered = ordered.running(
        last={"before": F.when(valid, state)},
        high={"newest_seen": F.when(valid, F.col("observed_at"))},
    )
    changed = F.col("before").isNull() | ~F.col("before").eqNullSafe(state)
    late = valid & F.coalesce(F.col("observed_at") < F.col("newest_seen"), F.lit(False))
    ordered = ordered.derive({"stored": valid & changed, "late": late})
    ordered = ordered.running(
        last={"snapshot_rank": F.when(F.col("stored"), F.col("rank")), "known_id": F.col("known_id")},
        high={"_back": -F.col("rank")}, inclusive=True,
    ).whole({"unsorted": F.max("late")})
    code = F.col("flags") % 9
    plain = ordered.derive({
        "first_rank": -F.col("_back"), "valid": valid,
        "promo_flag": _truth(F.floor(code / 3)), "in_stock": _truth(code % 3),
    }).result
    rows = cut(plain.drop("before", "newest_seen", "late", "_back", "flags"))
    ranks, unsorted = rows.where("rank >= 0").select("rank"), rows.where("unsorted").drop("unsorted")
    if unsorted.isEmpty():
        return rows.drop("unsorted", "valid"), ranks
    redo = _settle_late(unsorted, sizes, hot_rows)
    return rows.where("NOT unsorted").drop("unsorted").unionByName(redo).drop("valid"), ranks


def _settle_late(rows: DataFrame, sizes: DataFrame, hot_rows: int | None) -> DataFrame:
    """Products with late rows: compare with the stored row that is newest by capture time.

    One sorted pass over each product's rows that holds one stored row. Products above the hot row
    limit are split and settled by rounds.
    """
    hot = sizes.where(F.col("_n") > hot_row_limit(rows, hot_rows)).select(*PRODUCT_KEY)
    if hot.isEmpty():
        return _settle_in_order(rows)
    few = F.broadcast(hot).alias("hot")  # at most rows / limit products
    named = rows.withColumnsRenamed({"stored_id": "_s", "born": "_b"})
    on = F.col("_s").eqNullSafe(F.col("hot.stored_id")) & F.col("_b").eqNullSafe(F.col("hot.born"))
    back = {"_s": "stored_id", "_b": "born"}
    return _settle_in_order(named.join(few, on, "left_anti").withColumnsRenamed(back)).unionByName(
        _settle_by_rounds(named.join(few, on, "left_semi").withColumnsRenamed(back), hot_rows)
    )


#: Products that are decided side by side; fewer are read row by row.
_ABREAST = 16


def decide_in_order(group: np.ndarray, at: np.ndarray, order: np.ndarray, valid: np.ndarray, state: np.ndarray, held: tuple | None) -> tuple:
    """(stored, rank of the snapshot meant or none, newest stored row of the last group) for rows sorted by group and order.

    ``state`` has a column for each part of it. ``held`` is what the first group stored before these rows: (time, order, state).
    The n-th rows of all groups are decided at once; when few groups are left, the rows of each one after another.
    """
    n = len(group)
    stored, meant, none = np.zeros(n, bool), np.zeros(n, np.int64), np.ones(n, bool)
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    lengths = np.diff(np.r_[begins, n])
    turn = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[turn], lengths[turn]
    first, last = int(np.flatnonzero(begins == 0)[0]), int(np.argmax(begins))
    has, best_at, best_order = np.zeros(len(begins), bool), np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
    best_state = np.zeros((len(begins), state.shape[1]), np.int64)
    if held is not None:
        has[first], best_at[first], best_order[first], best_state[first] = True, *held
    step, width = 0, len(begins)
    while True:
        width = int(np.searchsorted(-lengths[:width], -step, "left"))  # the groups with more than ``step`` rows
        if width < _ABREAST:
            break
        i = begins[:width] + step
        keeps = valid[i] & (~has[:width] | (best_state[:width] != state[i]).any(axis=1))
        stored[i], none[i] = keeps, ~(keeps | has[:width])
        meant[i] = np.where(keeps, order[i], best_order[:width])
        newer = keeps & (~has[:width] | (at[i] > best_at[:width]) | ((at[i] == best_at[:width]) & (order[i] > best_order[:width])))
        g = np.flatnonzero(newer)
        has[g], best_at[g], best_order[g], best_state[g] = True, at[i[g]], order[i[g]], state[i[g]]
        step += 1
    for g in range(width):
        span = slice(begins[g] + step, begins[g] + lengths[g])
        best = (int(best_at[g]), int(best_order[g]), tuple(best_state[g].tolist())) if has[g] else None
        lines = zip(range(span.start, span.stop), at[span].tolist(), order[span].tolist(), valid[span].tolist(), map(tuple, state[span].tolist()))
        for i, when, own, good, now in lines:
            keeps = good and (best is None or best[2] != now)
            stored[i], none[i] = keeps, not keeps and best is None
            meant[i] = own if keeps else best[1] if best else 0
            if keeps and (best is None or (when, own) > best[:2]):
                best = (when, own, now)
        if best is not None:
            has[g], best_at[g], best_order[g], best_state[g] = True, *best
    kept = (int(best_at[last]), int(best_order[last]), best_state[last].copy()) if has[last] else None
    return stored, meant, none, kept


def _settle_in_order(rows: DataFrame) -> DataFrame:
    """Only numbers go through Python: amounts in cents, times in microseconds, nulls as the smallest long."""
    nothing = F.lit(-(2**63)).cast("bigint")

    def cents(name: str) -> Column:
        return F.coalesce((F.col(name) * 100).cast("bigint"), nothing)

    micros = F.unix_micros(F.col("observed_at").cast("timestamp"))
    lean = rows.select(
        *PRODUCT_KEY, "seq", "rank", "run_id", "queue_id", micros.alias("_at"), cents("price").alias("_price"), cents("old_price").alias("_old"),
        (_flag("promo_flag") * 3 + _flag("in_stock")).cast("bigint").alias("_flags"), F.coalesce("valid", F.lit(False)).alias("valid"),
        "known_id", "first_rank",
    )
    names = lean.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, held = None, None  # the product of the last row and its stored row that is newest
        for batch in batches:
            if not batch.num_rows:
                continue

            def numbers(name: str) -> np.ndarray:
                return batch.column(names.index(name)).fill_null(-(2**63)).to_numpy(zero_copy_only=False)

            keys = [numbers(k) for k in PRODUCT_KEY]
            new = np.r_[False, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])]
            if product != (keys[0][0], keys[1][0]):
                held = None
            valid = batch.column(names.index("valid")).to_numpy(zero_copy_only=False)
            state = np.stack([numbers(k) for k in ("_price", "_old", "_flags")], axis=1)
            stored, meant, none, held = decide_in_order(np.cumsum(new), numbers("_at"), numbers("rank"), valid, state, held)
            product = keys[0][-1], keys[1][-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(stored), pa.array(meant, mask=none)], [*names, "stored", "snapshot_rank"]
            )

    schema = StructType([*lean.schema.fields, StructField("stored", BooleanType()), StructField("snapshot_rank", LongType())])
    sorted_rows = lean.repartition(*PRODUCT_KEY).sortWithinPartitions(*PRODUCT_KEY, "rank")
    done = sorted_rows.mapInArrow(run, schema)

    def amount(name: str) -> Column:
        return F.when(F.col(name) != nothing, (F.col(name).cast("decimal(20,0)") / 100).cast(S.MONEY))

    at = F.timestamp_micros("_at").cast(rows.schema["observed_at"].dataType)
    made = {
        "observed_at": at, "price": amount("_price"), "old_price": amount("_old"),
        "promo_flag": _truth(F.floor(F.col("_flags") / 3)), "in_stock": _truth(F.col("_flags") % 3),
    }
    return done.select(*[made[c].alias(c) if c in made else F.col(c) for c in rows.columns])


def _settle_by_rounds(current: DataFrame, hot_rows: int | None) -> DataFrame:
    """The same for split products.

    Which rows are stored depends on earlier decisions, so the decision is repeated until
    it stays the same. Every pass settles at least the first undecided row of each product,
    and the only stable outcome is the one-by-one outcome.
    """
    kept = F.struct("observed_at", "rank", *STATE)
    columns = current.columns
    current = cut(current)
    while True:
        ordered = Ordered(current, PRODUCT_KEY, ["rank"], hot_rows=hot_rows).running(
            high={"best": F.when(F.col("stored"), kept)}
        )
        best_state = F.struct(*[F.col(f"best.{n}").alias(n) for n in STATE])
        decided = F.col("valid") & (F.col("best").isNull() | ~best_state.eqNullSafe(_state()))
        nxt = cut(ordered.derive({"decided": decided}).result)
        moved = not nxt.where("decided <> stored").isEmpty()
        if not moved:
            own = F.when(F.col("stored"), F.col("rank")).otherwise(F.col("best.rank"))
            return nxt.withColumn("snapshot_rank", own).select(*columns)
        current = nxt.withColumn("stored", F.col("decided")).drop("best", "decided")


def _last_told(arrived: DataFrame, owners: identity.Owners, born: DataFrame) -> DataFrame:
    """What the batch says of each product; the rows of a pair are combined before they meet their product."""
    order = F.coalesce("seq", F.lit(-(2**63)).cast("bigint"))
    shown = ("name", "slug", "pack_value", "pack_unit", "observed_at")
    pairs = arrived.groupBy("url", "external_id").agg(
        F.max_by(F.struct(*shown), order).alias("shown"), F.max(order).alias("last_seq"),
        F.min_by("observed_at", order).alias("first_at"), F.min(order).alias("first_seq"),
    )
    said = identity.join_pairs(pairs, owners.pairs.select("url", "external_id", *PRODUCT_KEY))
    if owners.open is not None:
        said = said.unionByName(owners.open.select(
            *PRODUCT_KEY, "url", "external_id", F.struct(*shown).alias("shown"), order.alias("last_seq"),
            F.col("observed_at").alias("first_at"), order.alias("first_seq"),
        ))
    told = said.groupBy(*PRODUCT_KEY).agg(
        F.max_by(F.struct("url", "shown"), "last_seq").alias("new"),
        F.max_by("external_id", F.when(F.col("external_id").isNotNull(), F.col("last_seq"))).alias("new_ext"),
        F.min_by("first_at", "first_seq").alias("first_at"),
    )
    return told.join(born, "born", "left").select(
        F.coalesce("stored_id", "id").alias("product_id"), F.col("new.url").alias("url"), "new.shown.*", "new_ext",
        F.coalesce("born_at", "first_at").alias("first_at"),
    )


def _merged(products: DataFrame, told: DataFrame, how: str) -> DataFrame:
    """The product table after the batch; the id is kept when the new one is missing."""
    old, new = products.alias("old"), told.alias("new")
    joined = old.join(new, F.col("old.id") == F.col("product_id"), how)
    seen = F.col("product_id").isNotNull()

    def pick(name: str) -> Column:
        return F.when(seen, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    return joined.select(
        F.coalesce("old.id", "product_id").alias("id"),
        F.coalesce("new_ext", "old.external_id").alias("external_id"),
        pick("name"), pick("url"), pick("slug"), pick("pack_value"), pick("pack_unit"),
        F.coalesce("old.created_at", "first_at").alias("created_at"),
        F.when(seen, F.col("new.observed_at")).otherwise(F.col("old.updated_at")).alias("updated_at"),
    )
