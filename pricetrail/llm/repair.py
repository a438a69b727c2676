"""Conversation repair: the cheapest edits that make roles alternate, found by divide and conquer.

Rows of all conversations are sorted into one order and cut into pieces of consecutive rows, so a very
long conversation is many pieces of many tasks. An automaton of four states reads the roles (nothing
yet, after system, after user, after assistant). Hirschberg's scheme: where a conversation is halved,
the forward costs of the left half (from its entry state to each state) meet the backward costs of the
right half (from each state to its exit state), the cheapest crossing with the least audit is taken and
both halves are solved the same way. The halves' cost vectors come from one pass upwards, as the rows
and columns of 4 x 4 matrices that compose, first within pieces and then over pieces of a conversation,
so memory stays linear in a piece and nothing of a conversation but matrices leaves its pieces.

Ties: an audit fixes the states it passes, and no audit of the same rows that ends in an edit of a row
is the beginning of another, so the order of the four least audits at a border decides every tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricetrail.llm.arrays import ragged, runs
from pricetrail.llm.frames import small_or_not, text_batches
from pricetrail.session import cut

#: Rows of a piece are those with one value of the position without so many bits.
PIECE_BITS = 10
#: Costs of the edits; a truncated row that stays adds one.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Bytes of repaired lines handed on together where a conversation spans pieces.
CHUNK = 1_000_000

_FAR = 1 << 40
#: The state after a row of user or assistant comes in from each state.
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
#: What is inserted after the last row from each state: nothing from the start and after an assistant.
_TAIL = ("", "II", "I", "")
_OTHER = 3
_BLANK = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


class Moves(NamedTuple):
    """Least costs from state to state, and how the least audits to the four exits of an entry compare."""

    cost: np.ndarray
    rank: np.ndarray

    def at(self, index: np.ndarray) -> Moves:
        return Moves(self.cost[index], self.rank[index])


def _row_moves() -> tuple[Moves, list[list[list[str]]]]:
    """For each kind of row (mode * 4 + initial): moves, and the audit of each.

    Modes: 0 fine, 1 truncated, 2 to be deleted. Initials: 0 s, 1 u, 2 a, 3 any other.
    """
    cost, rank = np.full((12, 4, 4), _FAR, dtype=np.int64), np.zeros((12, 4, 4), dtype=np.int64)
    audits = [[[""] * 4 for _ in range(4)] for _ in range(12)]
    for kind in range(12):
        mode, initial = divmod(kind, 4)
        for p in range(4):
            found: dict[int, tuple[int, str]] = {}
            state = p
            for inserted in range(3):
                options = [(state, DELETE, "D")]
                if mode < 2:
                    stays = mode * TRUNCATED
                    options.append((_NEXT[state], REROLE + stays, "R"))
                    if initial == 0 and state == 0:
                        options.append((1, stays, "K"))
                    if initial in (1, 2) and _NEXT[state] == initial + 1:
                        options.append((initial + 1, stays, "K"))
                for q, price, letter in options:
                    found[q] = min(found.get(q, (_FAR, "")), (INSERT * inserted + price, "I" * inserted + letter))
                state = _NEXT[state]
            for q, (price, audit) in found.items():
                cost[kind, p, q], audits[kind][p][q] = price, audit
            order = sorted(range(4), key=lambda q: (q not in found, audits[kind][p][q]))
            rank[kind, p, order] = range(4)
    return Moves(cost, rank), audits


_ROWS, AUDITS = _row_moves()


def compose(a: Moves, b: Moves) -> Moves:
    """The moves of ``a`` and then ``b``, for many pairs at once."""
    total = (a.cost[:, :, :, None] + b.cost[:, None, :, :]) * 4 + a.rank[:, :, :, None]
    through = np.argmin(total, axis=2)
    cost = np.minimum(np.take_along_axis(total, through[:, :, None, :], axis=2)[:, :, 0] >> 2, _FAR)
    first = np.take_along_axis(a.rank, through, axis=2)
    second = np.take_along_axis(b.rank, through, axis=1)
    rank = np.argsort(np.argsort(first * 4 + second, axis=2, kind="stable"), axis=2)
    return Moves(cost, rank)


def halves(moves: Moves, lens: np.ndarray) -> list[tuple[Moves, np.ndarray]]:
    """Level by level the moves of all nested halves of consecutive runs of ``lens`` moves."""
    levels = [(moves, lens)]
    while len(lens) and lens.max() > 1:
        first = np.cumsum(lens) - lens
        up = (lens + 1) // 2
        within = ragged(np.zeros(len(up), dtype=np.int64), up)
        left = np.repeat(first, up) + 2 * within
        pair = 2 * within + 1 < np.repeat(lens, up)
        cost, rank = moves.cost[left], moves.rank[left]
        both = compose(moves.at(left[pair]), moves.at(left[pair] + 1))
        cost[pair], rank[pair] = both
        moves, lens = Moves(cost, rank), up
        levels.append((moves, lens))
    return levels


def cross(levels: list[tuple[Moves, np.ndarray]], entry: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and exit state of every single move, given those of each run: crossings chosen half by half."""
    for (moves, lens), (_, up) in zip(levels[-2::-1], levels[:0:-1]):
        within = ragged(np.zeros(len(up), dtype=np.int64), up)
        left = np.repeat(np.cumsum(lens) - lens, up) + 2 * within
        pair = 2 * within + 1 < np.repeat(lens, up)
        a, p, q = left[pair], entry[pair], leave[pair]
        forward, backward = moves.cost[a, p], moves.cost[a + 1, :, q]
        middle = np.argmin((forward + backward) * 4 + moves.rank[a, p], axis=1)
        new_entry, new_leave = np.empty(int(lens.sum()), dtype=np.int64), np.empty(int(lens.sum()), dtype=np.int64)
        new_entry[left], new_leave[left] = entry, leave
        new_leave[a] = middle
        new_entry[a + 1], new_leave[a + 1] = middle, q
        entry, leave = new_entry, new_leave
    return entry, leave


def final_states(moves: Moves) -> np.ndarray:
    """The state in which each whole conversation ends, from the start state."""
    tails = np.array([INSERT * len(t) for t in _TAIL])
    return np.argmin((moves.cost[:, 0] + tails) * 4 + moves.rank[:, 0], axis=1)


def damaged(conversations: DataFrame) -> DataFrame:
    """The test damage: by crc32 of ``conv_id:turn`` rows are dropped, emptied, cut, repeated or given to the user."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(name.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("damage")).where("damage <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, F.lit(""))
        .when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _key(conv_id: Column | str) -> Column:
    return F.coalesce(F.col(conv_id).cast("string"), F.lit(" "))


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` in one order with their position ``pos``, checked for faults except repetition, written once."""
    text = F.md5("text")
    keyed = rows.select("conv_id", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())
    by = ["conv_id", "turn", "role", text, "at"]
    placed = keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id())
    initial = F.substring("role", 1, 1)
    return cut(placed.select(
        "pos", _key("conv_id").alias("conv"), "conv_id", "turn", "role", "text",
        F.unhex(F.md5(F.concat(_key("conv_id"), F.lit(":"), F.md5("role"), F.col("text")))).alias("said"),
        (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(_OTHER)).cast("byte").alias("initial"),
        (~F.col("text").rlike(_BLANK)).alias("blank"), (~F.col("text").rlike(_ENDED)).alias("truncated"),
    ))


def _judged(rows: DataFrame) -> DataFrame:
    """``pos, conv, kind, fault`` (0 none, 1 truncated, 2 blank, 3 duplicate) of every row, without texts."""
    again = (
        rows.where("not blank").groupBy("said").agg(F.count("*").alias("m"), F.min("pos").alias("first"))
        .where("m > 1").select("said", "first")
    )
    marked = rows.select("pos", "conv", "said", "initial", "blank", "truncated").join(small_or_not(cut(again), 64), "said", "left")
    fault = (
        F.when(F.col("blank"), 2).when(F.col("pos") > F.col("first"), 3).when(F.col("truncated"), 1).otherwise(0)
    )
    return marked.select(
        "pos", "conv", fault.cast("byte").alias("fault"),
        (F.least(fault, F.lit(2)) * 4 + F.col("initial")).cast("byte").alias("kind"),
    )


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _list(values: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


def _unlist(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(-1, 4, 4)


_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal")
_SEGMENT = "conv string, node long, start long, cost array<long>, rank array<long>, first byte, last byte, " + ", ".join(f"{c} long" for c in _COUNTS)


def _illegal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether initials ``a`` and ``b`` may not follow each other."""
    return ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))


def _segments(rows: DataFrame) -> DataFrame:
    """One row for each conversation in each piece: its moves, counts and the kinds of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, lambda b: _column(b, "pos") >> PIECE_BITS):
            pos, conv = _column(batch, "pos"), _column(batch, "conv")
            kind, fault = _column(batch, "kind").astype(np.int64), _column(batch, "fault")
            piece = pos >> PIECE_BITS
            begin = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (conv[1:] != conv[:-1]))))
            lens = np.diff(np.append(begin, len(pos)))
            top, _ = halves(_ROWS.at(kind), lens)[-1]
            initial = (kind & 3).astype(np.int8)
            wrong = np.concatenate((_illegal(initial[:-1], initial[1:]), [False])).astype(np.int64)
            wrong[begin[1:] - 1] = 0
            add = lambda v: pa.array(np.add.reduceat(v.astype(np.int64), begin))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("conv")).take(pa.array(begin)), pa.array(piece[begin]), pa.array(pos[begin]),
                 _list(top.cost, 16), _list(top.rank, 16), pa.array(initial[begin]), pa.array(initial[begin + lens - 1]),
                 pa.array(lens), add(fault == 2), add(fault == 3), add(fault == 1), pa.array(np.add.reduceat(wrong, begin)),
                 pa.ListArray.from_arrays(pa.array(np.append(begin, len(pos)), pa.int32()), pa.array(kind.astype(np.int8)))],
                ["conv", "node", "start", "cost", "rank", "first", "last", *_COUNTS, "kinds"],
            )

    piece = F.shiftright("pos", PIECE_BITS)
    dealt = rows.repartition(piece).sortWithinPartitions("pos")
    return dealt.mapInArrow(run, f"{_SEGMENT}, kinds array<byte>")


def _groups(batch: pa.RecordBatch, shift: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of segments begins, and how many it has: by conversation, and by node unless ``shift`` is None."""
    conv, node = _column(batch, "conv"), _column(batch, "node")
    new = conv[1:] != conv[:-1]
    if shift is not None:
        new = new | ((node[1:] >> shift) != (node[:-1] >> shift))
    begin = np.flatnonzero(np.concatenate(([True], new)))
    return begin, np.diff(np.append(begin, len(conv)))


def _sorted_groups(nodes: DataFrame, shift: int | None) -> DataFrame:
    by = ["conv"] if shift is None else ["conv", F.shiftright("node", shift)]
    return nodes.repartition(*by).sortWithinPartitions("conv", "start")


def _folded(nodes: DataFrame, shift: int | None) -> DataFrame:
    """Nodes with one number after ``shift`` become one node of the next level; None: all of a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, lambda b: _column(b, "conv")):
            begin, lens = _groups(batch, shift)
            top, _ = halves(Moves(_unlist(batch, "cost"), _unlist(batch, "rank")), lens)[-1]
            first, last = _column(batch, "first"), _column(batch, "last")
            between = np.concatenate((_illegal(last[:-1], first[1:]), [False])).astype(np.int64)
            between[begin[1:] - 1] = 0
            add = lambda v: pa.array(np.add.reduceat(v, begin))
            counts = {c: _column(batch, c) for c in _COUNTS}
            counts["illegal"] = counts["illegal"] + between
            node = _column(batch, "node")[begin]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(begin)), pa.array(node >> shift if shift is not None else node), pa.array(_column(batch, "start")[begin]),
                 _list(top.cost, 16), _list(top.rank, 16), pa.array(first[begin]), pa.array(last[begin + lens - 1]), *(add(counts[c]) for c in _COUNTS)],
                ["conv", "node", "start", "cost", "rank", "first", "last", *_COUNTS],
            )

    plain = nodes.select("conv", "node", "start", "cost", "rank", "first", "last", *_COUNTS)
    return _sorted_groups(plain, shift).mapInArrow(run, _SEGMENT)


def _unfolded(nodes: DataFrame, states: DataFrame, shift: int | None) -> DataFrame:
    """``start, entry, leave, spans`` of every node, from those of the nodes they were folded into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, lambda b: _column(b, "conv")):
            begin, lens = _groups(batch, shift)
            levels = halves(Moves(_unlist(batch, "cost"), _unlist(batch, "rank")), lens)
            entry, leave = cross(levels, _column(batch, "entry")[begin].astype(np.int64), _column(batch, "leave")[begin].astype(np.int64))
            spans = np.repeat(lens > 1, lens) | np.repeat(_column(batch, "spans")[begin].astype(bool), lens)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("start")), pa.array(entry.astype(np.int8)), pa.array(leave.astype(np.int8)), pa.array(spans)],
                ["start", "entry", "leave", "spans"],
            )

    up = F.lit(0) if shift is None else F.shiftright("node", shift)
    parents = states.select("conv", F.col("node").alias("up"), "entry", "leave", "spans")
    # Only the first node of a group needs the states, but all of a group meet in one task anyway.
    met = nodes.select("conv", "node", "start", "cost", "rank", up.cast("long").alias("up")).join(parents, ["conv", "up"])
    return _sorted_groups(met.select("conv", "node", "start", "cost", "rank", "entry", "leave", "spans"), shift).mapInArrow(
        run, "start long, entry byte, leave byte, spans boolean"
    )


def _ended(whole: DataFrame) -> DataFrame:
    """Conversations with the state they end in and the cost of their edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails = np.array([INSERT * len(t) for t in _TAIL])
        for batch in batches:
            moves = Moves(_unlist(batch, "cost"), _unlist(batch, "rank"))
            end = final_states(moves)
            price = moves.cost[np.arange(len(end)), 0, end] + tails[end]
            names = [c for c in batch.schema.names if c not in ("cost", "rank")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(end.astype(np.int8)), pa.array(price)], [*names, "leave", "price"]
            )

    kinds = _SEGMENT.replace("cost array<long>, rank array<long>, ", "") + ", leave byte, price long"
    return whole.mapInArrow(run, kinds)


def _moves(segments: DataFrame, states: DataFrame) -> DataFrame:
    """``piece, kinds, moves`` of the rows of a piece; a move is entry * 4 + exit, and 16 more where the conversation spans pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, lambda b: _column(b, "node")):
            kinds = batch.column(batch.schema.get_field_index("kinds"))
            lens = np.diff(kinds.offsets.to_numpy()).astype(np.int64)
            kind = kinds.flatten().to_numpy().astype(np.int64)
            levels = halves(_ROWS.at(kind), lens)
            entry, leave = cross(levels, _column(batch, "entry").astype(np.int64), _column(batch, "leave").astype(np.int64))
            move = entry * 4 + leave + 16 * np.repeat(_column(batch, "spans").astype(np.int64), lens)
            node = _column(batch, "node")
            begin = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            ends = np.append(np.concatenate(([0], np.cumsum(lens)))[begin], len(move))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v.astype(np.int8))) for v in (kind, move)]
            yield pa.RecordBatch.from_arrays([pa.array(node[begin]), *lists], ["piece", "kinds", "moves"])

    met = segments.select("node", "start", "kinds").join(states, "start")
    return met.repartition("node").sortWithinPartitions("node", "start").mapInArrow(run, "piece long, kinds array<byte>, moves array<byte>")


def _lines(kind: int, move: int, role: str, text: str) -> tuple[str, list[str]]:
    """The audit of one row and the lines it leaves."""
    state, end = divmod(move & 15, 4)
    audit = AUDITS[kind][state][end]
    out = []
    for letter in audit:
        if letter != "D":
            state = _NEXT[state] if letter != "K" else end
            out.append(f"{role if letter == 'K' else _ROLE[state]}:{'' if letter == 'I' else text}")
    return audit, out


def _tail(state: int) -> tuple[str, list[str]]:
    out = []
    for _ in _TAIL[state]:
        state = _NEXT[state]
        out.append(f"{_ROLE[state]}:")
    return "I" * len(out), out


_PART = "conv string, at long, whole boolean, leave byte, audit string, sha string, lines binary"


def _repaired(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Repaired conversations that lie in one piece; of others the repaired lines in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        held, audit, lines, size = None, [], [], 0  # (conv, piece), its first position, whether it spans, its last state

        def close(ends: bool) -> None:
            nonlocal audit, lines, size
            (conv, _), at, spans, state = held
            if spans:
                done.append((conv, at, False, state, "".join(audit), None, "\n".join(lines).encode()))
            elif ends:
                more, rest = _tail(state)
                done.append((conv, at, True, state, "".join(audit) + more, hashlib.sha256("\n".join(lines + rest).encode()).hexdigest(), None))
            audit, lines, size = [], [], 0

        for batch in batches:
            for pos, conv, role, text, kind, move in zip(*(batch.column(i).to_pylist() for i in range(6))):
                mine = (conv, pos >> PIECE_BITS)
                if held is not None and (held[0] != mine or (held[2] and size > CHUNK)):
                    close(True)
                    held = None
                if held is None:
                    held = (mine, pos, move >= 16, 0)
                letters, out = _lines(kind, move, role, text)
                audit.append(letters)
                lines += out
                size += sum(map(len, out))
                held = (*held[:3], move & 3)
            yield _batch(done, _PART)
            done.clear()
        if held is not None:
            close(True)
            yield _batch(done, _PART)

    piece = F.shiftright("pos", PIECE_BITS).alias("piece")
    texts = rows.select("pos", "conv", "role", "text", piece)
    at = (F.col("pos").bitwiseAND((1 << PIECE_BITS) - 1) + 1).cast("int")
    picked = texts.join(moves, "piece").select(
        "pos", "conv", "role", "text", F.element_at("kinds", at).cast("int").alias("kind"), F.element_at("moves", at).cast("int").alias("move"), "piece"
    )
    return text_batches(picked.repartition("piece").sortWithinPartitions("pos").drop("piece")).mapInArrow(run, _PART)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "byte": pa.int8(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


def _joined(parts: DataFrame) -> DataFrame:
    """``conv, audit, sha`` of conversations that span pieces: their chunks pass one after another."""
    schema = "conv string, audit string, sha string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, digest, state, any_line = None, [], None, 0, False

        def close() -> pa.RecordBatch:
            more, rest = _tail(state)
            for line in rest:
                digest.update(("\n" if any_line else "").encode() + line.encode())
            return _batch([(conv, "".join(audit) + more, digest.hexdigest())], schema)

        for batch in batches:
            for name, letters, lines, leave in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if name != conv:
                    if conv is not None:
                        yield close()
                    conv, audit, digest, any_line = name, [], hashlib.sha256(), False
                audit.append(letters)
                if lines:
                    digest.update((b"\n" if any_line else b"") + lines)
                    any_line = True
                state = leave
        if conv is not None:
            yield close()

    chunks = parts.where("not whole").select("conv", "audit", "lines", "leave", "at")
    return text_batches(chunks.repartition("conv").sortWithinPartitions("conv", "at").drop("at")).mapInArrow(run, schema)


def repaired(rows: DataFrame, fan: int = 1024) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` by conversation.

    ``rows`` are ``conv_id, turn, role, text``; other columns are not read. Null roles and texts read as one
    space; a null ``conv_id`` is a conversation of its own. Rows go by turn, nulls first; within a turn by
    role and the text's hash; repeated rows follow each other and are duplicates. A role whose initial is
    none of s, u and a can't be kept. An empty table gives no rows. Texts of any length are read whole; a
    text is one value of one row. A very long conversation is cut into pieces in all steps but one: its
    digest is a chain by definition, so its repaired lines pass one task in order, a chunk at a time, and
    its audit is one value of the result. More than ``fan`` pieces of a conversation are folded level by
    level; the result is the same.
    """
    given = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    placed = _ordered(given)
    judged = cut(_judged(placed))
    segments = cut(_segments(judged))
    levels: list[tuple[DataFrame, int | None]] = []
    nodes, shift = segments, fan.bit_length() - 1
    while (nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > fan:
        levels.append((nodes, shift))
        nodes = cut(_folded(nodes, shift))
    levels.append((nodes, None))
    whole = cut(_ended(_folded(nodes, None)))
    states = whole.select("conv", F.lit(0).cast("long").alias("node"), F.lit(0).cast("byte").alias("entry"), "leave", F.lit(False).alias("spans"))
    for below, by in reversed(levels):
        found = _unfolded(below, states, by)
        # Where nodes were folded again, the states of one level name the parents of the next.
        states = cut(below.select("conv", "node", "start").join(found, "start"))
    parts = cut(_repaired(placed, _moves(segments, states.select("start", "entry", "leave", "spans"))))
    audits = parts.where("whole").select("conv", "audit", "sha").unionByName(_joined(parts))
    turns = placed.groupBy("conv").agg(
        F.first("conv_id", ignorenulls=True).alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    return turns.join(whole, "conv").join(audits, "conv").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("price").alias("cost"), "audit", F.col("sha").alias("repaired_sha256")
    )


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """What ``repaired`` makes of the test damage, with a row for conversations of which nothing is left."""
    found = repaired(damaged(conversations))
    every = conversations.select("conv_id", _key("conv_id").alias("conv")).dropDuplicates(["conv"])
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing = hashlib.sha256(b"").hexdigest()
    return every.join(found.withColumn("conv", _key("conv_id")).drop("conv_id"), "conv", "left").select(
        "conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )
