"""Quality rules: repetition and symbol counts of each text, and lines that many documents share.

Normalised lines (words lower-cased over A-Z, one space between) are hashed and counted by host over
distinct documents. A line found in more documents of its host than the limit allows is removed, and
a document that is left with too few of its words is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricetrail.llm.arrays import binary, lowered, steps, sums, words_of, xxh64
from pricetrail.llm.frames import small_or_not, text_batches
from pricetrail.session import cut

MIN_WORDS = 10
#: A document fails if more than this percentage of its words lies in repeated windows.
MAX_REPEATED = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: A line is removed if more distinct documents of its host have it, however large the host is.
LINE_DOCS = 10
#: A document is rejected if less than this share of its words, or fewer than ``MIN_WORDS``, is left.
MIN_LEFT = 0.3

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = (
    "doc_id long, source string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<line:long,words:long>>"
)
_MIX = np.uint64(11400714819323198485)  # any odd number spreads the codes of a window


def _first_of(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each (owner, key) is the first such pair; owners ascend."""
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    out = np.zeros(len(order), dtype=bool)
    out[order] = first
    return out


def _repeated_words(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of its text that the text has twice or more."""
    covered = np.zeros(len(codes), dtype=bool)
    n = len(codes) - WINDOW + 1
    if n < 2:
        return covered
    with np.errstate(over="ignore"):
        key = owner[:n].astype(np.uint64) * _MIX
        for k in range(WINDOW):
            key = (key ^ (key >> np.uint64(29))) * _MIX + codes[k : k + n].astype(np.uint64) + np.uint64(1)
    inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    _, back, count = np.unique(key[inside], return_inverse=True, return_counts=True)
    twice = inside[count[back] > 1]
    for k in range(WINDOW):
        covered[twice + k] = True
    return covered


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line begins and the text it is in; an empty text has none."""
    begins = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1)))
    begins = begins[begins < len(data)]
    return begins, np.searchsorted(offsets, begins, side="right") - 1


def _measured(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    n = part.num_rows
    words = words_of(data, offsets)
    owner, (codes, _) = words.owner(), words.encoded()
    chars = sums((words.data & 0xC0) != 0x80, words.offs[words.first])
    symbols = sums(_IS_SYMBOL[data], offsets)
    repeated = sums(_repeated_words(codes, owner), words.first)
    begins, text_of = _lines(data, offsets)
    # Lines equal to an earlier one, as they are written.
    plain = data != 10
    at = np.concatenate(([0], np.cumsum(plain)))
    line_codes = binary(data[plain], np.append(at[begins], at[-1])).dictionary_encode().indices.to_numpy()
    line_of = np.searchsorted(begins, words.starts, side="right") - 1
    n_in = np.bincount(line_of, minlength=len(begins))
    solid = n_in > 0
    dup = np.bincount(text_of[solid][~_first_of(text_of[solid], line_codes[solid])], minlength=n)
    # Normalised lines, once for each text, with all the words they take there.
    joined, start = _lower_joined(words)
    first_word = np.searchsorted(line_of, np.flatnonzero(solid))
    last_word = np.searchsorted(line_of, np.flatnonzero(solid), side="right") - 1
    hashes = xxh64(joined, start[first_word], start[last_word] + words.lens[last_word] - start[first_word]).view(np.int64)
    owners, weight = text_of[solid], n_in[solid]
    order = np.lexsort((hashes, owners))
    o, h, w = owners[order], hashes[order], weight[order]
    fresh = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])))) if len(o) else np.zeros(0, dtype=np.int64)
    total = np.add.reduceat(w, fresh) if len(fresh) else np.zeros(0, dtype=np.int64)
    bounds = np.searchsorted(o[fresh], np.arange(n + 1))
    lines = pa.ListArray.from_arrays(
        pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(h[fresh]), pa.array(total, pa.int64())], ["line", "words"])
    )
    counts = [np.diff(words.first), chars, symbols, dup, repeated]
    names = part.schema.names
    return pa.RecordBatch.from_arrays(
        [part.column(names.index("doc_id")), part.column(names.index("source")),
         pa.array(xxh64(data, offsets[:-1], np.diff(offsets)).view(np.int64)),
         *[pa.array(c, pa.int64()) for c in counts], lines],
        ["doc_id", "source", "text_hash", *_COUNTS, "lines"],
    )


def _lower_joined(words):
    """The words lower-cased, one space after each, and where each begins."""
    joined, start = words.joined()
    return lowered(joined), start


def measured(docs: DataFrame) -> DataFrame:
    """Counts of each row of ``docs`` and its normalised lines with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches, "text"):
            yield _measured(part, data, offsets)

    return text_batches(docs.select("doc_id", "source", "text")).mapInArrow(run, _SCHEMA)


def frequent_lines(rows: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """``host, line, docs``: lines in more distinct documents of a host than the limit allows.

    Copies of one text are one document: whether they stay is for deduplication to say, not for the
    lines they share with themselves. ``rows`` has ``host, text_hash, lines``.
    """
    return (
        rows.select("host", "text_hash", F.explode("lines.line").alias("line")).distinct()
        .groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > line_docs)
    )


def judged(docs: DataFrame, line_docs: int = LINE_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """Counts, ``base_failed``, ``n_left``, ``removed`` (hashes of removed lines) and ``kept`` of every row.

    Reads ``doc_id, source, text``; other columns are not read. A null or blank text has no words and
    fails; a null source is a host of its own; repeated rows are judged alike and count as one
    document; an empty table gives no rows. A text of any length is read whole, by one task.
    """
    host = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    rows = cut(measured(docs).withColumn("host", host).withColumn("uid", F.monotonically_increasing_id()))
    return _verdicts(rows, cut(frequent_lines(rows, line_docs)), min_left)


def _verdicts(rows: DataFrame, frequent: DataFrame, min_left: float) -> DataFrame:
    gone = (
        rows.select("uid", "host", F.inline("lines")).join(small_or_not(frequent.drop("docs"), 1024), ["host", "line"])
        .groupBy("uid").agg(F.sum("words").alias("gone"), F.sort_array(F.collect_list("line")).alias("removed"))
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    depleted = (left < MIN_WORDS) | (left < min_left * F.col("n_words"))
    return (
        rows.drop("lines").join(gone, "uid", "left")
        .withColumn("base_failed", base).withColumn("n_left", left)
        .withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>")))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
    )


def without_lines(texts: pa.Array, removed: list[set[int]]) -> list[str]:
    """Each text without the lines whose normalised hash is in its set."""
    import xxhash

    out = []
    for text, gone in zip(texts.to_pylist(), removed):
        kept = []
        for line in (text or "").split("\n"):
            words = line.encode().lower().split()
            hashed = xxhash.xxh64_intdigest(b" ".join(words), 42)
            if not words or (hashed - 2**64 if hashed >= 2**63 else hashed) not in gone:
                kept.append(line)
        out.append("\n".join(kept))
    return out


def _rewritten(frame: DataFrame, kind: str) -> DataFrame:
    """``packed, clean`` of rows ``removed, text, packed``: the text without its removed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [set(x or ()) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), _new_texts(batch.column(1), gone)], ["packed", "clean"])

    return frame.mapInArrow(run, f"packed {kind}, clean string")


def _new_texts(text: pa.Array, gone: list[set[int]]) -> pa.Array:
    touched = [i for i, x in enumerate(gone) if x]
    if not touched:
        return text
    new = dict(zip(touched, without_lines(text.take(pa.array(touched)), [gone[i] for i in touched])))
    return pa.array([new.get(i, t) for i, t in enumerate(text.to_pylist())], pa.string())


def _by_held_lines(packed: DataFrame, frequent: DataFrame, kind: str, min_left: float) -> DataFrame:
    """Kept rows where every task holds the frequent lines, so that no text is shuffled."""
    lines: dict[str, list[int]] = {}
    for row in frequent.select("host", "line").collect():  # their number was checked
        lines.setdefault(row["host"], []).append(row["line"])
    shared = packed.sparkSession.sparkContext.broadcast({h: np.sort(np.array(x)) for h, x in lines.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, none = shared.value, np.zeros(0, dtype=np.int64)
        for part, data, offsets in steps(batches, "text"):
            rows = _measured(part, data, offsets)
            column = {n: rows.column(rows.schema.get_field_index(n)) for n in ("n_words", "n_repeat_words", "lines")}
            words, repeated = column["n_words"].to_numpy(), column["n_repeat_words"].to_numpy()
            first = column["lines"].offsets.to_numpy()
            flat_lines = column["lines"].values
            line, weight = flat_lines.field("line").to_numpy(), flat_lines.field("words").to_numpy()
            left, gone = words.copy(), []
            for i, host in enumerate(part.column(part.schema.get_field_index("host")).to_pylist()):
                mine = slice(first[i], first[i + 1])
                out = np.isin(line[mine], held.get(host, none))
                left[i] -= weight[mine][out].sum()
                gone.append(set(line[mine][out].tolist()))
            base = (words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * words)
            kept = np.flatnonzero(~base & (left >= MIN_WORDS) & (left >= min_left * words))
            part = part.take(pa.array(kept))
            clean = _new_texts(part.column(part.schema.get_field_index("text")), [gone[i] for i in kept.tolist()])
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("packed")), clean], ["packed", "clean"])

    return packed.mapInArrow(run, f"packed {kind}, clean string")


#: Frequent lines that every task may hold; their number grows with the table, so it is counted, and
#: beyond this rows meet their lines in joins.
HELD_LINES = 500_000


def cleaned(
    docs: DataFrame, line_docs: int = LINE_DOCS, min_left: float = MIN_LEFT, held_lines: int = HELD_LINES
) -> DataFrame:
    """The kept rows of ``docs`` without the removed lines; ``n_chars``, if there, follows the text.

    Handles nulls, repeated rows and empty tables as ``judged``; other columns stay as they are.
    """
    host = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("host")
    packed = docs.select("doc_id", "source", "text", host, F.struct("*").alias("packed"))
    kind = packed.schema["packed"].dataType.simpleString()
    rows = cut(measured(docs).withColumn("host", host).withColumn("uid", F.monotonically_increasing_id()))
    frequent = cut(frequent_lines(rows, line_docs))
    if frequent.count() <= held_lines:
        done = _by_held_lines(packed, frequent, kind, min_left)
    else:
        key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("k")
        changes = cut(
            _verdicts(rows, frequent, min_left).where("not kept or size(removed) > 0")
            .select(key, "host", "text_hash", "kept", "removed").dropDuplicates(["k", "host", "text_hash"])
        )
        keyed = packed.select(key, "host", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text", "packed")
        both = keyed.join(changes, ["k", "host", "text_hash"], "left").where("coalesce(kept, true)")
        done = _rewritten(both.select("removed", "text", "packed"), kind)
    replaced = {"text": F.col("clean")} | ({"n_chars": F.length("clean").cast("long")} if "n_chars" in docs.columns else {})
    return done.select(*[replaced.get(c, F.col(f"packed.`{c}`")).alias(c) for c in docs.columns])


#: The same rules over the table ``documents`` in SQL.
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce('=' || source, '-') AS host FROM documents
), w AS (
  SELECT *, [x for x in string_split_regex(t, '[\\x20\\x09-\\x0D]+') if x <> ''] AS words FROM d
), win AS (
  SELECT rid, i, list_slice(words, i, i + {WINDOW - 1}) AS g
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - {WINDOW - 2}, 1))) AS i FROM w)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT rid, i, unnest(range(0, {WINDOW})) AS k FROM twice) GROUP BY rid
), l AS (
  SELECT rid, host, t, line, p,
    [x for x in string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] AS lw
  FROM (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d)
), dup AS (
  SELECT rid, count(*) AS n_dup_lines FROM (SELECT rid, row_number() OVER (PARTITION BY rid, line ORDER BY p) AS r FROM l WHERE len(lw) > 0)
  WHERE r > 1 GROUP BY rid
), freq AS (
  SELECT host, lw FROM l WHERE len(lw) > 0 GROUP BY host, lw HAVING count(DISTINCT t) > {LINE_DOCS}
), gone AS (
  SELECT l.rid, sum(len(l.lw)) AS gone FROM l JOIN freq ON l.host = freq.host AND l.lw = freq.lw GROUP BY l.rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in words]), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(words) - coalesce(gone, 0) AS BIGINT) AS n_left
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)
), f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left,
  NOT base_failed AND n_left >= {MIN_WORDS} AND n_left >= {MIN_LEFT} * n_words AS kept
FROM f
"""
