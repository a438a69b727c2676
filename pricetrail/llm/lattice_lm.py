"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary are the symbols of a unigram model. Its weights start from the
vocabulary's own order and are fitted to the training words by a few rounds of expected counts; all
segmentations of a word count, by forward and backward recursion in log space. A text's probability
is the product over its words, each with a space before it, and one end. Beside it stands a plain
word model with add-one counts. Words are counted over all training documents; each distinct word is
scored once, and documents meet the scores of all but the commonest words in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricetrail.llm.arrays import lowered, once, ragged, steps, sums, words_of
from pricetrail.llm.frames import text_batches
from pricetrail.llm.pieces import Vocabulary, load, match
from pricetrail.session import cut

ROUNDS = 2
#: Commonest words whose counts and scores every task holds; at most so many, and none longer than this.
COMMON = 50_000
COMMON_BYTES = 64
#: Bytes of text whose distinct words are counted together.
TEXT_BYTES = 16_000_000
#: Characters of distinct words in one lattice.
LATTICE_CHARS = 400_000
#: What every piece counts as before any text is seen.
SMOOTH = 0.1
_SPACE = ord("▁")


def _vocabulary(path: str) -> Vocabulary:
    return once(f"vocabulary {path}", lambda: load(path))


@dataclass
class Lattice:
    """Edges between character places of many words, those that end first in their word come first.

    ``piece`` is a row of the vocabulary; from ``len(pieces)`` on it is a character spelt by its bytes.
    """

    nodes: np.ndarray  # first node of each word, and the end
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    steps: np.ndarray  # slices of edges by their end's place in its word
    lost: np.ndarray  # characters that no piece spells, by piece number


def lattice(data: np.ndarray, offs: np.ndarray, vocabulary: Vocabulary) -> Lattice:
    """The lattice of words given as bytes and offsets, each read with a space before it."""
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead)))[offs]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    n = len(offs) - 1
    lens = np.diff(chars) + 1
    nodes = np.concatenate(([0], np.cumsum(lens + 1)))
    # One more place than characters for each word: a border that no piece crosses, and the end node.
    text = np.full(nodes[-1], 0x110000, dtype=np.int64)
    text[nodes[:-1]] = _SPACE
    text[ragged(nodes[:-1] + 1, lens - 1)] = points
    begin, size, piece = match(text, vocabulary)
    spelt = np.zeros(len(text), dtype=bool)
    spelt[begin[size == 1]] = True
    bare = np.flatnonzero(~spelt & (text < 0x110000))
    lost, which = np.unique(text[bare], return_inverse=True)
    begin = np.concatenate((begin, bare))
    end = np.concatenate((begin[: len(size)] + size, bare + 1))
    piece = np.concatenate((piece, len(vocabulary.lens) + which))
    place = end - np.repeat(nodes[:-1], np.diff(nodes))[end]
    order = np.lexsort((end, place))
    begin, end, piece, place = begin[order], end[order], piece[order], place[order]
    return Lattice(nodes, begin, end, piece, np.searchsorted(place, np.arange(1, (place[-1] if len(place) else 0) + 2)), lost)


def _reduce(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Log of summed exponentials of the parts that begin at ``heads``."""
    top = np.maximum.reduceat(values, heads)
    part = np.exp(values - np.repeat(top, np.diff(np.append(heads, len(values)))))
    return top + np.log(np.add.reduceat(part, heads))


def _heads(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))


def forward(net: Lattice, weight: np.ndarray) -> np.ndarray:
    """Log probability of reaching each node from its word's first."""
    alpha = np.full(net.nodes[-1], -np.inf)
    alpha[net.nodes[:-1]] = 0.0
    for a, b in zip(net.steps[:-1], net.steps[1:]):
        heads = _heads(net.end[a:b])
        alpha[net.end[a:b][heads]] = _reduce(alpha[net.begin[a:b]] + weight[a:b], heads)
    return alpha


def backward(net: Lattice, weight: np.ndarray) -> np.ndarray:
    """Log probability of reaching its word's last node from each node."""
    first = np.repeat(net.nodes[:-1], np.diff(net.nodes))
    order = np.lexsort((net.begin, first[net.begin] - net.begin))  # farthest into its word first
    begin, end, weight = net.begin[order], net.end[order], weight[order]
    beta = np.full(net.nodes[-1], -np.inf)
    beta[net.nodes[1:] - 1] = 0.0
    cuts = np.append(_heads(begin - first[begin]), len(begin)) if len(begin) else np.zeros(1, dtype=np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        heads = _heads(begin[a:b])
        beta[begin[a:b][heads]] = _reduce(beta[end[a:b]] + weight[a:b], heads)
    return beta


class Model:
    """Natural-log weights of the pieces, of the bytes and of the end of a text."""

    def __init__(self, counts: np.ndarray, ends: float, vocabulary: Vocabulary) -> None:
        """``counts``: of the pieces by row, then of the 256 bytes."""
        smooth = counts + SMOOTH
        total = np.log(smooth.sum() + ends + SMOOTH)
        self.pieces = np.log(smooth[: len(vocabulary.lens)]) - total
        self.bytes = np.log(smooth[len(vocabulary.lens) :]) - total
        self.end = float(np.log(ends + SMOOTH) - total)

    @classmethod
    def start(cls, vocabulary: Vocabulary, tokens: float, ends: float) -> Model:
        """Weights that fall with the vocabulary's order; bytes weigh as its last piece."""
        rank = vocabulary.order.astype(np.float64) + 1
        share = np.concatenate((1 / (rank + 10), np.full(256, 1 / (rank.max() + 10))))
        return cls(share / share.sum() * max(tokens, 1.0), ends, vocabulary)

    def weights(self, net: Lattice) -> np.ndarray:
        spelt = np.array([sum(self.bytes[b] for b in chr(int(c)).encode()) for c in net.lost])
        return np.concatenate((self.pieces, spelt))[net.piece]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part, data, offs in steps(batches, "word", LATTICE_CHARS):
        yield part, data, offs


def word_scores(data: np.ndarray, offs: np.ndarray, model: Model, vocabulary: Vocabulary) -> np.ndarray:
    """Natural-log marginal probability of each word with a space before it."""
    net = lattice(data, offs, vocabulary)
    return forward(net, model.weights(net))[net.nodes[1:] - 1]


def expected_counts(data: np.ndarray, offs: np.ndarray, times: np.ndarray, model: Model, vocabulary: Vocabulary) -> np.ndarray:
    """Expected uses of each piece, then of each byte, in words that occur ``times``."""
    net = lattice(data, offs, vocabulary)
    weight = model.weights(net)
    alpha, beta = forward(net, weight), backward(net, weight)
    word = np.repeat(np.arange(len(times)), np.diff(net.nodes))[net.begin]
    share = np.exp(alpha[net.begin] + weight + beta[net.end] - alpha[net.nodes[1:] - 1][word]) * times[word]
    n = len(vocabulary.lens)
    counts = np.bincount(net.piece, weights=share, minlength=n + len(net.lost))
    spelt = np.zeros(256)
    for c, value in zip(net.lost, counts[n:]):
        for b in chr(int(c)).encode():
            spelt[b] += value
    return np.concatenate((counts[:n], spelt))


def count_words(docs: DataFrame, learned: Column) -> DataFrame:
    """``word, c``: every distinct lower-cased word of ``docs`` and its count in the rows that ``learned`` marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches, "text", TEXT_BYTES):
            mine = part.column(part.schema.get_field_index("learned")).to_numpy(zero_copy_only=False).astype(bool)
            words = words_of(lowered(data), offsets)
            codes, distinct = words.encoded()
            counts = np.bincount(codes[mine[words.owner()]], minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.binary()), pa.array(counts)], ["word", "c"])

    frame = docs.select(F.col("text"), learned.alias("learned"))
    return frame.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, tokens: float, ends: float, path: str, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` of expected counts over the training words; what returns has the vocabulary's size."""
    vocabulary = _vocabulary(path)
    model = Model.start(vocabulary, tokens, ends)
    spark = words.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _vocabulary(path)
            total = np.zeros(len(own.lens) + 256)
            for part, data, offs in _parts(batches):
                total += expected_counts(data, offs, part.column(1).to_numpy().astype(np.float64), shared.value, own)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

        rows = words.where("c > 0").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(len(vocabulary.lens) + 256)
        counts[rows["piece"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
        model = Model(counts, ends, vocabulary)
    return model


def score_documents(docs: DataFrame, learned: Column, path: str, rounds: int = ROUNDS, common: int = COMMON) -> DataFrame:
    """``doc_id, learned, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Scores are log10. ``learned`` marks the rows to learn from. Reads ``doc_id, text``; other columns
    are not read. A null or blank text has the end as its one token; repeated rows stay repeated, and
    count as often in training; an empty table gives no rows. A text of any length is read whole, by one
    task; a very long word is a lattice of its own, with a step for each of its characters. Without training rows the weights stay
    those of the vocabulary's order.
    """
    spark = docs.sparkSession
    rows = text_batches(docs.select("doc_id", "text", learned.alias("learned")))
    words = cut(count_words(rows, F.col("learned")))
    totals = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    ends = int(rows.where("learned").count())
    n, v = int(totals["n"] or 0) + ends, int(totals["v"] or 0) + (ends > 0)
    model = fit(words, float(n - ends), float(ends), path, rounds)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(path)
        for part, data, offs in _parts(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(word_scores(data, offs, shared.value, own))], ["word", "c", "lp"])

    known = cut(words.mapInArrow(score, "word binary, c long, lp double"))
    top = known.where(F.length("word") <= COMMON_BYTES).orderBy(F.desc("c"), "word").limit(common).toPandas()
    # Fixed numbers of words of bounded length: every task may hold them.
    held = spark.sparkContext.broadcast((pa.array(top["word"].tolist(), pa.large_binary()), top["c"].to_numpy(dtype=np.int64), top["lp"].to_numpy(dtype=np.float64)))
    floor = float(np.log10(n + v + 1))
    end_base = float(np.log10(ends + 1)) - floor

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        common_words, counts, scores = held.value
        counts, scores = np.append(counts, 0), np.append(scores, 0.0)
        for part, data, offsets in steps(batches, "text"):
            words = words_of(lowered(data), offsets)
            codes, distinct = words.encoded()
            place = pc.fill_null(pc.index_in(distinct, value_set=common_words), len(common_words)).to_numpy(zero_copy_only=False).astype(np.int64)
            at = place[codes]
            is_common = at < len(common_words)
            base = sums(np.where(is_common, np.log10(counts[at] + 1) - floor, 0.0), words.first)
            lp = sums(np.where(is_common, scores[at], 0.0), words.first)
            seen = sums(is_common & (counts[at] > 0), words.first)
            rare = np.flatnonzero(~is_common)
            owner = words.owner()[rare]
            key, times = np.unique(owner * np.int64(len(distinct) + 1) + codes[rare], return_counts=True)
            bounds = np.searchsorted(key // (len(distinct) + 1), np.arange(part.num_rows + 1))
            items = pa.StructArray.from_arrays(
                [distinct.take(pa.array(key % (len(distinct) + 1))).cast(pa.binary()), pa.array(times, pa.int64())], ["word", "times"]
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.diff(words.first)), pa.array(seen), pa.array(base), pa.array(lp),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)],
                ["doc_id", "learned", "words", "seen", "base", "lp", "rare"],
            )

    kinds = "doc_id long, learned boolean, words long, seen long, base double, lp double, rare array<struct<word:binary,times:long>>"
    read = cut(rows.mapInArrow(first_pass, kinds).withColumn("uid", F.monotonically_increasing_id()))
    rest = (
        read.select("uid", F.inline("rare")).join(known, "word")
        .groupBy("uid").agg(
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen2"),
            F.sum(F.col("times") * (F.log10(F.col("c") + 1) - floor)).alias("base2"), F.sum(F.col("times") * F.col("lp")).alias("lp2"),
        )
    )
    both = read.drop("rare").join(rest, "uid", "left")
    zero = F.lit(0)
    return both.select(
        "doc_id", "learned", (F.col("words") + 1).alias("n_tokens"), (F.col("seen") + F.coalesce("seen2", zero) + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base2", F.lit(0.0)) + end_base).alias("base_score"),
        ((F.col("lp") + F.coalesce("lp2", F.lit(0.0)) + model.end) / float(np.log(10))).alias("score"),
    )
