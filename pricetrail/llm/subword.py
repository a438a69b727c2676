"""Quality classifier on supervised subword embeddings.

Words and their character n-grams are hashed to vectors that are learned with the labels; a text is
the average of its vectors, a softmax over a linear layer gives its class. Training runs by
stochastic gradient descent in numpy over a bounded sample of labelled rows. As the average and the
layer are linear, the trained model is one number for each hash bucket (the layer applied to its
vector), and a text's logit is the average of those: scoring whole texts takes no vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricetrail.llm.arrays import binary, flat, ragged, steps, sums, words_of, xxh64
from pricetrail.llm.frames import text_batches, unit

#: Labelled rows that training uses at most, on average over the sample's hash; all, if there are fewer.
SAMPLE = 3000
BUCKETS = 1 << 18
DIM = 10
EPOCHS = 4
RATE = 8.0
NGRAMS = (3, 4, 5)
SEED = 7
#: Buckets kept for "this word is the one before it again" and for the text itself.
_AGAIN, _TEXT = 0, 1


@dataclass
class Model:
    """``logit`` of class 1 by bucket, and what a text without words scores."""

    logit: np.ndarray
    prior: float


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of distinct words and the word each belongs to: the word and its n-grams, ends marked."""
    data, offs = flat(words)
    lens = np.diff(offs)
    n = len(lens)
    padded = np.full(len(data) + 2 * n, ord("<"), dtype=np.uint8)
    starts = offs[:-1] + 2 * np.arange(n)
    padded[ragged(starts + 1, lens)] = data
    padded[starts + lens + 1] = ord(">")
    values = padded.astype(np.uint32)
    buckets = [xxh64(padded, starts, lens + 2, SEED) % np.uint64(BUCKETS - 2)]
    owners = [np.arange(n)]
    place = np.repeat(np.arange(n), lens + 2)
    room = np.repeat(starts + lens + 2, lens + 2) - np.arange(len(padded))
    with np.errstate(over="ignore"):
        for size in NGRAMS:
            here = np.flatnonzero(room >= size)
            h = np.full(len(here), 2166136261 + size, dtype=np.uint32)
            for k in range(size):
                h = (h ^ values[here + k]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
            buckets.append(h.astype(np.uint64) % np.uint64(BUCKETS - 2))
            owners.append(place[here])
    return np.concatenate(buckets).astype(np.int64) + 2, np.concatenate(owners)


def _again(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    same = np.zeros(len(codes), dtype=bool)
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    return same


def _bags(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their share of all its features."""
    words = words_of(data, offsets)
    codes, vocabulary = words.encoded()
    again = _again(codes, words.owner())
    buckets, owners = word_features(vocabulary)
    order = np.argsort(owners, kind="stable")
    buckets = buckets[order]
    first = np.searchsorted(owners[order], np.arange(len(vocabulary) + 1))
    for d in range(len(offsets) - 1):
        a, b = words.first[d], words.first[d + 1]
        mine = codes[a:b]
        parts = buckets[ragged(first[mine], first[mine + 1] - first[mine])]
        parts = np.concatenate((parts, np.full(int(again[a:b].sum()), _AGAIN), [_TEXT]))
        index, count = np.unique(parts, return_counts=True)
        yield index, (count / count.sum()).astype(np.float32)


def train(texts: list[str | None], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Stochastic gradient descent over the labelled texts, one text a step, the rate falling to zero."""
    rng = np.random.default_rng(SEED)
    array = pa.array([t or "" for t in texts], pa.string()).cast(pa.large_binary())
    bags = [bag for _, data, offs in steps(iter([pa.record_batch([array], ["t"])]), "t") for bag in _bags(data, offs)]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), dtype=np.float32)
    total, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            index, share = bags[i]
            hidden = share @ vectors[index]
            logits = hidden @ layer
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(labels[i])] -= 1.0
            step = np.float32(rate * (1 - done / total))
            back = layer @ p
            layer -= step * np.outer(hidden, p)
            vectors[index] -= (step * share)[:, None] * back[None, :]
            done += 1
    prior = (float(labels.sum()) + 1) / (len(labels) + 2)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), prior)


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of class 1 of each text; one without words scores the model's prior."""
    words = words_of(data, offsets)
    codes, vocabulary = words.encoded()
    buckets, owners = word_features(vocabulary)
    by_word = np.bincount(owners, weights=model.logit[buckets], minlength=len(vocabulary))
    features = np.bincount(owners, minlength=len(vocabulary))
    again = _again(codes, words.owner())
    n = sums(features[codes] + again, words.first) + 1
    logit = sums(by_word[codes] + again * float(model.logit[_AGAIN]), words.first) + float(model.logit[_TEXT])
    out = 1 / (1 + np.exp(-np.clip(logit / n, -60, 60)))
    return np.where(np.diff(words.first) > 0, out, model.prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, size: int, seed: int = SEED) -> DataFrame:
    """``text, label`` of labelled ids chosen by a hash: ``size`` on average, or all, one text for each.

    ``learn`` says which rows of ``labels`` may be learned from. The chosen ids are counted, few and
    fixed in number, so they are broadcast to the documents.
    """
    usable = labels.where(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    share = min(1.0, size / max(usable.count(), 1))
    chosen = usable.where(unit("doc_id", seed=seed) < share).select(F.col("doc_id").alias("_id"), "label")
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # An id used for many rows is one example: combined before the shuffle.
    return met.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").alias("label")).select("text", "label")


def fitted(sample: DataFrame) -> Model:
    """The model of a bounded sample, trained in one task; what comes back is its buckets' logits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(str(t or ""), int(y)) for frame in batches for t, y in zip(frame["text"], frame["label"])]
        rows.sort()  # the order of arrival must not matter
        model = train([t for t, _ in rows], np.array([y for _, y in rows], dtype=np.int64))
        yield pd.DataFrame({"logit": [model.logit.tobytes()], "prior": [model.prior]})

    row = sample.repartition(1).mapInPandas(run, "logit binary, prior double").first()
    if row is None:  # nothing to learn from
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.5)
    return Model(np.frombuffer(bytes(row["logit"]), dtype=np.float32), row["prior"])


def quality_scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score`` of every row of ``docs``.

    Reads ``text`` and ``keep`` only. A null or blank text scores the share of label 1 in the sample;
    equal texts score alike; an empty table gives no rows, and without labelled rows every score is
    about one half. A text of any length is read whole, by one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches, "text_"):
            names = list(part.schema.names)
            kept = [part.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores(shared.value, data, offsets))], [*keep, "score"])

    columns = [F.col(c) for c in keep]
    frame = text_batches(docs.select(*columns, F.col("text").alias("text_")))
    kinds = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in keep)
    return frame.mapInArrow(run, f"{kinds}, score double")
