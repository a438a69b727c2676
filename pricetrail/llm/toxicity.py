"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are character n-grams and beginnings of lower-cased words, ends marked. Those that tell the labels apart are
chosen from a bounded sample of labelled rows; their document frequencies are counted over all
documents. Labelled rows are indexed by term, their postings cut into blocks with the largest weight
of each block. A text's query takes blocks by falling bound and stops where no further block can
reach its k nearest, so the neighbours are exact. Their similarities weigh their votes, shrunk to the
rate among texts without such terms by a mass that fits the examples best when each is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricetrail.llm.arrays import flat, lowered, ragged, steps, words_of, xxh64
from pricetrail.llm.frames import text_batches, unit
from pricetrail.session import cut

#: Documents that one task searches for.
TASK_ROWS = 5_000
#: Labelled rows used as examples at most, on average over the sample's hash; all, if there are fewer.
SAMPLE = 12_000
#: Terms at most, the fewest examples a term is in, and the least chi-square of term and label.
TERMS = 2000
LEAST_DOCS = 5
LEAST_CHI = 30.0
#: Terms that are in exactly the same examples come from one passage, if there are more of them; one of them stands for all.
SAME_DOCS = 40
NGRAMS = (4, 5)
#: Bytes of the beginnings of words that are terms too, the mark of the beginning included.
PREFIXES = (6, 7, 8, 9, 10, 12)
K = 15
BLOCK = 64
#: Blocks looked at before the bound is asked for the first time; twice as many each time after.
STRIDE = 8
SEED = 5
#: Masses of the prior that are tried.
MASSES = (0.3, 0.5, 1.0)


def ngrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of distinct words and the word each belongs to."""
    data, offs = flat(words)
    lens = np.diff(offs)
    n = len(lens)
    padded = np.full(len(data) + 2 * n, ord("<"), dtype=np.uint8)
    starts = offs[:-1] + 2 * np.arange(n)
    padded[ragged(starts + 1, lens)] = data
    padded[starts + lens + 1] = ord(">")
    room = np.repeat(starts + lens + 2, lens + 2) - np.arange(len(padded))
    place = np.repeat(np.arange(n), lens + 2)
    hashes, owners = [], []
    for size in NGRAMS:
        here = np.flatnonzero(room >= size)
        h = np.full(len(here), size, dtype=np.int64)
        for k in range(size):  # at most five bytes: the hash is the n-gram itself
            h = (h << 8) | padded[here + k]
        hashes.append(h)
        owners.append(place[here])
    for size in PREFIXES:
        mine = np.flatnonzero(lens + 2 >= size)
        hashes.append(xxh64(padded, starts[mine], np.full(len(mine), size), SEED).view(np.int64))
        owners.append(mine)
    return np.concatenate(hashes), np.concatenate(owners)


def _doc_terms(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and frequency, sorted by text; terms are hashes, or places in ``chosen`` if given."""
    words = words_of(lowered(data), offsets)
    codes, vocabulary = words.encoded()
    hashes, owners = ngrams(vocabulary)
    if chosen is not None:
        place = np.minimum(np.searchsorted(chosen, hashes), max(len(chosen) - 1, 0))
        hit = chosen[place] == hashes if len(chosen) else np.zeros(len(hashes), dtype=bool)
        hashes, owners = place[hit], owners[hit]
    order = np.argsort(owners, kind="stable")
    hashes, owners = hashes[order], owners[order]
    first = np.searchsorted(owners, np.arange(len(vocabulary) + 1))
    size = np.diff(first)
    used = np.flatnonzero(size[codes] > 0)
    docs, mine = words.owner()[used], codes[used]
    terms = hashes[ragged(first[mine], size[mine])]
    docs = np.repeat(docs, size[mine])
    order = np.lexsort((terms, docs))
    docs, terms = docs[order], terms[order]
    fresh = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (terms[1:] != terms[:-1])))) if len(docs) else np.zeros(0, dtype=np.int64)
    return docs[fresh], terms[fresh], np.diff(np.append(fresh, len(docs)))


def choose_terms(sample: DataFrame, limit: int = TERMS) -> np.ndarray:
    """Sorted hashes of the terms whose presence goes with the label, most telling first up to ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches, "text"):
            label = part.column(part.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(np.int64)
            docs, terms, _ = _doc_terms(data, offsets, None)
            distinct, back = np.unique(terms, return_inverse=True)
            ones = np.bincount(back, weights=label[docs], minlength=len(distinct)).astype(np.int64)
            # Which documents a term is in, as a sum over hashes of them that may overflow.
            which = np.zeros(len(distinct), dtype=np.uint64)
            np.add.at(which, back, xxh64(data, offsets[:-1], np.diff(offsets))[docs] >> np.uint64(16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct), pa.array(ones), pa.array(np.bincount(back, minlength=len(distinct))), pa.array(which.view(np.int64))],
                ["term", "ones", "docs", "which"],
            )

    totals = sample.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    n, ones = float(totals["n"]), float(totals["ones"] or 0)
    counts = sample.mapInArrow(run, "term long, ones long, docs long, which long").groupBy("term").agg(
        F.sum("ones").alias("a"), F.sum("docs").alias("d"), F.sum("which").alias("which")
    )
    a, d = F.col("a"), F.col("d")
    lead = a * n - d * ones
    chi = F.when((d < n) & (F.lit(ones) > 0) & (F.lit(ones) < n), lead * lead * n / (d * (n - d) * ones * (n - ones))).otherwise(0.0)
    telling = cut(counts.where(d >= LEAST_DOCS).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI))
    copied = telling.groupBy("d", "which").agg(F.count("*").alias("same"), F.min("term").alias("stands")).where(F.col("same") > SAME_DOCS)
    kept = telling.join(copied, ["d", "which"], "left").where("stands is null or term = stands")
    best = kept.orderBy(F.desc("chi"), "term").limit(limit)
    return np.sort(np.array([r["term"] for r in best.select("term").collect()], dtype=np.int64))


class Index:
    """Labelled examples by term, in blocks with the largest weight of each term."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, block: int = BLOCK) -> None:
        # Examples that share their rarest terms come together, so that blocks have tight bounds.
        lead = np.full(len(ids), -1)
        np.maximum.at(lead, docs, terms)
        order = np.lexsort((ids, lead))
        back = np.empty(len(ids), dtype=np.int64)
        back[order] = np.arange(len(ids))
        self.ids, self.labels, self.block = ids[order], labels[order], block
        self.blocks = max(1, -(-len(ids) // block))
        docs = back[docs]
        key = terms * np.int64(self.blocks) + docs // block
        by = np.lexsort((docs, key))
        self.docs, self.weights = docs[by], weights[by]
        self.pointer = np.searchsorted(key[by], np.arange(n_terms * self.blocks + 1))
        self.largest = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.largest, key, weights)
        self.largest = self.largest.reshape(n_terms, self.blocks)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` most similar examples, but for those with the id ``own``, and their similarities."""
        bounds = weights @ self.largest[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[: int((bounds > 0).sum())]
        found, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        at, stride = 0, STRIDE
        while at < len(order):
            least = scores[k - 1] if len(scores) >= k else 0.0
            take = order[at : at + stride]
            take = take[bounds[take] >= least - 1e-12]
            if not len(take):
                break
            at, stride = at + stride, 2 * stride
            cells = (terms[:, None] * self.blocks + take[None, :]).reshape(-1)
            lens = self.pointer[cells + 1] - self.pointer[cells]
            places = ragged(self.pointer[cells], lens)
            value = np.repeat(np.repeat(weights, len(take)), lens) * self.weights[places]
            sums = np.bincount(self.docs[places], weights=value, minlength=len(self.ids))
            docs = np.flatnonzero(sums)
            if own is not None:
                docs = docs[self.ids[docs] != own]
            found, scores = np.concatenate((found, docs)), np.concatenate((scores, sums[docs]))
            if len(found) > k:  # only those that can be among the first k are put in order
                edge = np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-11
                found, scores = found[scores >= edge], scores[scores >= edge]
            best = np.lexsort((self.ids[found], -np.round(scores, 12)))[:k]
            found, scores = found[best], scores[best]
        return found, scores


def _vectors(first: np.ndarray, terms: np.ndarray, freq: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF weights of rows given by their first entries."""
    weight = (1 + np.log(freq)) * idf[terms]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    norm = np.sqrt(np.bincount(owner, weights=weight * weight, minlength=len(first) - 1))
    return weight / norm[owner]


class Votes:
    """What scoring needs: the index, the terms' weights, and how votes become scores."""

    def __init__(self, index: Index, idf: np.ndarray, prior: float, k: int = K) -> None:
        self.index, self.idf, self.prior, self.mass, self.k = index, idf, prior, MASSES[0], k

    def score(self, terms: np.ndarray, weights: np.ndarray, own: int | None) -> tuple[float, float, np.ndarray]:
        """Weighted votes for label 1, all votes, and the neighbours."""
        found, near = self.index.nearest(terms, weights, own, self.k)
        return float((near * self.index.labels[found]).sum()), float(near.sum()), found

    def probability(self, ones: np.ndarray, votes: np.ndarray, mass: float | None = None) -> np.ndarray:
        mass = self.mass if mass is None else mass
        return (ones + mass * self.prior) / (votes + mass)

    def calibrate(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """Takes the prior mass with the least log loss over examples, each scored without itself."""
        if not rows:
            return
        got = [self.score(terms, weights, own) for own, _, terms, weights in rows]
        ones, votes = np.array([g[0] for g in got]), np.array([g[1] for g in got])
        label = np.array([r[1] for r in rows])
        loss = []
        for mass in MASSES:
            p = np.clip(self.probability(ones, votes, mass), 1e-6, 1 - 1e-6)
            loss.append(-(label * np.log(p) + (1 - label) * np.log(1 - p)).mean())
        self.mass = MASSES[int(np.argmin(loss))]


def _term_rows(docs: DataFrame, chosen: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches, "text_"):
            owner, terms, freq = _doc_terms(data, offsets, shared.value)
            first = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(first, pa.array(x, pa.int32())) for x in (terms, freq)]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], *lists], [*keep, "terms", "freq"])

    frame = text_batches(docs.select(*keep, F.col("text").alias("text_")))
    kinds = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in keep)
    return frame.mapInArrow(run, f"{kinds}, terms array<int>, freq array<int>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample: int = SAMPLE, k: int = K) -> DataFrame:
    """``doc_id, score, neighbours, evidence`` of every row of ``docs``; ``evidence`` holds the nearest examples' ids.

    ``learn`` says which rows of ``labels`` may be learned from. Reads ``doc_id, text`` of the documents
    and ``doc_id`` and the label of the labels. A text without chosen terms, null and blank ones too,
    scores the rate among such examples; equal texts score alike but for examples, which never vote
    for themselves; a text of any length is read whole, by one task; repeated rows stay repeated; an empty
    table gives no rows, and without labelled
    rows every score is one half.
    """
    spark = docs.sparkSession
    usable = labels.where(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    share = min(1.0, sample / max(usable.count(), 1))
    # The chosen ids are few by the bound on the sample, so they are broadcast.
    chosen = F.broadcast(cut(usable.where(unit("doc_id", seed=SEED) < share)))
    # Copies of one text say no more about its terms than the text does.
    terms = choose_terms(docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("text").agg(F.max("label").alias("label")))
    rows = cut(_term_rows(docs, terms, ("doc_id",)))
    seen = {r["t"]: r["n"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    total = rows.count()
    idf = np.array([np.log((1 + total) / (1 + seen.get(i, 0))) + 1 for i in range(len(terms))])
    # One row for each example, whatever the number of its copies: what comes back is bounded by the sample.
    examples = rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.max(F.struct("terms", "freq")).alias("v"))
    got = examples.select("doc_id", "label", "v.terms", "v.freq").orderBy("doc_id").collect()
    blank = [r["label"] for r in got if not r["terms"]]
    some = [r for r in got if r["terms"]]
    prior = (sum(blank) + 1.0) / (len(blank) + 2.0) if got else 0.5
    first = np.concatenate(([0], np.cumsum([len(r["terms"]) for r in some]))).astype(np.int64)
    flat_terms = np.array([t for r in some for t in r["terms"]], dtype=np.int64)
    weights = _vectors(first, flat_terms, np.array([f for r in some for f in r["freq"]], dtype=np.float64), idf) if some else np.zeros(0)
    ids, marks = np.array([r["doc_id"] for r in some], dtype=np.int64), np.array([r["label"] for r in some], dtype=np.int64)
    index = Index(ids, marks, np.repeat(np.arange(len(some)), np.diff(first)), flat_terms, weights, max(len(terms), 1))
    votes = Votes(index, idf, prior, k)
    votes.calibrate([(int(ids[i]), int(marks[i]), flat_terms[first[i] : first[i + 1]], weights[first[i] : first[i + 1]]) for i in range(len(some))])
    shared = spark.sparkContext.broadcast(votes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Votes = shared.value
        for batch in batches:
            n = batch.num_rows
            own = batch.column(0).to_pylist()
            lists = batch.column(1)
            first = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int64)
            terms = lists.flatten().to_numpy().astype(np.int64)
            weights = _vectors(first, terms, batch.column(2).flatten().to_numpy().astype(np.float64), model.idf) if len(terms) else np.zeros(0)
            ones, total, evidence = np.zeros(n), np.zeros(n), [[] for _ in range(n)]
            for i in np.flatnonzero(np.diff(first)).tolist():
                a, b = first[i], first[i + 1]
                ones[i], total[i], found = model.score(terms[a:b], weights[a:b], own[i])
                evidence[i] = model.index.ids[found].tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.probability(ones, total)), pa.array([len(e) for e in evidence], pa.int32()), pa.array(evidence, pa.list_(pa.int64()))],
                ["doc_id", "score", "neighbours", "evidence"],
            )

    # Rows of terms are small and searches are not: tasks follow the number of rows, not their bytes.
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    return rows.select("doc_id", "terms", "freq").repartition(tasks).mapInArrow(run, "doc_id long, score double, neighbours int, evidence array<long>")
