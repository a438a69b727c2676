"""Token counts with overlap resynchronisation.

Texts of one chunk are encoded as they are; their equal runs (white space and what follows it, where
a border is certain) are encoded once. A longer text is cut into overlapping chunks that are encoded
one by one with their pre-token borders, and neighbouring chunks are spliced where both have a
border. The splice is exact: scanning for pre-tokens goes from left to right and depends only on
what follows a border, so a chunk that begins at a border of the text has the text's borders, but
for the last characters, where its cut end may show; and a chunk that begins anywhere agrees with
the text from the first common border on. Where the overlap has no common border, it is widened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pricetrail.llm.arrays import binary, flat, once, ragged, steps, xxh64
from pricetrail.llm.frames import text_batches

CHUNK = 16_384
OVERLAP = 512
#: Characters before a cut end whose borders are not trusted: longer than any special token, and
#: more than the one character that the scan looks ahead.
MARGIN = 64
LIMIT = 1024
#: Distinct words a worker remembers the token count of, about twenty bytes each.
SEEN_WORDS = 2_000_000


class Encoder:
    """A tokenizer with byte-level pre-tokens, the byte lengths of its tokens, and counts met before."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_of = np.zeros(size, dtype=np.int64)
        special = self.tokenizer.get_added_tokens_decoder()
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            # A byte-level token has one character for each byte; an added one stands for itself.
            self.bytes_of[i] = len(special[i].content.encode()) if i in special else len(token)
        longest = max([len(t.content) for t in special.values()], default=0)
        self.margin = max(MARGIN, 2 * longest)
        self.keys, self.checks, self.counts = (np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64))

    def borders(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Byte places where a pre-token begins or the text ends, and the tokens before each."""
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        ends = np.cumsum(self.bytes_of[np.array(encoding.ids, dtype=np.int64)]) if encoding.ids else np.zeros(0, dtype=np.int64)
        words = encoding.word_ids
        # An added token has no word, or one of its own part of the text: a border on both sides.
        new = [i for i in range(1, len(words)) if words[i] is None or words[i] != words[i - 1]]
        places = np.concatenate(([0], ends[[i - 1 for i in new]], ends[-1:])).astype(np.int64)
        return places, np.array([0, *new, *([len(words)] if words else [])], dtype=np.int64)

    def long_count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a text by chunks; at most one chunk and its overlap are encoded at a time."""
        total, begin = 0, 0  # tokens up to ``begin``, a character place that is a border of the text
        places, before = self.borders(text[:chunk])
        start, stop, from_tokens = 0, min(chunk, len(text)), 0
        while stop < len(text):
            width = overlap
            while True:
                # The next chunk begins ``width`` before the end of this one.
                right = max(start + 1, stop - width)
                if right <= begin + 1 or width > stop - start:
                    # No common border in all of this chunk: read on until there is one.
                    stop = min(len(text), stop + (stop - start))
                    places, before = self.borders(text[begin:stop])
                    start, from_tokens, width = begin, 0, overlap
                    if stop == len(text):
                        break
                    continue
                shift = len(text[start:right].encode())
                trusted = places[-1] - len(text[max(stop - self.margin, start) : stop].encode())
                mine = (places > shift) & (places <= trusted)
                end = min(right + chunk, len(text))
                theirs, their_before = self.borders(text[right:end])
                common, i, j = np.intersect1d(places[mine] - shift, theirs, return_indices=True)
                if len(common):
                    here = np.flatnonzero(mine)[i[0]]
                    total += int(before[here]) - from_tokens
                    begin = right + len(text[right:end].encode()[: int(common[0])].decode())
                    places, before, start, stop = theirs, their_before, right, end
                    from_tokens = int(their_before[j[0]])
                    break
                width *= 2
        return total + int(before[-1]) - from_tokens

    def counts_of(self, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Tokens of the texts given as bytes and offsets."""
        texts = len(offsets) - 1
        out = np.zeros(texts, dtype=np.int64)
        lens = np.diff(offsets)
        long = lens > chunk
        for d in np.flatnonzero(long).tolist():
            out[d] = self.long_count(bytes(data[offsets[d] : offsets[d + 1]]).decode(), chunk)
        short = np.flatnonzero(~long)
        data = data[ragged(offsets[short], lens[short])]
        offsets = np.concatenate(([0], np.cumsum(lens[short])))
        if not len(data):
            return out
        # Between a character other than white space and a space or line feed there is always a
        # border, so equal runs (white space and what follows it) need to be encoded once.
        blank = (data == 32) | (data == 10)
        space = blank | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31)) | (data >= 128)
        begins = np.zeros(len(data), dtype=bool)
        begins[1:] = blank[1:] & ~space[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        heads = np.flatnonzero(begins)
        runs = binary(data, np.append(heads, len(data))).dictionary_encode()
        counts = self._distinct(runs.dictionary)[runs.indices.to_numpy()]
        ends = np.concatenate(([0], np.cumsum(counts)))
        out[short] = np.diff(ends[np.searchsorted(heads, offsets)])
        return out

    def _distinct(self, runs: pa.Array) -> np.ndarray:
        data, offs = flat(runs)
        lens = np.diff(offs)
        keys, checks = xxh64(data, offs[:-1], lens, 1), xxh64(data, offs[:-1], lens, 2)
        if len(self.keys) + len(keys) > SEEN_WORDS:
            self.keys, self.checks, self.counts = self.keys[:0], self.checks[:0], self.counts[:0]
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = (self.keys[place] == keys) & (self.checks[place] == checks) if len(self.keys) else np.zeros(len(keys), dtype=bool)
        new = np.flatnonzero(~known)
        counts = np.zeros(len(keys), dtype=np.int64)
        if known.any():
            counts[known] = self.counts[place[known]]
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            texts = [t.decode() for t in runs.take(pa.array(part)).to_pylist()]
            counts[part] = [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        both = np.concatenate((self.keys, keys[new]))
        order = np.argsort(both)
        self.keys, self.checks = both[order], np.concatenate((self.checks, checks[new]))[order]
        self.counts = np.concatenate((self.counts, counts[new]))[order]
        return counts


def _encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return once(f"encoder {path}", lambda: Encoder(path))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    Reads ``doc_id, text``; other columns are not read. A null text counts as empty; repeated rows
    stay repeated; an empty table gives no rows. A text of any length is read whole, in chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for part, data, offsets in steps(batches, "text"):
            counts = encoder.counts_of(data, offsets, chunk)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return text_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
