"""SentencePiece encoding and decoding by suffix-array matching.

A step's distinct chunks (a word with the spaces before it: no piece reaches across that border) are
concatenated and indexed by a suffix array; every piece is binary-searched for the range of suffixes
that begin with it, so all its occurrences are found at once. Sorted by position they are the edges
of a lattice over the text, which is then relaxed: by best score for vocabularies of unigram kind,
by the vocabulary's merge order for those of BPE kind, so that ids equal the public library's.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricetrail.llm.arrays import binary, flat, once, ragged, steps, xxh64
from pricetrail.llm.frames import text_batches

#: Characters indexed by one suffix array; a longer single chunk is an index of its own.
INDEX_CHARS = 200_000
#: Bytes of text whose distinct chunks are encoded together.
TEXT_BYTES = 1_250_000
#: Chunks a worker remembers between steps, about forty bytes each.
SEEN_CHUNKS = 500_000
#: Chunks of more characters are relaxed with a heap, shorter ones all at once.
LONG_CHUNK = 200
_SPACE_PIECE = "▁"
_FAR = np.int64(1) << 60
_NONE = np.int32(2**31 - 1)


@dataclass
class Vocabulary:
    """Pieces that can match text, by id, with their scores, and the ids of the bytes.

    ``borders``: whether no piece holds a space after another character, so that spaces split texts.
    """

    chars: np.ndarray  # pieces by row, padded with -1
    lens: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    bpe: bool
    borders: bool
    bytes_of: list[bytes]
    dummy_prefix: bool = True

    def __post_init__(self) -> None:
        self.order = np.unique(-self.scores, return_inverse=True)[1].astype(np.int64)


def load(path: str) -> Vocabulary:
    """The vocabulary of a model file whose normaliser is the identity with a space put in front."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as spec

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    proto = spec.ModelProto.FromString(model.serialized_model_proto())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model changes texts before it encodes them")
    kinds = spec.ModelProto.SentencePiece
    pieces, ids, scores, byte_ids, bytes_of = [], [], [], np.full(256, -1, dtype=np.int64), []
    for i, piece in enumerate(proto.pieces):
        if piece.type == kinds.BYTE:
            value = int(piece.piece[3:5], 16)
            byte_ids[value] = i
            bytes_of.append(bytes([value]))
        elif piece.type == kinds.NORMAL:
            pieces.append(piece.piece)
            ids.append(i)
            scores.append(piece.score)
            bytes_of.append(piece.piece.replace(_SPACE_PIECE, " ").encode())
        elif piece.type in (kinds.CONTROL, kinds.UNKNOWN):
            bytes_of.append(b"" if piece.type == kinds.CONTROL else " ⁇ ".encode())
        else:
            raise ValueError(f"piece {i} is of a kind that is not handled")
    lens = np.array([len(p) for p in pieces], dtype=np.int64)
    chars = np.full((len(pieces), int(lens.max())), -1, dtype=np.int32)
    for row, piece in enumerate(pieces):
        chars[row, : len(piece)] = [ord(c) for c in piece]
    borders = not any(_SPACE_PIECE in p.lstrip(_SPACE_PIECE) for p in pieces)
    return Vocabulary(
        chars, lens, np.array(ids), np.array(scores), byte_ids, model.unk_id(),
        proto.trainer_spec.model_type == 2, borders, bytes_of, norm.add_dummy_prefix,
    )


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` sorted by the ``depth`` characters from there on, by prefix doubling."""
    seen = np.zeros(int(text.max()) + 1, dtype=np.int64)
    seen[text] = 1
    rank = np.cumsum(seen)[text]
    reach = 1
    while reach < depth:
        behind = np.zeros(len(rank), dtype=np.int64)
        behind[:-reach] = rank[reach:] if reach < len(rank) else 0
        key = rank * (np.int64(len(rank)) + 2) + behind
        order = np.argsort(key)
        sorted_key = key[order]
        rank[order] = np.cumsum(np.concatenate(([1], sorted_key[1:] != sorted_key[:-1])))
        reach *= 2
    return np.argsort(rank)


def _bound(text: np.ndarray, places: np.ndarray, chars: np.ndarray, after: bool) -> np.ndarray:
    """The first suffix not below each piece, or the first beyond all that begin with it."""
    width = chars.shape[1]
    padded = np.concatenate((text, np.full(width, -2, dtype=text.dtype)))
    low, high = np.zeros(len(chars), dtype=np.int64), np.full(len(chars), len(places), dtype=np.int64)
    used = chars >= 0
    rows = np.arange(len(chars))
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        found = padded[places[np.minimum(middle, len(places) - 1)][:, None] + np.arange(width)]
        differs = (found != chars) & used
        at = differs.argmax(axis=1)
        below = np.where(differs[rows, at], found[rows, at] < chars[rows, at], after)
        low = np.where(open_ & below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)


def match(text: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences of pieces in ``text`` (code points): start, length and row, by start and length."""
    present = np.zeros(0x110000 + 1, dtype=bool)
    present[text] = True
    possible = np.flatnonzero(np.where(vocabulary.chars >= 0, present[np.maximum(vocabulary.chars, 0)], True).all(axis=1))
    places = suffix_array(text, vocabulary.chars.shape[1])
    chars = vocabulary.chars[possible]
    low, high = _bound(text, places, chars, False), _bound(text, places, chars, True)
    starts = places[ragged(low, high - low)]
    rows = np.repeat(possible, high - low)
    order = np.argsort(starts * 64 + vocabulary.lens[rows])
    return starts[order], vocabulary.lens[rows][order], rows[order]


def _relax_scores(n: int, starts: np.ndarray, lens: np.ndarray, weight: np.ndarray, floor: float) -> np.ndarray:
    """Ends of the spans of the best-scored way through ``n`` characters; a lone character costs ``floor``."""
    best = np.full(n + 1, -np.inf)
    best[0] = 0.0
    back = np.zeros(n + 1, dtype=np.int64)
    first = np.searchsorted(starts, np.arange(n + 1))
    for p in range(n):
        edges = slice(first[p], first[p + 1])
        reached = [(p + int(k), float(w)) for k, w in zip(lens[edges], weight[edges])]
        if not any(e == p + 1 for e, _ in reached):
            reached.append((p + 1, floor))
        for end, w in reached:
            if best[p] + w > best[end]:
                best[end], back[end] = best[p] + w, p
    ends, at = [], n
    while at:
        ends.append(at)
        at = int(back[at])
    return np.array(ends[::-1], dtype=np.int64)


def _relax_heap(n: int, edge: dict[tuple[int, int], float]) -> np.ndarray:
    """Ends of the symbols after all merges of one long chunk; ``edge`` maps (start, end) to its score."""
    after = np.arange(1, n + 1).tolist()
    before = np.arange(-1, n - 1).tolist()
    alive = [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(p: int) -> None:
        if p >= 0 and after[p] < n:
            end = after[after[p]]
            if (p, end) in edge:
                heapq.heappush(heap, (-edge[p, end], p, end))

    for p in range(n - 1):
        offer(p)
    while heap:
        _, p, end = heapq.heappop(heap)
        if not alive[p] or after[p] >= n or after[after[p]] != end:
            continue
        alive[after[p]] = False
        after[p] = end
        if end < n:
            before[end] = p
        offer(p)
        offer(before[p])
    ends, p = [], 0
    while p < n:
        p = after[p]
        ends.append(p)
    return np.array(ends, dtype=np.int64)


def _relax_merges(total: int, first: np.ndarray, starts: np.ndarray, lens: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Whether a symbol begins at each place once all chunks are merged; chunk ``c`` is ``first[c]:first[c + 1]``.

    ``order`` ranks the edges, best first. Every round merges, in each chunk at once, the best adjacent
    pair (the first, if equal).
    """
    spans = np.full(total * (width + 1), _NONE, dtype=np.int32)
    spans[starts * (width + 1) + lens] = order
    chunk_end = np.repeat(first[1:], np.diff(first))
    here = np.arange(total)
    after, before = here + 1, here - 1
    alive = np.ones(total, dtype=bool)
    bits = np.int64(max(total, 1)).item().bit_length()

    def pair(p: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place, with the place in the lower bits."""
        middle = after[p]
        inside = middle < chunk_end[p]
        end = after[np.minimum(middle, total - 1)]
        size = np.where(inside, end - p, 0)
        rank = np.where(inside & (size <= width), spans[p * (width + 1) + np.minimum(size, width)], _NONE).astype(np.int64)
        return np.where(rank < _NONE, (rank << bits) | p, _FAR)

    rank = pair(here)
    live = np.flatnonzero(np.diff(first) > 1)
    while len(live):
        sizes = first[live + 1] - first[live]
        places = ragged(first[live], sizes)
        heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        best = np.minimum.reduceat(rank[places], heads)
        more = best < _FAR
        live = live[more]
        p = best[more] & ((np.int64(1) << bits) - 1)
        middle = after[p]
        end = after[middle]
        alive[middle] = False
        rank[middle] = _FAR
        after[p] = end
        follows = end < chunk_end[p]
        before[end[follows]] = p[follows]
        rank[p] = pair(p)
        leads = alive[np.maximum(before[p], 0)] & (before[p] >= first[live])
        left = before[p][leads]
        rank[left] = pair(left)
    return alive


def _encode_index(text: np.ndarray, first: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the chunks ``text[first[c]:first[c + 1]]`` and where each chunk's ids begin."""
    # A border that no piece holds between chunks, so that no match reaches across.
    n = len(first) - 1
    sizes = np.diff(first)
    spaced = np.zeros(len(text) + n, dtype=np.int64)
    at = np.arange(len(text)) + np.repeat(np.arange(n), sizes)
    spaced[at] = text
    spaced[first[1:] + np.arange(n)] = 0x110000
    starts, lens, rows = match(spaced, vocabulary)
    home = np.full(len(spaced) + 1, -1, dtype=np.int64)
    home[at] = np.arange(len(text))
    starts = home[starts]
    weight = vocabulary.scores[rows]
    width = vocabulary.chars.shape[1]
    single = np.full(len(text), -1, dtype=np.int64)
    begins = np.zeros(len(text), dtype=bool)
    begins[first[:-1][sizes > 0]] = True
    long = np.flatnonzero(sizes > LONG_CHUNK) if vocabulary.bpe else np.arange(n)
    short = np.ones(len(text), dtype=bool)
    for c in long.tolist():
        a, b = int(first[c]), int(first[c + 1])
        short[a:b] = False
        x, y = np.searchsorted(starts, (a, b))
        if vocabulary.bpe:
            spans = dict(zip(zip((starts[x:y] - a).tolist(), (starts[x:y] - a + lens[x:y]).tolist()), weight[x:y].tolist()))
            ends = _relax_heap(b - a, spans)
        else:
            ends = _relax_scores(b - a, starts[x:y] - a, lens[x:y], weight[x:y], float(vocabulary.scores.min()) - 10.0)
        begins[a + ends[:-1]] = True
    if vocabulary.bpe:
        mine = short[starts] if len(starts) else np.zeros(0, dtype=bool)
        whole = np.where(sizes > LONG_CHUNK, 0, sizes)
        compact = np.concatenate(([0], np.cumsum(whole)))
        to = np.cumsum(short) - 1
        alive = _relax_merges(int(whole.sum()), compact, to[starts[mine]], lens[mine], vocabulary.order[rows[mine]], width)
        begins[short] = alive
    # Ids: the edge that spans each symbol; a lone character without one falls back to its bytes.
    heads = np.flatnonzero(begins)
    spans = np.append(heads, len(text))[1:] - heads
    key = starts * 64 + lens
    wanted = heads * 64 + spans
    found = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
    known = (key[found] == wanted) if len(key) else np.zeros(len(wanted), dtype=bool)
    known &= spans < 64
    count = np.ones(len(heads), dtype=np.int64)
    lost = np.flatnonzero(~known)
    extra: list[list[int]] = []
    for h in lost.tolist():
        raw = chr(int(text[heads[h]])).encode()
        ids = [int(vocabulary.byte_ids[b]) for b in raw]
        extra.append(ids if min(ids) >= 0 else [vocabulary.unknown])
        count[h] = len(extra[-1])
    out_at = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(out_at[-1], dtype=np.int32)
    if len(key):
        out[out_at[:-1][known]] = vocabulary.ids[rows[found[known]]]
    for h, ids in zip(lost.tolist(), extra):
        out[out_at[h] : out_at[h + 1]] = ids
    return out, out_at[np.searchsorted(heads, first)]


def chunks_of(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised texts cut before each run of spaces: bytes, chunk ends and the first chunk of each text."""
    text = binary(data, offsets)
    mark = np.frombuffer(_SPACE_PIECE.encode(), dtype=np.uint8)
    if len(data) > 2 and ((data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])).any():
        import pyarrow.compute as pc

        text = pc.replace_substring(text.cast(pa.large_string()), _SPACE_PIECE, " ").cast(pa.large_binary())
        data, offsets = flat(text)
    lens = np.diff(offsets)
    front = ((lens > 0) & vocabulary.dummy_prefix).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(lens + front)))
    whole = np.full(ends[-1], 32, dtype=np.uint8)
    whole[ragged(ends[:-1] + front, lens)] = data
    begins = np.zeros(len(whole), dtype=bool)
    if vocabulary.borders:
        space = whole == 32
        begins[1:] = space[1:] & ~space[:-1]
    begins[ends[:-1][np.diff(ends) > 0]] = True
    heads = np.flatnonzero(begins)
    return whole, np.append(heads, len(whole)), np.searchsorted(heads, ends)


def _encode_distinct(distinct: np.ndarray, offs: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct chunks given as bytes and offsets, and where each chunk's ids begin."""
    lead = (distinct & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead)))[offs]
    points = np.frombuffer(distinct.tobytes().decode().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    points[points == 32] = ord(_SPACE_PIECE)
    ids, at, a = [np.zeros(0, dtype=np.int32)], [np.zeros(1, dtype=np.int64)], 0
    while a < len(offs) - 1:
        b = max(a + 1, int(np.searchsorted(chars, chars[a] + INDEX_CHARS, side="right")) - 1)
        got, place = _encode_index(points[chars[a] : chars[b]], chars[a : b + 1] - chars[a], vocabulary)
        ids.append(got)
        at.append(place[1:] + at[-1][-1])
        a = b
    return np.concatenate(ids), np.concatenate(at)


class Seen:
    """Ids of chunks met before, found by two 64-bit hashes; forgotten all at once when they are too many."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.keys, self.checks = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.at, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def encode(self, distinct: np.ndarray, offs: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encode_distinct``, which is asked for chunks not met before only."""
        lens = np.diff(offs)
        keys, checks = xxh64(distinct, offs[:-1], lens, 1), xxh64(distinct, offs[:-1], lens, 2)
        if len(self.keys) + len(keys) > SEEN_CHUNKS:
            self.forget()
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = (self.keys[place] == keys) & (self.checks[place] == checks) if len(self.keys) else np.zeros(len(keys), dtype=bool)
        new = np.flatnonzero(~known)
        fresh, at = _encode_distinct(distinct[ragged(offs[:-1][new], lens[new])], np.concatenate(([0], np.cumsum(lens[new]))), vocabulary)
        start, size = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        start[known], size[known] = self.at[place[known]], self.size[place[known]]
        start[new], size[new] = at[:-1] + len(self.ids), np.diff(at)
        ids = np.concatenate((self.ids, fresh))
        short = new[lens[new] <= LONG_CHUNK]
        both = np.concatenate((self.keys, keys[short]))
        order = np.argsort(both)
        self.keys, self.checks = both[order], np.concatenate((self.checks, checks[short]))[order]
        self.at, self.size = np.concatenate((self.at, start[short]))[order], np.concatenate((self.size, size[short]))[order]
        self.ids = ids
        return ids[ragged(start, size)], np.concatenate(([0], np.cumsum(size)))


def encode(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, seen: Seen | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts given as bytes and offsets, and where each text's ids begin."""
    whole, heads, first = chunks_of(data, offsets, vocabulary)
    if len(heads) < 2:
        return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
    chunks = binary(whole, heads).dictionary_encode()
    codes = chunks.indices.to_numpy()
    ids, at = (seen or Seen()).encode(*flat(chunks.dictionary), vocabulary)
    size = np.diff(at)[codes]
    ends = np.concatenate(([0], np.cumsum(size)))
    return ids[ragged(at[:-1][codes], size)], ends[first]


def decode(ids: np.ndarray, first: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Texts of the ids as bytes and offsets; the space put in front is taken away again."""
    table, offs = np.frombuffer(b"".join(vocabulary.bytes_of), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in vocabulary.bytes_of])))
    lens = np.diff(offs)[ids]
    data = table[ragged(offs[:-1][ids], lens)]
    ends = np.concatenate(([0], np.cumsum(lens)))[first]
    if not vocabulary.dummy_prefix or not len(data):
        return data, ends
    filled = np.diff(ends) > 0
    head = ends[:-1][filled]
    drop = head[data[head] == 32]
    keep = np.ones(len(data), dtype=bool)
    keep[drop] = False
    return data[keep], np.concatenate(([0], np.cumsum(keep)))[ends]


def _worker_state(path: str) -> tuple[Vocabulary, Seen]:
    """What a Python worker keeps from task to task."""
    return once(f"pieces {path}", lambda: (load(path), Seen()))


def encoded_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``pieces``, ``n_pieces`` and ``round_trip`` of every row of ``docs``.

    ``round_trip`` says whether decoding the pieces gives the text again (a piece's space sign in a
    text reads as a space). Reads ``text`` and ``keep`` only. A null text has a null list, no pieces
    and a true round trip; an empty one an empty list; a text of any length is read whole, and one longer than a step is a step of
    its own; repeated rows stay repeated; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen = _worker_state(path)
        mark = np.frombuffer(_SPACE_PIECE.encode(), dtype=np.uint8)
        for part, data, offsets in steps(batches, "text_", TEXT_BYTES):
            ids, first = encode(data, offsets, vocabulary, seen)
            back, ends = decode(ids, first, vocabulary)
            if len(back) == len(data) and np.array_equal(back, data):
                same = np.ones(part.num_rows, dtype=bool)
            else:
                read = lambda d, o: [bytes(d[a:b]).replace(mark.tobytes(), b" ") for a, b in zip(o[:-1], o[1:])]
                same = np.array([x == y for x, y in zip(read(data, offsets), read(back, ends))])
            names = part.schema.names
            missing = pa.array(part.column(names.index("text_")).is_null().to_numpy(zero_copy_only=False))
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids), mask=missing)
            kept = [part.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, lists, pa.array(np.diff(first)), pa.array(same)], [*keep, "pieces", "n_pieces", "round_trip"]
            )

    frame = text_batches(docs.select(*[F.col(c) for c in keep], F.col("text").alias("text_")))
    kinds = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in keep)
    return frame.mapInArrow(run, f"{kinds}, pieces array<int>, n_pieces long, round_trip boolean")
