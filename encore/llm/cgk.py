"""Benchmark decontamination by the CGK embedding of edit distance into Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import bucket, slices, stored, text_bytes
from encore.llm.tokens import BYTE, PLACE, SPACE, mix64, split_words, word_hashes

#: Word edits allowed per word of the item.
MAX_EDITS = 0.15
#: Independent walks, and coordinates sampled from each.
REPEATS, SAMPLED = 20, 3
#: Steps of a walk per word of the window: a walk moves on at every second step, about.
STRETCH = 2
#: Window lengths grow by this factor: an item is looked for with windows of the next length below its own.
GRID = 1.12
#: Benchmark items that one pass over the documents holds.
ITEM_BLOCK = 20_000
#: Items of fewer words must match exactly.
MIN_WORDS = 8
#: Longer items are looked for by pieces of up to this many words: walks drift apart over long windows.
PIECE = 40
#: Sizes of the word grams that are counted before a window is embedded.
GRAMS = (3, 2, 1)
#: Windows embedded at a time.
CHUNK = 4096

#: Bytes that do not belong to words: white space and ASCII punctuation.
BREAK = SPACE.copy()
BREAK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (lower case, no ASCII punctuation) and the words before each text."""
    data, ends = text_bytes(pc.utf8_lower(column))
    starts, stops, before = split_words(data, ends, BREAK)
    return word_hashes(data, starts, stops, BYTE), before


def window_length(words: int) -> int:
    """The grid length at or below ``words``."""
    length = 1
    while max(length + 1, int(length * GRID)) <= words:
        length = max(length + 1, int(length * GRID))
    return length


def edits_allowed(words: int, max_edits: float = MAX_EDITS) -> int:
    return int(words * max_edits) if words >= MIN_WORDS else 0


def pieces(words: int, allowed: int) -> list[tuple[int, int, int]]:
    """(offset, words, edits) of the pieces by which an item is looked for: itself, if it is short.

    A long item is cut into k even pieces, and k - 1 more lie across the cuts. If the whole has no
    more than ``allowed`` edits, one of the k has no more than a k-th of them.
    """
    if words <= PIECE:
        return [(0, words, allowed)]
    k = -(-words // PIECE)
    size = words // k
    return [(h * (words - size) // (2 * k - 2), size, allowed // k) for h in range(2 * k - 1)]


def word_grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    runs = max(0, len(codes) - size + 1)
    out = np.zeros(runs, np.uint64)
    for k in range(size):
        out += codes[k : k + runs] * PLACE[11 + k]
    return mix64(out)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values stand in the ascending array ``known``."""
    out = np.zeros(len(values), bool)
    if len(known):
        # most values fall where no known one does, by their upper bits
        slots = np.zeros(1 << 18, bool)
        slots[known >> np.uint64(46)] = True
        near = np.flatnonzero(slots[values >> np.uint64(46)])
        out[near] = known[np.minimum(np.searchsorted(known, values[near]), len(known) - 1)] == values[near]
    return out


class Walks:
    """The random walks for windows of the given lengths: REPEATS of them, and the coordinates sampled from each."""

    def __init__(self, lengths: list[int]):
        self.lengths = np.array(sorted(set(lengths)), np.int64)
        steps = STRETCH * int(self.lengths.max(initial=1))
        rng = np.random.default_rng(4242)
        #: The top bit of word * move says whether a walk moves on; padding (0) stays where it is.
        self.moves = rng.integers(0, 2**63, (steps, REPEATS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.taken = np.zeros((steps, REPEATS, len(self.lengths)), bool)
        for k, n in enumerate(self.lengths):
            for r in range(REPEATS):
                own = STRETCH * int(n)
                self.taken[rng.choice(own, min(SAMPLED, own), replace=False), r, k] = True

    def embed(self, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Keys (repeat by window) of the windows from ``starts`` to ``stops``, of length kind ``kind``.

        A walk stands at a word, writes it, and moves on or stays by a random bit of (step, word);
        behind the window it writes padding. Windows that differ by an edit soon fall in step
        again, so their embeddings differ in few places.
        """
        keys = np.empty((REPEATS, len(starts)), np.uint64)
        for c in range(0, len(starts), CHUNK):
            begin, end, which = starts[c : c + CHUNK], stops[c : c + CHUNK], kind[c : c + CHUNK]
            key = np.broadcast_to(self.lengths[which].astype(np.uint64) * PLACE[7], (REPEATS, len(begin))).copy()
            at = np.broadcast_to(begin, key.shape).copy()
            for t in range(STRETCH * int(self.lengths[which].max())):
                word = np.where(at < end, codes[np.minimum(at, len(codes) - 1)], np.uint64(0))
                if self.taken[t].any():
                    wanted = np.nonzero(self.taken[t][:, which])
                    key[wanted] = mix64(key[wanted] ^ word[wanted]) + PLACE[t % 4096]
                at += ((word * self.moves[t]) >> np.uint64(63)).view(np.int64)
            keys[:, c : c + CHUNK] = key
        return keys


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Least word edits between ``a`` and any prefix of ``b``; above ``most``: most + 1.

    The end of ``b`` is free, so a window may run past the passage.
    """
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        new = np.empty_like(row)
        new[0] = i
        new[1:] = step
        # insertions: new[j] = min over k <= j of new[k] + (j - k)
        new = np.minimum.accumulate(new - np.arange(len(row))) + np.arange(len(row))
        row = new
        if row.min() > most:
            return most + 1
    return int(min(row.min(), most + 1))


def nearest_start(a: np.ndarray, b: np.ndarray, span: int, most: int) -> tuple[int, int]:
    """Least word edits between ``a`` and any run of ``b`` that starts at 0..span, and the first such start; above ``most``: most + 1."""
    one = np.int64(1) << 32  # edits above, start below
    places = np.arange(len(b) + 1, dtype=np.int64)
    row = np.maximum(places - span, 0) * one + np.minimum(places, span)
    for x in a:
        step = np.minimum(row[1:] + one, row[:-1] + (b != x) * one)
        new = np.concatenate([row[:1] + one, step])
        row = np.minimum.accumulate(new - places * one) + places * one
        if row.min() >> 32 > most:
            return most + 1, 0
    best = int(row.min())
    return min(best >> 32, most + 1), best & 0xFFFFFFFF


class ItemIndex:
    """Items by window length, their vocabulary, and the keys of their embeddings."""

    def __init__(self, items: list[tuple[int, np.ndarray]], max_edits: float = MAX_EDITS):
        self.ids = [i for i, _ in items]
        self.codes = [c for _, c in items]
        self.allowed = [edits_allowed(len(c), max_edits) for c in self.codes]
        if not items:
            return
        self.vocabulary = np.unique(np.concatenate(self.codes))
        self.grams = {q: np.unique(np.concatenate([word_grams(c, q) for c in self.codes])) for q in GRAMS}
        #: item, offset and edits of every piece
        cut = [(k, *p) for k, c in enumerate(self.codes) for p in pieces(len(c), self.allowed[k])]
        self.piece_item, self.piece_at, words, edits = (np.array(x, np.int64) for x in zip(*cut, strict=True))
        sizes = np.array([window_length(int(n)) for n in words])
        self.walks = Walks(list(sizes))
        kind = np.searchsorted(self.walks.lengths, sizes)
        #: Edits that the pieces of each length allow.
        self.most = [int(edits[sizes == n].max()) for n in self.walks.lengths]
        begin = np.concatenate([[0], np.cumsum([len(c) for c in self.codes])])[self.piece_item] + self.piece_at
        keys = self.walks.embed(np.concatenate(self.codes), begin, begin + sizes, kind)
        self.owner = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.owner, axis=1)

    def windows(self, codes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, stop and kind of the windows with enough word grams of the benchmark.

        An edit brings in q unknown grams of q words at most, so no window within the allowed
        edits is passed over.
        """
        text_end = np.repeat(before[1:], np.diff(before))
        # known[q][i]: how many of the first i grams the benchmark has
        known = {}
        for q in GRAMS:
            known[q] = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(_among(word_grams(codes, q), self.grams[q]), out=known[q][1 : max(1, len(codes) - q + 2)])
        first = np.arange(len(codes))
        found = []
        for kind, n in enumerate(self.walks.lengths):
            # at the end of a text a window may lack its last words
            stop = np.minimum(first + n, text_end)
            start = first
            for q in GRAMS:
                need = n - (q - 1) - q * self.most[kind]
                if need > 0 and len(start):
                    end = stop[start] - (q - 1)
                    start = start[(end > start) & (known[q][end] - known[q][start] >= need)]
            found.append((start, stop[start], np.full(len(start), kind)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def candidates(self, codes: np.ndarray, before: np.ndarray) -> list[tuple[int, int]]:
        """(word, piece) where the window at the word agrees with the piece in the samples of a walk."""
        start, stop, kind = self.windows(codes, before)
        keys = self.walks.embed(codes, start, stop, kind)
        pairs = set()
        for r in range(REPEATS):
            lo, hi = np.searchsorted(self.keys[r], keys[r], "left"), np.searchsorted(self.keys[r], keys[r], "right")
            for w in np.flatnonzero(hi > lo):
                pairs.update((int(start[w]), int(k)) for k in self.owner[r, lo[w] : hi[w]])
        return sorted(pairs)

    def hits(self, codes: np.ndarray, before: np.ndarray) -> list[dict[int, tuple[int, int]]]:
        """For each text: item -> (edits, word position) of its nearest window."""
        found: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(before) - 1)]
        if not self.ids or not len(codes):
            return found
        spread: dict[tuple[int, int], set[int]] = {}
        for s, piece in self.candidates(codes, before):
            text, k = int(np.searchsorted(before, s, "right")) - 1, int(self.piece_item[piece])
            if len(self.codes[k]) > PIECE:
                spread.setdefault((text, k), set()).add(s - int(self.piece_at[piece]))
                continue
            own = found[text]
            most = self.allowed[k] if k not in own else own[k][0] - 1
            if most < 0:
                continue
            item = self.codes[k]
            d = edit_distance(item, codes[s : min(s + len(item) + self.allowed[k], before[text + 1])], most)
            if d <= most:
                own[k] = (d, s - int(before[text]))
        for (text, k), starts in spread.items():
            item, edits, own = self.codes[k], self.allowed[k], found[text]
            first, end = int(before[text]), int(before[text + 1])
            for lo, hi in start_ranges(sorted(starts), edits, len(item)):
                lo, most = max(lo, first), edits if k not in own else own[k][0] - 1
                if hi < lo or lo >= end or most < 0:
                    continue
                hi = min(hi, end - 1)
                d, at = nearest_start(item, codes[lo : min(hi + len(item) + edits, end)], hi - lo, most)
                if d <= most:
                    own[k] = (d, lo + at - first)
        return found


def start_ranges(starts: list[int], edits: int, words: int) -> Iterator[tuple[int, int]]:
    """Ranges in which an item may start whose pieces point to ``starts`` (ascending): edits before a piece shift it.

    Ranges that meet are verified as one, up to the length of the item.
    """
    lo = hi = None
    for s in starts:
        if lo is not None and s - edits <= hi and s + edits - lo <= words + 2 * edits:
            hi = s + edits
            continue
        if lo is not None:
            yield lo, hi
        lo, hi = s - edits, s + edits
    if lo is not None:
        yield lo, hi


def _items(batches: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
    codes, before = word_codes(pa.array([t for _, t in batches], pa.string()))
    return [(i, codes[before[k] : before[k + 1]]) for k, (i, _) in enumerate(batches) if before[k + 1] > before[k]]


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ITEM_BLOCK items; null ids and texts are left out."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).dropna()
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    for b in range(blocks):
        yield [(r.i, r.t) for r in items.filter(bucket(blocks, F.col("i"), F.col("t")) == b).collect()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Benchmark items found in each document.

    A document holds an item if some run of its words is within ``max_edits`` word edits per word
    of the item's text (case, punctuation and white space do not count; items under 8 words must
    match exactly). Items above 40 words are looked for by overlapping pieces of 20 to 40 words, any of which proposes
    the item. Every window of an item's or piece's length is considered: windows with too few words, pairs or triples of words
    of the benchmark to be that near are passed over (an edit brings in 1, 2 or 3 new ones at most, so none is lost), the others are embedded
    by 20 random walks, and those that agree with an item on 3 sampled coordinates in any walk are
    verified by exact edit distance of the whole item (over all starts that an agreeing piece implies). An item with one word in ten changed is found with
    probability above 0.99 (see the tests); an unchanged one always.

    Returns doc_id, contaminated, n_items, item_ids (ascending, each once), edits, at (word positions). The benchmark is held in
    blocks of 20,000 items, one pass over the documents each; documents are neither shuffled nor
    cut, and with more than one block the rows so far are written between passes, so that a worker
    holds one block. Null and empty texts hold nothing; repeated rows are rows of their own, null ids too; item texts
    under one item_id count as that item, by the nearest; an empty benchmark leaves all documents
    clean. Other columns are ignored.
    """
    found = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
        *[F.array().cast("array<long>").alias(c) for c in _LISTS],
    )
    found = _by_blocks(found, benchmark, max_edits, _add_hits)
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), *_LISTS)


def clean_rows(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """The rows of ``docs`` (with a column text) that hold no item, all columns kept, nothing shuffled.

    Null and empty texts hold nothing and stay; repeated rows stand or go each.
    """
    return _by_blocks(docs, benchmark, max_edits, _only_clean)


_LISTS = ("item_ids", "edits", "at")


def _by_blocks(df: DataFrame, benchmark: DataFrame, max_edits: float, passing) -> DataFrame:
    """``passing`` over ``df`` once for each block of items; what a pass leaves is written before the next one."""
    shared = None
    for block in item_blocks(benchmark):
        if shared is not None:
            df = stored(df, "cgk-block")
            shared.destroy()
        shared = df.sparkSession.sparkContext.broadcast(ItemIndex(_items(block), max_edits))
        df = df.mapInArrow(passing(shared), df.schema)
    return df


def _found(index: ItemIndex, part: pa.RecordBatch) -> list[dict[int, tuple[int, int]]]:
    codes, before = word_codes(part.column("text"))
    return index.hits(codes, before)


def _add_hits(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in slices(batch):
                before = zip(*[part.column(c).to_pylist() for c in _LISTS], strict=True)
                rows = []
                for old, new in zip(before, _found(index, part), strict=True):
                    best: dict[int, tuple[int, int]] = {}
                    for i, d, s in [*zip(*old, strict=True), *((index.ids[k], *hit) for k, hit in new.items())]:
                        best[i] = min(best.get(i, (d, s)), (d, s))
                    rows.append(sorted((i, *hit) for i, hit in best.items()))
                lists = [pa.array([[h[c] for h in x] for x in rows], pa.list_(pa.int64())) for c in range(3)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), *lists], names=["doc_id", "text", *_LISTS])

    return run


def _only_clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([not x for x in _found(index, part)], pa.bool_()))

    return run
