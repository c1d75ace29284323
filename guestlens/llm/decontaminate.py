"""Passages of benchmark items in documents.

For each item, windows of its size are laid at every place of a document where they hold a shingle of the item (others
have similarity 0).  A window's SimHash is the sign of the sums of its shingles' bits, so prefix sums give it at any place.
A multi-index over the items' fingerprints, eight tables by one byte each that list every item within two bits of the
byte, finds all items within ``RADIUS`` bits: a pair with at least three differing bits in each byte differs in 24.
Candidates are verified by the exact weighted similarity: the share of the item's shingles, each as often as it occurs,
that the window has too (both have equally many).  A document that is shorter than the item is one window, verified alike
for every item of which it holds enough shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from guestlens.llm.common import byte_slices, to_python
from guestlens.llm.shingles import SHINGLE, shingle_hashes, word_hashes, words_of

THRESHOLD = 0.8
RADIUS = 23
#: Items that go to the executors at a time, and the bytes of their texts; more items take more passes.
ITEMS_PER_PASS = 20_000
BYTES_PER_PASS = 16 << 20
SLICE_BYTES = 2 << 20
#: Hits further apart than this are worked on apart, and so are runs of so many.
GAP = 2_000
FILTER_BITS = 20


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints from sums of +1 and -1 by bit."""
    return np.packbits(sums > 0, axis=-1).view(np.uint64).ravel()


def signs(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 entries +1 or -1 for each shingle."""
    return np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


@dataclass(frozen=True)
class Hit:
    item: object
    similarity: float
    start: int
    words: int


class Items:
    """Fingerprints, shingles and indexes of benchmark items; those of fewer than five words are left out."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.keys, sets = [], []
        for key, text in items:
            hashes = word_hashes(words_of(text))
            if hashes.size >= SHINGLE:
                self.keys.append(key)
                sets.append(shingle_hashes(hashes))
        self.size = np.array([s.size for s in sets], np.int64)
        self.bags = [dict(zip(*(x.tolist() for x in np.unique(s, return_counts=True)))) for s in sets]
        self.prints = fingerprints(np.array([signs(s).sum(0) for s in sets], np.int32).reshape(-1, 64))
        owner = np.repeat(np.arange(len(sets)), [len(b) for b in self.bags])
        every = np.array([x for b in self.bags for x in b], np.uint64)
        order = np.argsort(every, kind="stable")
        self.shingle, self.owner = every[order], owner[order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.shingle >> np.uint64(64 - FILTER_BITS)] = True
        self.tables = [self._near(self.prints.view(np.uint8).reshape(-1, 8)[:, b]) for b in range(8)]

    @staticmethod
    def _near(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items by byte value, listed under every value within two bits: offsets and items."""
        masks = np.array([m for m in range(256) if m.bit_count() <= 2], np.uint8)
        value = (column[:, None] ^ masks[None, :]).ravel()
        item = np.repeat(np.arange(column.size), masks.size)
        order = np.argsort(value, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(value, minlength=256))]), item[order]

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (print, item) within the radius."""
        pairs = []
        for b, (offset, item) in enumerate(self.tables):
            value = prints.view(np.uint8).reshape(-1, 8)[:, b].astype(np.int64)
            count = offset[value + 1] - offset[value]
            which = np.repeat(np.arange(prints.size), count)
            inside = np.arange(which.size) - np.repeat(np.cumsum(count) - count, count)
            pairs.append(which * len(self.keys) + item[offset[value][which] + inside])
        found = np.unique(np.concatenate(pairs))
        which, item = found // max(1, len(self.keys)), found % max(1, len(self.keys))
        close = np.bitwise_count(prints[which] ^ self.prints[item]) <= RADIUS
        return which[close], item[close]

    def postings(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles that items have, once for each such item, and the items."""
        place = np.flatnonzero(self.maybe[shingles >> np.uint64(64 - FILTER_BITS)])
        low = np.searchsorted(self.shingle, shingles[place], "left")
        count = np.searchsorted(self.shingle, shingles[place], "right") - low
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(place, count), self.owner[np.repeat(low, count) + inside]

    def similarity(self, item: int, window: np.ndarray) -> float:
        bag = self.bags[item]
        left = dict(bag)
        shared = 0
        for x in window.tolist():
            if left.get(x, 0) > 0:
                left[x] -= 1
                shared += 1
        return shared / int(self.size[item])

    def hits(self, shingles: np.ndarray, place: np.ndarray, item: np.ndarray, threshold: float) -> list[Hit]:
        """The best window of each item that reaches the threshold; the first of equals."""
        best = self._short(shingles, item, threshold)
        cut = np.flatnonzero(np.diff(place) > GAP) + 1
        for at in np.split(np.arange(place.size), cut):
            for part in range(0, at.size, GAP):
                run = at[part : part + GAP]
                self._search(shingles, place[run], item[run], threshold, best)
        return [Hit(self.keys[i], s, -start, min(int(self.size[i]), shingles.size) + SHINGLE - 1) for i, (s, start) in sorted(best.items())]

    def _short(self, shingles: np.ndarray, item: np.ndarray, threshold: float) -> dict[int, tuple[float, int]]:
        """The whole document as the window of items longer than it; ``item`` has one entry for each shared place."""
        found, places = np.unique(item, return_counts=True)
        enough = (self.size[found] > shingles.size) & (places >= threshold * self.size[found] - 1e-9)
        rated = {int(i): self.similarity(int(i), shingles) for i in found[enough]}
        return {i: (s, 0) for i, s in rated.items() if s >= threshold}

    def _search(self, shingles: np.ndarray, place: np.ndarray, item: np.ndarray, threshold: float, best: dict[int, tuple[float, int]]) -> None:
        size = self.size[item]
        low, high = np.maximum(0, place - size + 1), np.minimum(place, shingles.size - size)
        count = np.maximum(0, high - low + 1)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        wide = int(self.size.max()) + 1
        windows = np.unique((np.repeat(low, count) + inside) * wide + np.repeat(size, count))
        if not windows.size:
            return
        start, size = windows // wide, windows % wide
        first, last = int(start.min()), int((start + size).max())
        sums = np.zeros((last - first + 1, 64), np.int32)
        np.cumsum(signs(shingles[first:last]), axis=0, out=sums[1:])
        which, found = self.within(fingerprints(sums[start + size - first] - sums[start - first]))
        same = self.size[found] == size[which]
        for w, i in zip(which[same].tolist(), found[same].tolist()):
            at = int(start[w])
            rated = self.similarity(i, shingles[at : at + int(size[w])]), -at
            if rated[0] >= threshold and rated > best.get(i, (0.0, 0)):
                best[i] = rated

    def search(self, texts: list[str | None], threshold: float) -> list[list[Hit]]:
        words = [words_of(t) for t in texts]
        count = np.array([len(w) for w in words])
        hashes = word_hashes([w for one in words for w in one])
        ends = np.cumsum(count)
        out: list[list[Hit]] = [[] for _ in texts]
        if hashes.size < SHINGLE or not self.keys:
            return out
        shingles = shingle_hashes(hashes)
        place, item = self.postings(shingles)
        owner = np.searchsorted(ends, place, side="right")
        whole = place + SHINGLE <= ends[owner]
        place, item, owner = place[whole], item[whole], owner[whole]
        cut = np.flatnonzero(np.diff(owner)) + 1
        for run in np.split(np.arange(place.size), cut):
            if run.size:
                i = int(owner[run[0]])
                begin = int(ends[i] - count[i])
                out[i] = self.hits(shingles[begin : int(ends[i]) - SHINGLE + 1], place[run] - begin, item[run], threshold)
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", threshold: float = THRESHOLD, leaks: str = "leaks") -> DataFrame:
    """``docs`` with a column ``leaks``: an array of (item, similarity, start, words), the best window of each item found.

    Words are lower-case runs of letters and digits; ``start`` counts words.  All rows and columns are kept; a column
    of that name is replaced.  A document shorter than an item is compared with it as a whole.  Null and empty texts hold nothing; null texts and items of fewer than five words
    are left out, null item keys are keys like others, and items with equal texts are all reported.  An empty benchmark or
    an empty table gives empty arrays or an empty table.  The benchmark goes to the executors in passes of bounded size;
    documents never move.
    """
    names = [c for c in docs.columns if c != leaks]
    items = benchmark.select(F.col(item).alias("item"), F.col("text").alias("text")).where("text IS NOT NULL")
    amount = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(1, -(-amount["n"] // ITEMS_PER_PASS), -(-amount["bytes"] // BYTES_PER_PASS))
    kind = benchmark.schema[item].dataType.simpleString()
    found = docs.select(*(f"`{c}`" for c in names)).withColumn(leaks, F.expr(f"CAST(array() AS array<struct<item:{kind},similarity:double,start:int,words:int>>)"))
    for turn in range(passes):
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == turn) if passes > 1 else items
        found = one_pass(found, sorted(map(tuple, some.collect()), key=repr), names, text, threshold, leaks)
    return found


def one_pass(docs: DataFrame, items: list[tuple[object, str]], names: list[str], text: str, threshold: float, column: str) -> DataFrame:
    place = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(items)
    loaded: list[Items] = []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not loaded:
            loaded.append(Items(shared.value))
        for piece in byte_slices(batches, text, SLICE_BYTES):
            hits = loaded[0].search(piece.column(place).to_pylist(), threshold)
            before = piece.column(len(names)).to_pylist()
            leaks = [b + [{"item": h.item, "similarity": h.similarity, "start": h.start, "words": h.words} for h in x] for b, x in zip(before, hits)]
            yield pa.RecordBatch.from_arrays([*piece.columns[: len(names)], pa.array(leaks, piece.column(len(names)).type)], [*names, column])

    return to_python(docs, work, docs.schema)
