"""Removal of repeated byte strings by prefix-free parsing.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller key.  Sorting
the corpus' suffixes would answer that, but repetitive corpora and memory forbid it as a whole; prefix-free parsing cuts
the work down to what differs:

* Parse.  Triggers are the k-grams with the least rolling hash among the k-grams of some string of ``LENGTH`` bytes, so
  that every such string holds one and equal strings have theirs at the same place.  The strings that share a trigger
  occurrence are one phrase: a run of starts and the bytes that they cover together, 50 to 84 of them.
* Dictionary and parse order.  Phrases are sorted by trigger, then content, then key.  A phrase that an earlier document
  has too is removed whole and never looked at again.  A trigger with a single phrase repeats nothing.
* Suffixes of the dictionary.  What is left are different phrases around one trigger; the suffixes inside them, taken up
  to ``LENGTH`` bytes, are sorted trigger by trigger, and equal neighbours of a smaller key show what is repeated.

Work is spread by trigger.  A task sends each phrase once; further copies in its chunk are decided there.  A trigger with
many different phrases in one chunk (a common word sequence) is hot: its phrases are spread by their suffixes instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from guestlens.llm.common import stored

#: Bytes of a repeated string, of a trigger, and the number of triggers' places in a string.
LENGTH = 50
GRAM = 16
PLACES = LENGTH - GRAM + 1
#: Bytes that are worked on at a time; starts of a longer document come in blocks of ``BLOCK``.
CHUNK = 2 << 20
BLOCK = 1 << 20
#: Different phrases of one trigger in a chunk from which on the trigger is hot.
HOT = 8
PLACE_BITS = np.uint64(23)
LOW_PLACE = np.uint64((1 << 23) - 1)
FACTOR = 0x9E3779B97F4A7C15
LOW48 = np.uint64((1 << 48) - 1)

WHOLE, PROBE, HOT_PROBE = 0, 1, 2
ALL = 1 << 20


@lru_cache(1)
def _fixed(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd number for each byte, the powers of the factor, and those of its inverse, modulo 2**64."""
    codes = np.random.default_rng(50).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    inverse = pow(FACTOR, -1, 2**64)
    return codes, *(np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, x, np.uint64))) for x in (FACTOR, inverse))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of all substrings of a buffer, in constant time each."""

    def __init__(self, buffer: np.ndarray) -> None:
        codes, powers, self.inverse = _fixed(CHUNK + 2 * LENGTH)
        self.sums = np.zeros(buffer.size + 1, np.uint64)
        np.cumsum(codes[buffer] * powers[: buffer.size], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, size: int) -> np.ndarray:
        count = self.sums.size - size
        return mixed((self.sums[size:] - self.sums[:count]) * self.inverse[:count])


@dataclass
class Phrases:
    """Runs of starts (first to last, in the buffer) with one trigger; ``owner`` is the piece they lie in."""

    buffer: np.ndarray
    rolling: Rolling
    base: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    last: np.ndarray
    trigger: np.ndarray
    content: np.ndarray


def parse(pieces: list[bytes]) -> Phrases:
    buffer = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces], np.int64)
    base = np.cumsum(size) - size
    rolling = Rolling(buffer)
    grams = rolling.all(GRAM)
    least = (grams & ~LOW_PLACE) | np.arange(grams.size, dtype=np.uint64)
    wide = 1
    while 2 * wide <= PLACES:
        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
    if wide < PLACES:
        least = np.minimum(least[: -(PLACES - wide)], least[PLACES - wide :])
    starts = np.ones(least.size, bool)
    for edge in (base[1:]).tolist():
        starts[max(0, edge - LENGTH + 1) : edge] = False
    start = np.flatnonzero(starts)
    place = (least[start] & LOW_PLACE).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
    first, last = start[cut], start[np.append(cut[1:], start.size) - 1]
    owner = np.searchsorted(base, first, side="right") - 1
    return Phrases(buffer, rolling, base, owner, first, last, grams[place[cut]] & LOW48, rolling.of(first, last + LENGTH) & LOW48)


def blocks(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Chunks of pieces with the number of their row and their place in it; documents shorter than a string are left out."""
    owners, places, pieces, held = [], [], [], 0
    for row, text in rows:
        for place in range(0, max(0, len(text) - LENGTH + 1), BLOCK):
            piece = text[place : place + BLOCK + LENGTH - 1]
            if held and held + len(piece) > CHUNK:
                yield owners, places, pieces
                owners, places, pieces, held = [], [], [], 0
            owners.append(row)
            places.append(place)
            pieces.append(piece)
            held += len(piece)
    if pieces:
        yield owners, places, pieces


def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, bytes]]:
    """Row numbers and UTF-8 bytes of the rows with a key (column 0) and a text."""
    keys = batch.column(0).is_valid().to_pylist()
    for i, text in enumerate(batch.column(column).cast(pa.binary())):
        if keys[i] and text.is_valid:
            yield i, text.as_py()


def packed(*parts: tuple[np.ndarray, int]) -> pa.Array:
    """Big-endian integers of so many bytes, side by side, as one binary value a row."""
    rows = parts[0][0].size
    wide = sum(n for _, n in parts)
    out, at = np.empty((rows, wide), np.uint8), 0
    for values, n in parts:
        out[:, at : at + n] = values.astype(">u8").view(np.uint8).reshape(rows, 8)[:, 8 - n :]
        at += n
    offsets = np.arange(rows + 1, dtype=np.int32) * wide
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(column: pa.Array, *sizes: int) -> list[np.ndarray]:
    raw = b"".join(column.to_pylist())
    rows = np.frombuffer(raw, np.uint8).reshape(len(column), -1)
    out, at = [], 0
    for n in sizes:
        wide = np.zeros((len(column), 8), np.uint8)
        wide[:, 8 - n :] = rows[:, at : at + n]
        out.append(wide.view(">u8").ravel().astype(np.uint64))
        at += n
    return out


def phrase_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, entry): trigger, flag and content of each phrase, once for a document.

    Flags: 0 hot trigger, 1 other, 2 known to be whole repeated, 3 a phrase of a hot trigger; the last two need no
    company and are spread by a hash.
    """
    for batch in batches:
        keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        for rows, _, pieces in blocks(texts_of(batch, 1)):
            found = parse(pieces)
            key = keys[np.array(rows)][found.owner]
            order = np.lexsort((key, found.content, found.trigger))
            trigger, content, key = found.trigger[order], found.content[order], key[order]
            new_trigger = np.concatenate([[True], trigger[1:] != trigger[:-1]])
            new_entry = new_trigger | np.concatenate([[True], content[1:] != content[:-1]])
            new_row = new_entry | np.concatenate([[True], key[1:] != key[:-1]])
            entry = np.cumsum(new_entry) - 1
            group = np.cumsum(new_trigger) - 1
            kinds = np.bincount(group[new_entry])[group]
            rank = entry - entry[new_trigger][group]
            flag = np.where(kinds > HOT, np.where(rank < HOT, 0, 3), 1)
            flag = np.where(key > key[new_entry][entry], 2, flag)
            spread = mixed(content ^ (key.astype(np.uint64) * np.uint64(FACTOR))) & LOW48
            trigger = np.where(flag >= 2, spread, trigger)
            trigger, flag, content, key = trigger[new_row], flag[new_row], content[new_row], key[new_row]
            yield pa.RecordBatch.from_arrays([pa.array(key), packed((trigger, 6), (flag, 1), (content, 6))], ["key", "entry"])


def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by (entry, key) to (key, mark): the content times 4 plus what is to be done with it.

    A row that an earlier document has too is whole repeated.  The first row of each of several contents of a trigger is
    a probe, and so is that of every content of a hot one.  State between batches: the last row, the first key of its entry, and one row that waits for a neighbour.
    """
    last: tuple[int, int, int] | None = None
    first_key, hot, waiting = 0, 0, None
    for batch in batches:
        trigger, flag, content = unpacked(batch.column(1), 6, 1, 6)
        key = batch.column(0).to_numpy()
        alone = flag >= 2
        out = [(key[alone], content[alone] * np.uint64(4) + np.where(flag[alone] == 2, WHOLE, HOT_PROBE).astype(np.uint64))]
        trigger, flag, content, key = trigger[~alone], flag[~alone], content[~alone], key[~alone]
        if key.size:
            same = np.concatenate([[last is not None and last[0] == trigger[0]], trigger[1:] == trigger[:-1]])
            again = same & np.concatenate([[last is not None and last[1:] == (flag[0], content[0])], (flag[1:] == flag[:-1]) & (content[1:] == content[:-1])])
            at = np.maximum.accumulate(np.where(again, -1, np.arange(key.size)))
            earliest = np.where(at < 0, first_key, key[at])
            start = np.maximum.accumulate(np.where(same, -1, np.arange(key.size)))
            is_hot = np.where(start < 0, hot, flag[start] == 0).astype(bool)
            whole = again & (key > earliest)
            out.append((key[whole], content[whole] * np.uint64(4)))
            entries = np.flatnonzero(~again)
            if entries.size:
                if waiting is not None:
                    if same[entries[0]]:
                        out.append((np.array([waiting[0]]), np.array([waiting[1]], np.uint64)))
                    waiting = None
                follows = np.append(same[entries[1:]], False)
                probe = entries[same[entries] | follows | is_hot[entries]]
                mark = content * np.uint64(4) + np.where(is_hot, HOT_PROBE, PROBE).astype(np.uint64)
                out.append((key[probe], mark[probe]))
                tail = entries[-1]
                if not same[tail] and not is_hot[tail]:
                    waiting = int(key[tail]), int(mark[tail])
            last = int(trigger[-1]), int(flag[-1]), int(content[-1])
            first_key, hot = int(earliest[-1]), int(is_hot[-1])
        keys, marks = np.concatenate([k for k, _ in out]), np.concatenate([m for _, m in out])
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(marks.astype(np.int64))], ["key", "mark"])


def matches(found: Phrases, content: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (phrase, wanted) of phrases of the chunk whose owner and content are wanted."""
    mine = mixed(found.content ^ (found.owner.astype(np.uint64) * np.uint64(FACTOR)))
    want = mixed(content ^ (owner.astype(np.uint64) * np.uint64(FACTOR)))
    order = np.argsort(mine, kind="stable")
    low, high = np.searchsorted(mine[order], want, "left"), np.searchsorted(mine[order], want, "right")
    count = high - low
    wanted = np.repeat(np.arange(want.size), count)
    inside = np.arange(wanted.size) - np.repeat(np.cumsum(count) - count, count)
    return order[low[wanted] + inside], wanted


def wanted_of(rows: list[int], lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of pieces and the entries of their rows' lists."""
    sizes = [len(lists[r]) for r in rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    return owner, np.concatenate([lists[r] for r in rows]) if rows else np.zeros(0, np.int64)


def suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, marks, text) to the dictionary's phrases that have to be compared: (route, key, content, at, bytes).

    Phrases go by trigger.  Those of hot triggers go string by string, each by its own hash; where a chunk holds a string
    twice, the later document's is repeated for sure and carries no bytes.
    """
    names = ["route", "key", "content", "at", "bytes"]
    for batch in batches:
        keys = batch.column(0).to_numpy()
        lists = [np.array(x, np.uint64) for x in batch.column(1).to_pylist()]
        for rows, _, pieces in blocks(texts_of(batch, 2)):
            found = parse(pieces)
            owner, marks = wanted_of(rows, lists)
            phrase, wanted = matches(found, marks >> np.uint64(2), owner)
            key = keys[np.array(rows)][owner[wanted]]
            once = np.unique(np.stack([key.astype(np.uint64), marks[wanted]]), axis=1, return_index=True)[1] if key.size else np.zeros(0, int)
            phrase, key, hot = phrase[once], key[once], (marks[wanted][once] & np.uint64(3)) == HOT_PROBE
            data = found.buffer.tobytes()
            first, last = found.first[phrase], found.last[phrase]
            plain = np.flatnonzero(~hot)
            cut = [data[a : b + LENGTH] for a, b in zip(first[plain].tolist(), last[plain].tolist())]
            out = [(found.trigger[phrase][plain], key[plain], found.content[phrase][plain], np.zeros(plain.size, np.int64), cut)]
            size = (last - first + 1) * hot
            of = np.repeat(np.arange(phrase.size), size)
            at = np.arange(of.size) - np.repeat(np.cumsum(size) - size, size)
            start = first[of] + at
            string = found.rolling.of(start, start + LENGTH) & LOW48
            order = np.lexsort((key[of], string))
            new = np.concatenate([[True], string[order][1:] != string[order][:-1]])[: order.size]
            least = key[of][order][new][np.cumsum(new) - 1] if order.size else np.zeros(0, np.int64)
            later = np.zeros(order.size, bool)
            later[order] = key[of][order] > least
            route = np.where(later, mixed(string ^ key[of].astype(np.uint64) * np.uint64(FACTOR)) & LOW48, string)
            cut = [None if gone else data[a : a + LENGTH] for a, gone in zip(start.tolist(), later.tolist())]
            out.append((route, key[of], found.content[phrase][of], at, cut))
            columns = [np.concatenate([x[i] for x in out]).astype(np.int64) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3].astype(np.int32)), pa.array(out[0][4] + out[1][4], pa.binary())], names
            )


def compared(route: np.ndarray, key: np.ndarray, contents: list[bytes]) -> list[list[tuple[int, int]]]:
    """Of each phrase, the runs of its strings that also are in a phrase of the same route with a smaller key."""
    size = np.array([len(c) for c in contents], np.int64)
    base = np.cumsum(size) - size
    count = size - LENGTH + 1
    of = np.repeat(np.arange(size.size), count)
    at = np.arange(of.size) - np.repeat(np.cumsum(count) - count, count)
    start = base[of] + at
    string = Rolling(np.frombuffer(b"".join(contents), np.uint8)).of(start, start + LENGTH)
    order = np.lexsort((key[of], string, route[of]))
    r, s, k = route[of][order], string[order], key[of][order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1])])
    repeated = np.zeros(of.size, bool)
    repeated[order] = k > k[new][np.cumsum(new) - 1]
    out: list[list[tuple[int, int]]] = [[] for _ in contents]
    hit = np.flatnonzero(repeated)
    if hit.size:
        cut = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])]))
        for a, b in zip(hit[cut].tolist(), hit[np.append(cut[1:], hit.size) - 1].tolist()):
            out[of[a]].append((int(at[a]), int(at[b])))
    return out


def repeated_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases sorted by route to (key, content, start, end): runs of repeated strings in them."""
    held: list[tuple[int, int, int, int, bytes | None]] = []
    size = 0

    def settle(rows: list[tuple[int, int, int, int, bytes | None]]) -> pa.RecordBatch:
        out = [(k, c, at, at) for _, k, c, at, b in rows if b is None]
        rows = [x for x in rows if x[4] is not None]
        if rows:
            runs = compared(np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), [x[4] for x in rows])
            out += [(k, c, at + a, at + b) for (_, k, c, at, _), spans in zip(rows, runs) for a, b in spans]
        table = np.array(out, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([*(pa.array(table[:, i]) for i in (0, 1)), *(pa.array(table[:, i].astype(np.int32)) for i in (2, 3))], ["key", "content", "start", "end"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size > CHUNK // 2 and row[0] != held[-1][0]:
                yield settle(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4] or b"") + 8
    if held:
        yield settle(held)


def removed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, content, start, end, text) to (key, n_bytes, spans, kept): lists of runs become bytes removed."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for whole in batches:
        for begin in range(0, whole.num_rows, 1_000):
            batch = whole.slice(begin, 1_000)
            wanted = [[np.array(x or [], np.int64) for x in batch.column(i).to_pylist()] for i in (1, 2, 3)]
            texts = [t if t is not None else b"" for t in batch.column(4).cast(pa.binary()).to_pylist()]
            edges: list[list[np.ndarray]] = [[] for _ in texts]
            for rows, places, pieces in blocks((i, t) for i, t in texts_of(batch, 4) if wanted[0][i].size):
                found = parse(pieces)
                owner, content = wanted_of(rows, wanted[0])
                start, end = (wanted_of(rows, w)[1] for w in wanted[1:])
                phrase, which = matches(found, content.astype(np.uint64), owner)
                low = found.first[phrase] + start[which]
                high = np.minimum(found.first[phrase] + end[which], found.last[phrase]) + LENGTH
                piece = found.owner[phrase]
                shift = np.array(places)[piece] - found.base[piece]
                order = np.argsort(piece, kind="stable")
                bounds = np.searchsorted(piece[order], np.arange(len(rows) + 1))
                both = np.stack([low + shift, high + shift], axis=1)[order]
                for i, row in enumerate(rows):
                    if bounds[i] < bounds[i + 1]:
                        edges[row].append(both[bounds[i] : bounds[i + 1]])
            spans, kept = [], []
            for text, found_here in zip(texts, edges):
                runs = merged(np.concatenate(found_here)) if found_here else []
                spans.append([{"start": a, "end": b} for a, b in runs])
                left = [0, *(b for _, b in runs)], [*(a for a, _ in runs), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(*left)) if runs else text)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(spans, span), pa.array(kept, pa.binary())], ["key", "n_bytes", "spans", "kept"])


def merged(runs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by (start, end) rows; runs that touch are one."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    cut = np.flatnonzero(np.concatenate([[True], runs[1:, 0] > reach[:-1]]))
    return list(zip(runs[cut, 0].tolist(), reach[np.append(cut[1:], len(runs)) - 1].tolist()))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``n_bytes``, removed ``spans`` (in bytes, end exclusive) and the ``kept`` bytes.

    ``key`` is an integer.  A byte goes if a string of 50 bytes around it also starts in a row with a smaller key;
    strings never cross rows, and what counts is the text as given, not what is left of it.  Null texts have no bytes.
    Rows with a null key neither lose bytes nor make others lose any.  Rows that share a key (repeated rows) never count
    against each other.  Texts of any length are read whole, in blocks.  An empty table gives an empty result; other
    columns are not read.  Strings are compared by hashes of 96 bits or more.
    """
    every = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("body"))
    rows = every.where("key IS NOT NULL")  # both joins below read the same exchange of these rows
    entries = rows.mapInArrow(phrase_rows, "key long, entry binary")
    entries = entries.repartition(F.expr("substring(entry, 1, 6)")).sortWithinPartitions("entry", "key")
    marks = stored(entries.mapInArrow(decided, "key long, mark long"), "repeat-marks")
    kind = F.col("mark").bitwiseAND(F.lit(3))
    probes = marks.where(kind != WHOLE).groupBy("key").agg(F.collect_list("mark").alias("marks"))
    suffixes = rows.join(probes.hint("shuffle_hash"), "key").select("key", "marks", "body").mapInArrow(
        suffix_rows, "route long, key long, content long, at int, bytes binary"
    )
    runs = suffixes.repartition("route").sortWithinPartitions("route").mapInArrow(repeated_runs, "key long, content long, start int, end int")
    whole = marks.where(kind == WHOLE).select("key", F.shiftright("mark", 2).alias("content"), F.lit(0).alias("start"), F.lit(ALL).alias("end"))
    lists = whole.union(runs).groupBy("key").agg(F.collect_list(F.struct("content", "start", "end")).alias("runs"))
    listed = rows.join(lists.hint("shuffle_hash"), "key", "left").select("key", "runs.content", "runs.start", "runs.end", "body")
    nothing = [F.lit(None).cast(f"array<{t}>").alias(c) for c, t in (("content", "long"), ("start", "int"), ("end", "int"))]
    listed = listed.union(every.where("key IS NULL").select("key", *nothing, "body"))
    return listed.mapInArrow(removed_rows, "key long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("key", key)
