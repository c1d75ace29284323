"""Sharding: a minimax contiguous partition of groups of equal texts, in DataFrame operations.

Groups of equal texts are atoms.  They are ordered by the hash of their text, so that a shard is a range of hash codes
and a row finds its shard without a join.  The smallest feasible capacity is found by binary search, each capacity
checked greedily.  The check needs prefix sums of group sizes; the driver holds them for at most ``cells`` ranges of
codes and asks for finer ranges only around possible cuts, until every cut lies between two single groups.  The result
is that of the same search over all groups.

A group larger than an even share of what is left gets a shard of its own before (there are fewer of those than shards):
otherwise it would set the capacity for all, and most shards would stay empty.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from guestlens.llm.common import stored

#: Bytes that a row takes besides its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Cell:
    """Groups next to each other in code order."""

    first: int
    last: int
    size: int

    @property
    def single(self) -> bool:
        return self.first == self.last


class Profile:
    """Prefix sums over cells; where a cell holds several groups, cuts inside it are only known within bounds."""

    def __init__(self, cells: list[Cell]) -> None:
        self.cells = cells
        self.ends = list(accumulate(c.size for c in cells))
        self.total = self.ends[-1] if cells else 0

    def furthest(self, start: int, capacity: int, hopeful: bool) -> int:
        """Prefix sum where a shard that begins at ``start`` ends: a lower bound, or an upper one if hopeful."""
        reach = min(start + capacity, self.total)
        full = bisect_right(self.ends, reach)
        if full == len(self.cells):
            return self.total
        if hopeful and not self.cells[full].single:
            return reach
        return max(self.ends[full - 1] if full else 0, start)

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            at = self.furthest(at, capacity, hopeful)
            out.append(at)
        return out

    def least_capacity(self, shards: int, hopeful: bool) -> int:
        """Binary search; feasible means that the greedy shards reach the end."""
        low, high = max(self.total // max(shards, 1) - 1, 0), self.total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, hopeful)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def open_cells(self, shards: int) -> list[Cell]:
        """Cells of several groups that a cut may fall into."""
        least, most = (self.least_capacity(shards, hopeful) for hopeful in (True, False))
        out = {}
        for low, high in zip(self.cuts(least, shards, False), self.cuts(most, shards, True)):
            for i in range(bisect_right(self.ends, low), len(self.cells)):
                if self.ends[i] - self.cells[i].size >= high:
                    break
                if not self.cells[i].single:
                    out[i] = self.cells[i]
        return [out[i] for i in sorted(out)]

    def last_codes(self, shards: int) -> list[int]:
        """The code of the last group of each shard but the final one."""
        ends = self.cuts(self.least_capacity(shards, False), shards, False)
        return [self.cells[bisect_right(self.ends, end) - 1].last if end else -(2**63) for end in ends[:-1]]


def minimax_cuts(fetch: Callable[[list[tuple[int, int]], int], list[Cell]], shards: int, cells: int = 1 << 16) -> list[int]:
    """Last codes of the shards.  ``fetch(ranges, bits)`` sums groups by the code without its last bits, in ranges."""
    bits = 65 - cells.bit_length()
    profile = Profile(fetch([(-(2**63), 2**63 - 1)], bits))
    while unsure := profile.open_cells(shards):
        width, ranges = 1 << bits, []
        for cell in unsure:
            low = cell.first // width * width
            if ranges and ranges[-1][1] == low - 1:
                ranges[-1] = (ranges[-1][0], low + width - 1)
            else:
                ranges.append((low, low + width - 1))
        bits = max(0, bits - max(1, (cells // len(unsure)).bit_length() - 1))
        lows = [low for low, _ in ranges]
        at = (bisect_right(lows, c.first) - 1 for c in profile.cells)
        outside = [c for c, i in zip(profile.cells, at) if i < 0 or c.first > ranges[i][1]]
        profile = Profile(sorted(outside + fetch(ranges, bits), key=lambda c: c.first))
    return profile.last_codes(shards)


def group_fetcher(groups: DataFrame) -> Callable[[list[tuple[int, int]], int], list[Cell]]:
    """Sums by cell.  Ranges consist of whole cells of the call before, so that codes meet them by their cell's number."""
    coarse = 64

    def fetch(ranges: list[tuple[int, int]], bits: int) -> list[Cell]:
        nonlocal coarse
        inside = groups
        if coarse < 64:
            wanted = [cell for low, high in ranges for cell in range(low >> coarse, (high >> coarse) + 1)]
            # At most as many as the driver holds cells, 8 bytes each.
            listed = groups.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(wanted)), "array<bigint>")).alias("wanted"))
            inside = groups.join(F.broadcast(listed), F.shiftright("code", coarse) == F.col("wanted"), "left_semi")
        coarse = bits
        found = inside.groupBy(F.shiftright("code", bits).alias("cell")).agg(F.min("code").alias("first"), F.max("code").alias("last"), F.sum("bytes").alias("size"))
        return sorted((Cell(r["first"], r["last"], r["size"]) for r in found.collect()), key=lambda c: c.first)

    return fetch


def own_shards(largest: list[tuple[int, int]], total: int, shards: int) -> list[int]:
    """Codes of the groups, largest first, that exceed an even share of the rest."""
    out: list[int] = []
    for code, size in largest:
        if shards - len(out) <= 1 or size * (shards - len(out)) <= total:
            break
        out.append(code)
        total -= size
    return out


def shard_column(code: Column, cuts: list[int], alone: list[int]) -> Column:
    at = F.lit(0)
    for last in cuts:
        at = at + (code > last).cast("int")
    for i, single in enumerate(alone):
        at = F.when(code == single, F.lit(len(cuts) + 1 + i)).otherwise(at)
    return at.cast("int")


def shard_documents(
    docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 50_000, cells: int = 1 << 16
) -> DataFrame:
    """Every row of ``docs`` with its shard and place: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: the largest shard is as small as contiguous ranges of text groups allow.  ``size`` is the
    number of UTF-8 bytes plus 16.  A null text has no bytes and checksum 0 and goes with the empty texts.  Equal texts always share a shard, whatever their keys; null keys and repeated rows are rows like others.
    An empty table gives an empty result; with fewer groups than shards some shards stay empty.  Other columns of
    ``docs``, whatever their names, are not read.  ``slot`` counts from 0 in each shard; rows are numbered in buckets
    of about ``rows_per_bucket``, so that a large shard is numbered by many tasks; rows that repeat a key and its text are
    told apart by the partition they come from, so that not even they meet in one.
    """
    rows = stored(
        docs.select(
            F.col(key).alias("key"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("bytes"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("checksum"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("code"),
            F.spark_partition_id().alias("origin"),
        ),
        "shard-rows",
    )
    groups = stored(rows.groupBy("code").agg(F.sum("bytes").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    largest = [(r.code, r.bytes) for r in groups.orderBy(F.desc("bytes"), "code").limit(shards).collect()]
    alone = own_shards(largest, total, shards)
    rest = groups.where(~F.col("code").isin(alone)) if alone else groups
    cuts = minimax_cuts(group_fetcher(rest), shards - len(alone), cells)
    placed = rows.withColumn("shard", shard_column(F.col("code"), cuts, alone))
    return numbered(placed, rows_per_bucket).select(
        F.col("key").alias(key),
        F.col("bytes").alias("size"),
        F.col("checksum").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def numbered(placed: DataFrame, rows_per_bucket: int) -> DataFrame:
    """``slot``: a gapless number from 0 in each shard, in buckets of rows."""
    many = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    buckets = F.lit(1)
    for shard, n in many.items():
        if n > rows_per_bucket:
            buckets = F.when(F.col("shard") == shard, F.lit(-(-n // rows_per_bucket))).otherwise(buckets)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("key", "code", "origin"), buckets.cast("long")))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    place = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("key", "code", "checksum"))
    return placed.withColumn("place", place).join(offsets, ["shard", "bucket"]).withColumn(
        "slot", (F.col("offset") + F.col("place") - 1).cast("long")
    )
