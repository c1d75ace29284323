"""The prefix trie of conversations, by union-find over sorted neighbours.

Conversations are sequences of turns, each turn a 16-byte digest of role and text.  They are sorted by range, so that
those with a common prefix lie next to each other; the length of the common prefix (LCP) of two neighbours is an edge.  In a
block of neighbours the edges are taken in descending depth: each joins two components, and the node at that depth, where
they branch, stands for the joined one.  On the way up to it a component passes the nodes in between, which have one child.

A node that the first or the last conversation of a block runs through may go on in the next block.  Such nodes stay open:
what is known of them is contracted to the two conversations at the edges, as sums at each depth.  These are the
conversations of the next round, where the forests of many blocks are merged in the same way, until there is one block.
Closed nodes below an open one get its name from a short table at last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from guestlens.llm.common import stored, to_python
from guestlens.plans.search import small_enough

#: Bytes of a turn's digest.
SYMBOL = 16
#: Conversations of a block, and blocks of neighbours that a later round merges in one task.
BLOCK_ROWS = 4096
MERGED = 256
NO_ENDS = sha256(b"").hexdigest()
SUMS = ("members", "least", "children", "leaves", "saved")

UNIT = {
    "chunk": "long", "place": "long", "symbols": "binary", "sizes": "array<int>", "conv_id": "long",
    **{name: "array<long>" for name in SUMS},
}
NODE = {
    "conv_id": "long", "depth": "int", "parent_conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long",
    "saved_tokens": "long", "ends_sha256": "string", "key": "binary", "parent_key": "binary",
}
ENDED = {"key": "binary", "conv_id": "long"}
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
}
#: A task gives rows of three kinds, each in a column of its own.
OUT = {"node": NODE, "unit": UNIT, "ended": ENDED}
OUT_DDL = ", ".join(f"{name} struct<{','.join(f'{k}:{v}' for k, v in kind.items())}>" for name, kind in OUT.items())
OUT_ARROW = pa.schema([(name, pa.struct([(k, ARROW[v]) for k, v in kind.items()])) for name, kind in OUT.items()])


@dataclass
class Unit:
    """A conversation, or the contracted edge of a block: sums at each depth of what hangs there."""

    symbols: bytes
    sizes: list[int]
    conv_id: int | None
    sums: list[list[Any]] | None = None

    @property
    def depth(self) -> int:
        return len(self.symbols) // SYMBOL


@dataclass
class Component:
    """Joined conversations and the node that they share at ``top``: its sums so far, children and ends."""

    unit: Unit
    top: int
    sums: list
    side: int | None = None
    waiting: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    above: dict[int, list] = field(default_factory=dict)


def add(a: list, b: list) -> list:
    least = [x for x in (a[1], b[1]) if x is not None]
    return [a[0] + b[0], min(least, default=None), a[2] + b[2], a[3] + b[3], a[4] + b[4]]


def common_turns(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // SYMBOL
    differ = np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size)
    return int(differ.argmax()) // SYMBOL


class Forest:
    """Nodes, ends of open nodes, and edges of one block after another, as lists."""

    def __init__(self) -> None:
        self.nodes: list[list] = []
        self.ended: list[tuple[bytes, int]] = []

    def key(self, unit: Unit, depth: int) -> bytes:
        return sha256(unit.symbols[: SYMBOL * depth]).digest()[:SYMBOL]

    def scan(self, units: list[Unit], closing: bool) -> list[Unit]:
        """Join neighbours; the contracted edges, none if ``closing``."""
        last = len(units) - 1
        edges = [(i, common_turns(units[i].symbols, units[i + 1].symbols)) for i in range(last)]
        parent = list(range(len(units)))
        components: list[Component | None] = []
        for i, unit in enumerate(units):
            above = {d: list(s) for d, s in enumerate(unit.sums or ()) if s[0] or s[2]}
            own = above.pop(unit.depth, [0, None, 0, 0, 0]) if unit.sums else [1, unit.conv_id, 0, 0, 0]
            side = None if closing or i not in (0, last) else 0 if i == 0 else 1
            components.append(Component(unit, unit.depth, own, side, ends=[] if unit.sums else [unit.conv_id], above=above))
        deep: list[dict[int, list]] = [{}, {}]

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def pass_node(c: Component) -> None:
            """Leave the node at the top: close it, or put it down at the edge."""
            if c.side is None:
                members, least, children, leaves, saved = c.sums
                leaves = leaves if children else 1
                saved += (members - 1) * c.unit.sizes[c.top - 1] if c.top else 0
                key = self.key(c.unit, c.top) if c.unit.sums else None
                ends = sha256(",".join(map(str, sorted(c.ends))).encode()).hexdigest() if c.ends else NO_ENDS
                self.nodes.append([least, c.top, None, members, children, leaves, saved, ends, key, None])
                for row in c.waiting:
                    self.nodes[row][2] = least
                c.waiting, carried = [len(self.nodes) - 1], [members, least, 1, leaves, saved]
            else:
                deep[c.side][c.top] = c.sums
                if c.waiting or c.ends:
                    key = self.key(c.unit, c.top)
                    for row in c.waiting:
                        self.nodes[row][9] = key
                    self.ended += [(key, conv) for conv in c.ends]
                c.waiting, carried = [], [0, None, 0, 0, 0]
            c.top, c.ends = c.top - 1, []
            c.sums = add(carried, c.above.pop(c.top, [0, None, 0, 0, 0]))

        for i, depth in sorted(edges, key=lambda e: -e[1]):
            a, b = find(i), find(i + 1)
            x, y = components[a], components[b]
            for c in (x, y):
                while c.top > depth:
                    pass_node(c)
            large, small = (x, y) if len(x.above) + len(x.waiting) >= len(y.above) + len(y.waiting) else (y, x)
            large.sums = add(x.sums, y.sums)
            large.waiting += small.waiting
            large.ends += small.ends
            for d, sums in small.above.items():
                large.above[d] = add(large.above[d], sums) if d in large.above else sums
            sides = [s for s in (x.side, y.side) if s is not None]
            large.side = min(sides, default=None)
            if x.side is not None or y.side is not None:
                large.unit = x.unit if x.side is not None and (y.side is None or x.side <= y.side) else y.unit
            parent[b] = a
            components[a], components[b] = large, None
        whole = components[find(0)]
        while whole.top >= 0:
            pass_node(whole)
        if closing:
            return []
        out = [Unit(u.symbols, u.sizes, None, [deep[side].get(d, [0, None, 0, 0, 0]) for d in range(u.depth + 1)]) for side, u in ((0, units[0]), (1, units[last]))]
        return out[: len(units)]


def forest_rows(block_rows: int, closing: bool) -> Any:
    """Rows of a chunk, in order, to nodes, ends and the chunk's two contracted edges; everything is closed if ``closing``."""
    def chunk_rows(chunk: int, units: Iterator[Unit]) -> tuple[Forest, list[Unit]]:
        forest, edges, block = Forest(), [], []
        for unit in units:
            block.append(unit)
            if len(block) == block_rows and not closing:
                edges += forest.scan(block, False)
                block = []
        edges += forest.scan(block, closing) if block else []
        # The forests of the blocks are merged in the same way.
        return forest, forest.scan(edges, False) if len(edges) > 2 else edges

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple[int, Unit]]:
            for batch in batches:
                for r in batch.to_pylist():
                    sums = [list(s) for s in zip(*(r[c] for c in SUMS))] if r["members"] is not None else None
                    yield r["chunk"], Unit(r["symbols"], r["sizes"], r["conv_id"], sums)

        rows = flat()
        ahead = next(rows, None)
        while ahead is not None:
            chunk = ahead[0]

            def of_chunk() -> Iterator[Unit]:
                nonlocal ahead
                while ahead is not None and ahead[0] == chunk:
                    unit = ahead[1]
                    ahead = next(rows, None)
                    yield unit

            forest, edges = chunk_rows(chunk, of_chunk())
            yield from packed(forest, edges, chunk)

    return work


def packed(forest: Forest, edges: list[Unit], chunk: int) -> Iterator[pa.RecordBatch]:
    nodes = [dict(zip(NODE, n)) for n in forest.nodes]
    units = [{"chunk": chunk, "place": i, "symbols": u.symbols, "sizes": u.sizes} | dict(zip(SUMS, map(list, zip(*u.sums)))) for i, u in enumerate(edges)]
    ended = [dict(zip(ENDED, e)) for e in forest.ended]
    for kind, rows in (("node", nodes), ("unit", units), ("ended", ended)):
        for start in range(0, len(rows), BLOCK_ROWS):
            yield pa.RecordBatch.from_pylist([{kind: r} for r in rows[start : start + BLOCK_ROWS]], schema=OUT_ARROW)


def joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, conv_id) in order to the hash of each key's conv_ids, joined by commas; none are held."""
    last, state = None, sha256()
    for batch in batches:
        keys, hashes = [], []
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != last:
                if last is not None:
                    keys.append(last)
                    hashes.append(state.hexdigest())
                last, state = key, sha256(str(conv).encode())
            else:
                state.update(f",{conv}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends"])


def conversation_turns(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of their place, digest and code points.

    Null turns come first, equal ones by digest; a null role or text is empty.  Rows with a null key take no part.
    """
    who, said = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    mark = F.substring(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256), 1, 2 * SYMBOL)
    rows = turns.where(F.col(key).isNotNull()).select(
        F.col(key).alias("conv_id"), F.struct(F.col(turn).alias("turn"), mark.alias("mark"), F.length(said).alias("size")).alias("said")
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))


def shared_openings(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first turns are those of the conversation that opens their hundred.

    h, the crc32 of the key's digits modulo ``most``, turns come from there, fewer if it has fewer; then follow the
    conversation's own turns after its first h.  One may have no turns at all then.
    """
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, most - 1).alias("first"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    joined = convs.withColumn("head", F.col("conv_id") - F.col("conv_id") % every).join(heads, "head", "left")
    opening = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), h)
    return joined.select("conv_id", F.concat(opening, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def prefix_nodes(convs: DataFrame, block_rows: int = BLOCK_ROWS, merged: int = MERGED) -> DataFrame:
    """Every node of the trie of (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns, named by its smallest conversation; the root is the empty one.  ``saved_tokens``
    counts, in the node's whole subtree, the code points of each last turn once for every conversation but one.
    Equal conversations share all nodes, one without turns ends at the root.  Without conversations there are no nodes.
    A conversation is held in one row, 16 bytes for a turn.  The ends of one node are hashed in one pass, as their hash
    is one of a joined text; a task reads them as a sorted stream.
    """
    units = convs.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.unhex(F.array_join(F.transform("turns", lambda t: t["mark"]), "")).alias("symbols"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )
    units = stored(units, "conversations")
    order = units.repartitionByRange("symbols", "conv_id").sortWithinPartitions("symbols", "conv_id")
    no_sums = [F.lit(None).cast("array<long>").alias(c) for c in SUMS]
    rows = order.select(F.spark_partition_id().cast("long").alias("chunk"), F.lit(0).cast("long").alias("place"), "symbols", "sizes", "conv_id", *no_sums)
    rounds, closing = [], False
    while True:
        rounds.append(stored(to_python(rows, forest_rows(block_rows, closing), OUT_DDL), "forests"))
        if closing:
            break
        edges = rounds[-1].where("unit IS NOT NULL").select("unit.*")
        closing = (edges.agg(F.max("chunk")).first()[0] or 0) < merged
        wider = edges.withColumn("before", F.col("chunk")).withColumn("chunk", F.floor(F.col("chunk") / merged))
        rows = wider.repartition("chunk").sortWithinPartitions("chunk", "before", "place").drop("before")

    nodes, ended = rounds[0], rounds[0].where("ended IS NOT NULL").select("ended.*")
    for more in rounds[1:]:
        nodes = nodes.unionAll(more)
    nodes = nodes.where("node IS NOT NULL").select("node.*")
    ends = to_python(ended.repartition("key").sortWithinPartitions("key", "conv_id"), joined_ends, "key binary, ends string")
    named = nodes.where("key IS NOT NULL").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends", "ends_sha256")).drop("ends")
    names = small_enough(named.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("named")), 100)
    known = nodes.where("key IS NULL").unionByName(named)
    root = units.agg(F.min("conv_id")).first()[0]
    over = known.where("parent_key IS NOT NULL AND depth > 1").join(names, "parent_key").withColumn("parent_conv_id", F.col("named")).drop("named")
    rest = known.where("parent_key IS NULL OR depth <= 1")
    rest = rest.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("parent_conv_id")))
    wide = [c for c in NODE if c not in ("key", "parent_key")]
    return rest.unionByName(over).select(*(F.col(c).cast("long") if NODE[c] == "int" else F.col(c) for c in wide))
