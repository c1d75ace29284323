"""A manifest of a table as a Merkle tree in each group of rows, with a proof for every row, in DataFrame operations.

Rows get gapless ranks in their group.  The digits of a rank in base ``FAN`` say where a row hangs.  Within blocks of
``FAN ** LEVELS`` rows the last digit is grouped away, then the one before it, and so on: each time the children of a node
are nested into it as an array of structs, in order, and its hash is that of their hashes.  So a block becomes one row
that holds its whole subtree, of bounded size.  The blocks' hashes are the rows of the next round, until a group has one.

Proofs come out of the nested structs: at each level an array is transformed to its elements with what stands left and
right of each, and exploded.  Inside a block that needs no join; between rounds a block is joined with the path above it,
one row for ``FAN ** LEVELS`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from guestlens.llm.common import stored
from guestlens.plans.search import small_enough

BITS, LEVELS = 3, 4
FAN = 1 << BITS
BLOCK = FAN**LEVELS
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_code(group: Column) -> Column:
    """A text for each group that is never null: null sorts first, the others bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``place``: the rank from 0 of each row in its ``group``, and ``n``: the number of its rows.

    Rows are dealt out and sorted by range and numbered where they lie; the numbers of the ranges before are added.
    Equal rows are dealt out by the partition that they come from; which of them comes first makes no difference.
    """
    dealt = rows.withColumn("from", F.spark_partition_id()).repartitionByRange("group", *order, "from")
    lying = stored(dealt.drop("from").sortWithinPartitions("group", *order).withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    lying = lying.withColumn("part", F.shiftright("at", 33))
    pieces = lying.groupBy("group", "part").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    group = W.partitionBy("group")
    before = F.sum("rows").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = pieces.select("group", "part", (F.coalesce(before, F.lit(0)) - F.col("start")).alias("shift"), F.sum("rows").over(group).alias("n"))
    return lying.join(small_enough(offsets, 100), ["group", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """Blocks (group, n, place, hash, inside) of nodes (group, n, place, hash, inside)."""
    digits = [F.shiftright("place", BITS * level).bitwiseAND(FAN - 1).cast("int").alias(f"d{level}") for level in range(LEVELS)]
    rows = nodes.select("group", "n", F.floor(F.col("place") / BLOCK).alias("block"), *digits, "hash", "inside").repartition("group", "block")
    for level in range(LEVELS):
        left = [f"d{i}" for i in range(level + 1, LEVELS)]
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{level}").alias("digit"), "hash", "inside")))
        rows = rows.groupBy("group", "n", "block", *left).agg(kids.alias("inside"))
        joined = F.array_join(F.transform("inside", lambda k: k["hash"]), "")
        # A group's last node is not hashed again.
        rows = rows.withColumn("hash", F.when(F.col("n") > FAN**level, F.sha2(joined, 256)).otherwise(F.get("inside", F.lit(0))["hash"]))
    return rows.withColumnRenamed("block", "place")


def built(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of each round, from the leaves up; the last has one block a group, its hash is the group's."""
    rounds, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        rounds.append(stored(rolled_up(nodes), "merkle-blocks"))
        most = -(-most // BLOCK)
        if most <= 1:
            return rounds
        nodes = rounds[-1].select("group", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("place").alias("place"), "hash", F.struct("place").alias("inside"))


def unfolded(blocks: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Each node of the blocks, with ``carried`` columns and its ``path``: what is hashed left and right of it, level by level."""
    for level in reversed(range(LEVELS)):
        hashes = F.transform("inside", lambda k: k["hash"])

        def placed(kid: Column, i: Column) -> Column:
            before, after = (F.array_join(x, "") for x in (F.slice(hashes, F.lit(1), i), F.slice(hashes, i + 2, F.lit(FAN))))
            return F.struct(kid["hash"].alias("hash"), kid["inside"].alias("inside"), F.struct(before.alias("left"), after.alias("right")).alias("step"))

        each = blocks.select("group", "n", *carried, "path", F.explode(F.transform("inside", placed)).alias("kid"))
        path = F.when(F.col("n") > FAN**level, F.concat(F.array("kid.step"), "path")).otherwise(F.col("path"))
        blocks = each.select("group", "n", *carried, path.alias("path"), F.col("kid.hash").alias("hash"), F.col("kid.inside").alias("inside"))
    return blocks


def proved(rounds: list[DataFrame], top: DataFrame, carried: Sequence[str]) -> DataFrame:
    """The nodes that the first round was built from, with paths to what ``top`` (group, place, path, carried) has."""
    for i, blocks in reversed(list(enumerate(rounds))):
        found = unfolded(blocks.join(top, ["group", "place"]), carried)
        top = found.select("group", F.col("inside.place").alias("place"), "path", *carried) if i else found
    return top


def merkle_manifest(
    docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: Column | None = None, changes: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Every row's key, leaf, subroot, root, proof_sha256, folded_root and verified.

    A leaf is the SHA-256 of the row's ``fields``, each with its length, nulls as ``-``.  In each group leaves stand by key
    (null first), equal keys by leaf; every ``FAN`` of them, then of their hashes, become one hash until one is left, the
    subroot.  Subroots, null group first and the others bytewise, become the root in the same way.  ``proof_sha256`` is the
    SHA-256 of all siblings from the leaf to the root.  ``folded_root`` is worked out from the leaf and its siblings, after
    ``changes`` to fields of the rows that ``tampered`` names (null: no change); ``verified`` says whether it is the root.
    A table of one row is its own root, its proof is that of no siblings.  Rows that repeat a key are leaves of their own.
    An empty table gives an empty result; other columns are not read.
    """
    def leaf(alter: Mapping[str, Callable[[Column], Column]]) -> Column:
        return digest(*[field_text(alter[f](F.col(f)) if f in alter else F.col(f)) for f in fields])

    changed = F.when(tampered, leaf(changes or {})) if tampered is not None else F.lit(None).cast("string")
    leaves = stored(docs.select(group_code(F.col(group)).alias("group"), F.col(key).alias("key"), leaf({}).alias("hash"), changed.alias("changed")), "merkle-leaves")
    forest = built(ranked(leaves, ["key", "hash"]).select("group", "n", "place", "hash", F.struct("key", "changed").alias("inside")))
    subroots = forest[-1].select(F.lit("").alias("group"), F.col("group").alias("of"), "hash")
    above = built(ranked(subroots, ["of"]).select("group", "n", "place", "hash", F.struct("of").alias("inside")))
    start = above[-1].select("group", "place", F.col("hash").alias("root"), F.array().cast(PATH).alias("path"))
    tops = proved(above, start, ["root"]).select(
        F.col("inside.of").alias("group"), F.lit(0).cast("long").alias("place"), "path", "root", F.col("hash").alias("subroot")
    )
    found = proved(forest, tops, ["root", "subroot"])
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    folded = F.aggregate("path", F.coalesce("inside.changed", "hash"), lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))
    return found.select(
        F.col("inside.key").alias(key), F.col("hash").alias("leaf"), "subroot", "root",
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
