"""Near duplicates by ProbMinHash over weighted five-word shingles.

Signatures.  Each shingle of a text is a Poisson process with its number of occurrences as rate; each arrival goes to a
random register, which keeps the shingle of the earliest.  A shingle whose next arrival comes after the latest register
time is done, so most end after one or two.  Registers of two texts agree with their probability Jaccard similarity.

Links.  Texts with the same words are one node.  Nodes that agree in all registers of a band share a bucket.  In each
bucket nodes are compared with a leader, by the exact similarity, and classes are formed; buckets that hold several
classes go on with another leader, which is compared with nodes of other classes.  Small buckets are finished in full.

Large buckets that still hold several classes are finished by what their nodes have more or less than a hub, the text of the
bucket that is in most large buckets.  A node's difference is the set of shingles that it has beside the hub's, and of
those of the hub that it lacks.  What two differences do not share is a shingle that one of the two texts has and the other lacks.
If u of one text's weight and v of the other's is not shared, the similarity is at most (1 - u)(1 - v) / (1 - uv).  So a join
over the rare parts of the differences, which counts what must be missing before and after the first common part, finds
all pairs that can reach the threshold: texts that are changed in different places drop out, however many copies a hub has.
The likeliest pair of two classes is compared first, and what it joins is not compared again.  No pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from guestlens.llm.common import byte_slices, discard, stored, to_python
from guestlens.llm.shingles import mixed, probability_jaccard, shingle_hashes, weighted, word_hashes, words_of
from guestlens.plans.search import small_enough

THRESHOLD = 0.8
#: 24 bands of 4 registers: a pair at the threshold shares no bucket with probability 0.59 ** 24 = 3e-6.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Leaders of a bucket, and the nodes up to which a bucket is compared in full at last.
ROUNDS = 2
SMALL_BUCKET = 24
#: Candidates of the join of differences that two classes compare in a round; the last round takes all that are left.
CANDIDATES = (1, None)
#: For sums of weights in floating point.
ROUNDING = 1e-9
SLICE_BYTES = 1 << 20
SHINGLE_ROWS = 1 << 16
#: Parts of a difference: a shingle beside the hub's, one of the hub's that is lacking, and the end.
MORE, LESS, END = 0, 1, 2
#: Hubs whose shingles a task remembers, and the bytes up to which their texts are broadcast.
HUBS_HELD = 256
BROADCAST_BYTES = 8 << 20


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of weighted sets: texts x registers of the winning shingles; 0 for a text without shingles."""
    earliest = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    latest = np.full(texts, np.inf)
    clock = np.zeros(owner.size)
    active, turn = np.arange(owner.size), 0
    while active.size:
        turn = (turn + 0xD1B54A32D192ED03) % 2**64
        draw = mixed(shingle[active] + np.uint64(turn))
        clock[active] -= np.log1p(-(draw >> np.uint64(11)).astype(float) * 2.0**-53) / weight[active]
        inside = clock[active] < latest[owner[active]]
        active, draw = active[inside], draw[inside]
        place = owner[active] * registers + (mixed(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, place, clock[active])
        won = earliest[place] == clock[active]
        winner[place[won]] = shingle[active][won]
        seen = np.unique(owner[active])
        latest[seen] = earliest.reshape(texts, registers)[seen].max(1)
    return winner.reshape(texts, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(signature), 1), np.uint64)
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def node_of(text: str, words: list[str]) -> bytes:
    """16 bytes that texts with the same words share; texts without words share them if they are equal."""
    return blake2b((" ".join(words) if words else "\0" + text).encode("utf-8", "replace"), digest_size=16).digest()


def node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, mark) to (key, node, bands, mark); the bands of a node come once in a slice, for later copies they are null."""
    for piece in byte_slices(batches, "text", SLICE_BYTES):
        nodes: list[bytes | None] = []
        hashes, seen = {}, set()
        for i, text in enumerate(piece.column(1).to_pylist()):
            words = words_of(text)
            nodes.append(None if text is None else node_of(text, words))
            if words and nodes[i] not in seen:
                seen.add(nodes[i])
                hashes[i] = word_hashes(words)
        sets = [weighted(h) for h in hashes.values()]
        bands: list = [None] * piece.num_rows
        if sets:
            owner = np.repeat(np.arange(len(sets)), [s[0].size for s in sets])
            found = signatures(owner, np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]).astype(float), len(sets))
            for i, keys in zip(hashes, band_keys(found).view(np.int64)):
                bands[i] = keys
        columns = [piece.column(0), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), piece.column(2)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "node", "bands", "mark"])


def compared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to (a, b, similarity), exact."""
    last, held = None, None
    for piece in byte_slices(batches, "text_b", SLICE_BYTES):
        out = []
        for a, text_a, text_b in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), piece.column(3).to_pylist()):
            if a != last:
                last, held = a, weighted(word_hashes(words_of(text_a)))
            out.append(probability_jaccard(held, weighted(word_hashes(words_of(text_b)))))
        yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])


def difference_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, node, hub_text, text) to a row for each part of the difference: (hub, node, total, kind, shingle, share).

    ``total`` is the node's number of shingles, ``share`` the part of it that a shingle beside the hub's has.  Kinds are
    ``MORE``, ``LESS`` and ``END``: each node has one row at last that all have.
    """
    hubs: dict[bytes, np.ndarray] = {}
    for piece in byte_slices(batches, "text", SLICE_BYTES):
        for hub, node, hub_text, text in zip(*(piece.column(i).to_pylist() for i in range(4))):
            if hub not in hubs:
                if len(hubs) == HUBS_HELD:
                    hubs.clear()
                hubs[hub] = weighted(word_hashes(words_of(hub_text)))[0]
            held = hubs[hub]
            shingle, count = weighted(word_hashes(words_of(text)))
            more = ~np.isin(shingle, held, assume_unique=True)
            less = held[~np.isin(held, shingle, assume_unique=True)]
            parts = np.concatenate([shingle[more], less, np.zeros(1, np.uint64)]).view(np.int64)
            share = np.concatenate([count[more] / count.sum(), np.zeros(less.size + 1)])
            kind = np.repeat(np.array([MORE, LESS, END], np.int32), [int(more.sum()), less.size, 1])
            for start in range(0, parts.size, SHINGLE_ROWS):
                some = slice(start, start + SHINGLE_ROWS)
                rows = parts[some].size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hub] * rows, pa.binary()), pa.array([node] * rows, pa.binary()), pa.array([int(count.sum())] * rows, pa.int64()),
                     pa.array(kind[some]), pa.array(parts[some]), pa.array(share[some])],
                    ["hub", "node", "total", "kind", "shingle", "share"],
                )


def same_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, text) whose text has that node: keys need not be unique."""
    for batch in batches:
        right = [node_of(t, words_of(t)) == n for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield batch.filter(pa.array(right, pa.bool_()))


def similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact similarity of pairs (a, b) of nodes."""
    second = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return to_python(both.select("a", "b", "text_a", "text_b"), compared_rows, "a binary, b binary, similarity double")


def are_stars(edges: DataFrame) -> bool:
    """Whether each node of the distinct edges (u, v) is either the end u of one edge or the end v of any."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"))))
    roles = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
    return roles.where("up > 1 OR up = 1 AND n > 1").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, class): the least node that links (a, b) connect each node with; no row for that node itself.

    Large-star and small-star steps by turns: each node's neighbours are joined to the least one it knows, until the edges
    are stars.  All steps are aggregations and joins, and every turn is written to the shared folder.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not are_stars(edges):
        around = edges.union(edges.select("v", "u"))
        least = around.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        finished_turn, edges = edges, stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        discard(finished_turn)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class"))


def with_class(df: DataFrame, classes: DataFrame | None, node: str, name: str) -> DataFrame:
    """Column ``name``: the class of ``node``, itself where it has no links."""
    if classes is None:
        return df.withColumn(name, F.col(node))
    found = df.join(classes.select(F.col("node").alias(node), F.col("class").alias("found")), node, "left")
    return found.withColumn(name, F.coalesce("found", node)).drop("found")


def extended(classes: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``classes`` (None: no links yet) after further links (a, b): components of the classes that these connect."""
    if links.isEmpty():
        return classes
    if classes is None:
        return components(links)
    between = with_class(with_class(links, classes, "a", "class_a"), classes, "b", "class_b")
    merged = components(between.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    moved = with_class(classes.select("node", F.col("class").alias("before")), merged, "before", "class")
    return stored(moved.select("node", "class").union(merged), "classes")


def difference_pairs(groups: DataFrame, texts: DataFrame, classes: DataFrame | None, threshold: float) -> DataFrame:
    """(a, b, bound): pairs of different classes under one hub whose similarity can reach the threshold, with an upper bound of it."""
    hub_texts = texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")).join(groups.select("hub").distinct(), "hub", "left_semi")
    told = hub_texts.agg(F.coalesce(F.sum(F.octet_length("hub_text") + 64), F.lit(0))).first()[0]
    hub_texts = F.broadcast(hub_texts) if told <= BROADCAST_BYTES else hub_texts
    both = groups.join(texts, "node").join(hub_texts, "hub").select("hub", "node", "hub_text", "text")
    parts = stored(to_python(both, difference_rows, "hub binary, node binary, total long, kind int, shingle long, share double"), "differences")
    part = ["hub", "kind", "shingle"]
    end = F.col("kind") == END
    largest_text = parts.where(end).groupBy("hub").agg(F.max("total").alias("most"))
    # From rare to frequent parts; the end is the last one, which all nodes of a hub share.
    whole = W.partitionBy("hub", "node")
    order = whole.orderBy(F.asc_nulls_last("n"), "kind", "shingle")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    known = parts.withColumn("n", F.when(~end, F.count("*").over(W.partitionBy(*part))))
    placed = known.withColumns({
        "more": F.coalesce(F.sum("share").over(earlier), F.lit(0.0)),
        "less": F.coalesce(F.sum((F.col("kind") == LESS).cast("int")).over(earlier), F.lit(0)),
        "left": F.count("*").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })
    most_missing = 2 * (1 - threshold) / (1 + threshold) + ROUNDING
    early = placed.join(small_enough(largest_text, 64), "hub")
    early = early.where((F.col("more") + F.col("less") / F.col("most") <= most_missing) & (end | (F.col("n") > 1)))
    rows = stored(with_class(early.select(*part, "node", "total", "more", "less", "left"), classes, "node", "class"), "difference-parts")
    largest = (
        rows.groupBy(*part, "class").agg(F.count("*").alias("n"))
        .groupBy(*part).agg(F.max(F.struct("n", "class")).alias("top"), F.count("*").alias("classes"))
        .where("classes > 1").select(*part, F.col("top.class").alias("largest"))
    )
    # Of two nodes of different classes, one at least is outside the largest class of the part.
    shared = rows.join(largest, part)
    one = shared.where(F.col("class") != F.col("largest")).drop("largest")
    other = shared.select(*part, *(F.col(c).alias(f"{c}_b") for c in ("node", "total", "more", "less", "left", "class")))
    u = F.col("more") + F.col("less_b") / F.col("total")
    v = F.col("more_b") + F.col("less") / F.col("total_b")
    after = F.abs(F.col("left") - F.col("left_b")) / F.greatest("total", "total_b")
    bound = (1 - u) * (1 - v) / (1 - u * v)
    possible = (F.col("class") != F.col("class_b")) & (u + v + after <= most_missing) & ((1 - u) * (1 - v) >= (threshold - ROUNDING) * (1 - u * v))
    met = one.join(other, part).where(possible)
    found = met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"), bound.alias("bound"))
    found = stored(found.groupBy("a", "b").agg(F.max("bound").alias("bound")), "candidates")
    discard(parts, rows)
    return found


def merged_hubs(groups: DataFrame) -> DataFrame:
    """(hub, weight, node) with fewer hubs: a hub that is a node under better hubs hands its nodes to the best of them, twice.

    Any text can be the hub of any others, so two nodes under one hub stay under one hub.
    """
    for _ in range(2):
        hubs = groups.select(F.col("hub").alias("node")).distinct()
        best = F.min_by(F.struct("hub", "weight"), F.struct("weight", "hub")).alias("best")
        better = groups.join(hubs, "node", "left_semi").groupBy("node").agg(best).withColumnRenamed("node", "hub")
        moved = groups.join(better, "hub", "left")
        hub, weight = F.coalesce("best.hub", "hub").alias("hub"), F.coalesce("best.weight", "weight").alias("weight")
        groups = stored(moved.select(hub, weight, "node").distinct(), "hubs")
    return groups


def finished(members: DataFrame, texts: DataFrame, known: DataFrame, classes: DataFrame | None, threshold: float) -> DataFrame | None:
    """``classes`` after what is similar in large buckets of several classes is connected, too; ``known`` is not compared again."""
    placed = with_class(members, classes, "node", "class")
    hub = F.min(F.struct("weight", "node")).alias("hub")
    several = placed.groupBy("bucket").agg(F.min("class").alias("one"), F.max("class").alias("other"), F.count("*").alias("n"), hub)
    several = several.where((F.col("one") != F.col("other")) & (F.col("n") > SMALL_BUCKET))
    several = several.select("bucket", F.col("hub.node").alias("hub"), F.col("hub.weight").alias("weight"))
    groups = stored(members.select("bucket", "node").join(several, "bucket").select("hub", "weight", "node").distinct(), "hubs")
    if groups.isEmpty():
        return classes
    pairs = difference_pairs(merged_hubs(groups).select("hub", "node"), texts, classes, threshold)
    for most in CANDIDATES:
        rest = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        rest = with_class(with_class(rest, classes, "a", "class_a"), classes, "b", "class_b").where("class_a <> class_b")
        if most is not None:
            two = W.partitionBy(F.least("class_a", "class_b"), F.greatest("class_a", "class_b")).orderBy(F.desc("bound"), "a", "b")
            rest = rest.withColumn("place", F.row_number().over(two)).where(F.col("place") <= most)
        found = stored(similarities(rest.select("a", "b"), texts), "similarities")
        if found.isEmpty():
            break
        known = known.union(found)
        classes = extended(classes, found.where(F.col("similarity") >= threshold).select("a", "b"))
    return classes


def node_classes(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame | None:
    """(node, class) of the nodes of buckets (bucket, node) that similarity connects with a lesser one; None: there are none.

    In each of ``ROUNDS`` rounds every bucket of several classes has one leader, which is compared with the nodes of other
    classes: the two nodes whose buckets are largest, as the text that all copies of a group were made from is in
    most of the group's largest buckets.  What is left in buckets
    of at most ``SMALL_BUCKET`` nodes is then compared in full, and in larger ones by ``finished``.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    weights = members.join(sizes, "bucket").groupBy("node").agg((-F.sum("size")).alias("weight"))
    members = stored(members.join(weights, "node"), "weighed-members")
    known = classes = None
    for turn in range(ROUNDS + 1):
        placed = with_class(members, classes, "node", "class")
        several = placed.groupBy("bucket").agg(F.min("class").alias("one"), F.max("class").alias("other"), F.count("*").alias("n")).where("one <> other")
        if turn == ROUNDS:
            several = several.where(F.col("n") <= SMALL_BUCKET)
        open_rows = stored(placed.join(several.select("bucket"), "bucket", "left_semi"), "open-members")
        first = F.row_number().over(W.partitionBy("bucket").orderBy("weight", "node"))
        last = SMALL_BUCKET if turn == ROUNDS else 1 + turn
        leaders = open_rows.withColumn("place", first).where(F.col("place") <= last)
        leaders = leaders if turn == ROUNDS else leaders.where(F.col("place") == last)
        leaders = leaders.select("bucket", F.col("node").alias("leader"), F.col("class").alias("theirs"))
        pairs = open_rows.join(leaders, "bucket").where(F.col("class") != F.col("theirs"))
        pairs = pairs.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
        if known is not None:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        found = stored(similarities(pairs, texts), "similarities")
        known = found if known is None else known.union(found)
        discard(open_rows)
        classes = extended(classes, found.where(F.col("similarity") >= threshold).select("a", "b"))
    return finished(members, texts, known, classes, threshold)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, mark: str | None = None,
) -> DataFrame:
    """Every row's key, ``class_id`` and ``kept``: whether it is the row of its class that stays.

    Texts are compared by their lower-case words, in shingles of five (one of all words in a shorter text), weighted by
    occurrences; similar means a probability Jaccard similarity of ``threshold`` or more, and classes are what similar
    texts connect.  ``class_id`` is the least key of the class, and the row that has it stays.  Equal texts always share
    a class, even without words.  Rows with a null text are alone in their class; rows with a null key take no part, get
    a null class and stay.  Rows that repeat a key are rows of that key: they get the same class if their texts do, and
    each row with the least key of its class stays.  ``mark`` names a further column, of the MD5 of the text, which tells rows of
    one key with different texts apart (null: no text).  An empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    marked = F.md5(text) if mark else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), marked.alias("mark"))
    nodes = stored(to_python(rows.where("key IS NOT NULL"), node_rows, f"key {kind}, node binary, bands array<long>, mark string"), "nodes")
    members = nodes.select(F.explode("bands").alias("bucket"), "node").distinct()
    full = stored(members, "members")
    shared = full.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    busy = stored(full.join(shared, "bucket", "left_semi"), "busy-members")
    first = nodes.join(busy.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
    texts = stored(to_python(first.join(rows, "key").select("node", "text"), same_node, "node binary, text string").dropDuplicates(["node"]), "texts")
    classes = node_classes(busy, texts, threshold)
    placed = with_class(nodes.select("key", "node", "mark"), classes, "node", "class")
    least = placed.where("node IS NOT NULL").groupBy("class").agg(F.min("key").alias("class_id"))
    alone = placed.where("node IS NULL").select("key", F.col("key").alias("class_id"), "mark")
    found = placed.where("node IS NOT NULL").join(least, "class").select("key", "class_id", "mark").union(alone)
    null_keys = rows.where("key IS NULL").select("key", F.lit(None).cast(kind).alias("class_id"), "mark")
    kept = F.coalesce(F.col("key") == F.col("class_id"), F.lit(True)).alias("kept")
    return found.union(null_keys).select(F.col("key").alias(key), "class_id", kept, *([F.col("mark").alias(mark)] if mark else []))
