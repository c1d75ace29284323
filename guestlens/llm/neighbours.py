"""Approximate nearest neighbours by an inverted multi-index.

Vectors are normalised and cut in two halves, each quantised by a codebook of its own; a pair of centroids is a cell.  A
query walks through the cells in the order of its summed distance to both centroids, with a heap, until it has met enough
vectors, and those cells' entries are ranked exactly.  How many are enough is measured: for a bounded sample of queries the
exact neighbours are looked up in the walk, and the walk goes on as far as ``RECALL`` of them need.

Equal vectors are one entry with its smallest ids, so a vector that a third of all rows share costs no more than another.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from guestlens.llm.common import stored

#: Entries that the codebooks are trained on, queries that the length of the walk is measured with, and the aim.
TRAINED_ON = 20_000
MEASURED_ON = 96
RECALL = 0.96
MOST_CENTROIDS = 512
ROUNDS = 12
#: Entries and queries that a task compares at a time.
ENTRIES_PER_BLOCK = 4_096
QUERIES_PER_BLOCK = 2_048
QUERIES_AT_ONCE = 128


def vectors(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two next to their largest component: exact, and their squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def normalised(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)


def codebook(x: np.ndarray, size: int, seed: int = 3) -> np.ndarray:
    """Centroids by k-means; an empty cluster takes the point that is worst off."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(size, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        d = squared_distances(x, c)
        near = d.argmin(1)
        for j in range(len(c)):
            mine = near == j
            c[j] = x[mine].mean(0) if mine.any() else x[d.min(1).argmax()]
    return c


def half_distances(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    cut = books[0].shape[1]
    return [squared_distances(part, book) for part, book in zip((x[:, :cut], x[:, cut:]), books)]


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cells in the order of summed distance: a heap of pairs of ranks, each cell entered from its neighbours before it."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    heap, entered = [(da[0] + db[0], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for k, l in ((i + 1, j), (i, j + 1)):
            if k < len(da) and l < len(db) and (k, l) not in entered:
                entered.add((k, l))
                heapq.heappush(heap, (da[k] + db[l], k, l))


def cells_for(first: np.ndarray, second: np.ndarray, filled: np.ndarray, enough: int) -> dict[int, list[int]]:
    """Non-empty cells on the walk until they hold ``enough`` entries: second centroids by first."""
    out: dict[int, list[int]] = {}
    met = 0
    for i, j in walk(first, second):
        if filled[i, j]:
            out.setdefault(i, []).append(j)
            met += int(filled[i, j])
            if met >= enough:
                break
    return out


def best(scores: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The ``k`` largest scores with their ids, ties by id; each entry stands for several ids."""
    found = np.flatnonzero(scores > -np.inf)
    if found.size > k:
        least = np.partition(scores[found], found.size - k)[found.size - k]
        found = found[scores[found] >= least - 1e-12]
    rows = [(float(scores[i]), n) for i in found.tolist() for n in ids[i]]
    return sorted(rows, key=lambda r: (-r[0], r[1]))[:k]


def cosines(entries: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of one query with each row, each by the same sums whatever rows are beside it."""
    entries, query = scaled(entries), scaled(query)
    return (entries * query).sum(1) / (np.sqrt((entries * entries).sum(1)) * np.sqrt((query * query).sum()))


def top_of_block(entries: np.ndarray, ids: list[list[int]], allowed: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """Of each query the best entries among those allowed (queries x entries); a product of matrices finds the few to rank."""
    out = []
    unit = normalised(entries)
    for start in range(0, len(queries), QUERIES_AT_ONCE):
        part = queries[start : start + QUERIES_AT_ONCE]
        rough = np.where(allowed[start : start + QUERIES_AT_ONCE], normalised(part) @ unit.T, -np.inf)
        if rough.shape[1] > k:
            least = np.partition(rough, rough.shape[1] - k, axis=1)[:, -k] - 1e-9
        else:
            least = np.full(len(part), -2.0)
        for q, line, floor in zip(part, rough, least):
            some = np.flatnonzero((line >= floor) & (line > -np.inf))
            out.append(best(cosines(entries[some], q), [ids[i] for i in some.tolist()], k))
    return out


def entry_rows(table: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(h1, h2, vector, ids): distinct usable vectors with their ``k`` smallest ids."""
    x = F.col("vector")
    usable = F.exists(x, lambda v: v != 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = table.select(F.col(key).alias("id"), F.col(vector).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL").where(usable)
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    rows = rows.where(F.size("vector") == (sizes["size"] if sizes else 0))
    if sizes and sizes["size"] == 1:  # a second component of zero changes no cosine, and gives two halves
        rows = rows.withColumn("vector", F.concat("vector", F.transform("vector", lambda v: v * 0)))
    return rows.select("id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2"))


def by_batch(batch: pa.RecordBatch, work: Callable[[np.ndarray], list[pa.Array]], names: list[str], vector: int) -> pa.RecordBatch:
    added = work(vectors(batch.column(vector)))
    return pa.RecordBatch.from_arrays([*batch.columns, *added], names)


def nearest(table: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, <key>, score): the ``k`` nearest rows found for each row whose key is divisible by ``every``.

    Nearness is the cosine of the original vectors in double precision; ties go to the smaller key.  Every row but the
    query's own is a candidate.  Vectors that are null or zero, hold null, NaN or infinity, overflow when squared, have
    fewer than two components or another length than most take no part, nor do rows with a null key.  Rows that repeat a
    key count once for each different vector, and none of them is a result of a query with that key.  Other columns are
    not read.  An empty table gives an empty result.
    """
    spark = table.sparkSession
    rows = entry_rows(table, key, vector, k)
    kind = table.schema[vector].dataType.simpleString()
    rank = F.dense_rank().over(W.partitionBy("h1", "h2").orderBy("id"))
    smallest = rows.withColumn("place", rank).where(F.col("place") <= k + 1)
    entries = stored(smallest.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_set("id")).alias("ids")), "entries")
    asked = rows.where(F.col("id") % every == 0).select("id", "h1", "h2")
    count = entries.count()
    result = f"query_id long, rank int, `{key}` long, score double"
    if count < 1:
        return spark.createDataFrame([], result)

    # codebooks from a bounded sample, cells for every entry
    sample = normalised(vectors(entries.orderBy("h1", "h2").limit(TRAINED_ON).select("vector").toArrow().column(0).combine_chunks()))
    size = int(min(MOST_CENTROIDS, max(4, 2 ** round(np.log2(np.sqrt(count) / 6 + 1)))))
    half = sample.shape[1] // 2
    books = codebook(sample[:, :half], size), codebook(sample[:, half:], size)

    def place(x: np.ndarray) -> list[pa.Array]:
        return [pa.array(d.argmin(1).astype(np.int32)) for d in half_distances(normalised(x), books)]

    names = ["h1", "h2", "vector", "ids", "c1", "c2"]
    schema = f"h1 long, h2 long, vector {kind}, ids array<long>, c1 int, c2 int"
    index = stored(entries.mapInArrow(lambda batches: (by_batch(b, place, names, 2) for b in batches), schema), "index")
    cells = index.groupBy("c1", "c2").agg(F.count("*").alias("n")).toArrow().to_pydict()
    filled = np.zeros((len(books[0]), len(books[1])), np.int64)
    filled[cells["c1"], cells["c2"]] = cells["n"]

    questions = index.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "vector")
    enough = needed_entries(index, questions, books, filled, k, recall)

    # walks, one row for each query and first centroid
    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = half_distances(normalised(vectors(batch.column(2))), books)
            which, c1, c2s = [], [], []
            for i in range(batch.num_rows):
                for a, bs in cells_for(first[i], second[i], filled, enough).items():
                    which.append(i)
                    c1.append(a)
                    c2s.append(bs)
            taken = batch.take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(c1, pa.int32()), pa.array(c2s, pa.list_(pa.int32()))], ["h1", "h2", "vector", "c1", "c2s"])

    walks = stored(questions.mapInArrow(probes, f"h1 long, h2 long, vector {kind}, c1 int, c2s array<int>"), "walks")
    asking = {r["c1"]: r["n"] for r in walks.groupBy("c1").agg(F.count("*").alias("n")).collect()}
    blocks = [(c, -(-int(n) // ENTRIES_PER_BLOCK), -(-asking.get(c, 0) // QUERIES_PER_BLOCK)) for c, n in enumerate(filled.sum(1).tolist()) if asking.get(c)]
    split = F.broadcast(spark.createDataFrame(blocks, "c1 int, eb int, qb int"))
    spread = index.join(split, "c1").select("c1", F.pmod("h2", F.col("eb").cast("long")).alias("e"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb").cast("long") - 1)).alias("q"), "c2", "vector", "ids")
    put = walks.join(split, "c1").select("c1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("eb").cast("long") - 1)).alias("e"), F.pmod("h2", F.col("qb").cast("long")).alias("q"), "h1", "h2", "vector", "c2s")
    width = filled.shape[1]

    def compare(own: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float, int]] = []
        if own.num_rows and theirs.num_rows:
            own, theirs = own.combine_chunks(), theirs.combine_chunks()
            lists = theirs["c2s"].combine_chunks()
            open_cells = np.zeros((theirs.num_rows, width), bool)
            open_cells[np.repeat(np.arange(theirs.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
            x, queries = vectors(own["vector"].combine_chunks()), vectors(theirs["vector"].combine_chunks())
            found = top_of_block(x, own["ids"].to_pylist(), open_cells[:, own["c2"].to_numpy()], queries, k + 1)
            for a, b, rows in zip(theirs["h1"].to_pylist(), theirs["h2"].to_pylist(), found):
                out += [(a, b, score, n) for score, n in rows]
        return pa.table({name: pa.array([r[i] for r in out], t) for i, (name, t) in enumerate([("h1", pa.int64()), ("h2", pa.int64()), ("score", pa.float64()), ("id", pa.int64())])})

    grouped = spread.groupBy("c1", "e", "q").cogroup(put.groupBy("c1", "e", "q"))
    partial = grouped.applyInArrow(compare, "h1 long, h2 long, score double, id long")
    order = F.row_number().over(W.partitionBy("h1", "h2").orderBy(F.desc("score"), "id"))
    top = partial.withColumn("place", order).where(F.col("place") <= k + 1)
    lists = top.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    answers = asked.select(F.col("id").cast("long").alias("query_id"), "h1", "h2").distinct().join(lists, ["h1", "h2"])
    return answers.select("query_id", F.posexplode(others).alias("at", "f")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias(key), F.col("f.score").alias("score")
    )


def needed_entries(index: DataFrame, questions: DataFrame, books: tuple[np.ndarray, np.ndarray], filled: np.ndarray, k: int, recall: float) -> int:
    """Entries that a walk must meet to find ``recall`` of the exact neighbours of a bounded sample of queries."""
    some = questions.orderBy("h1", "h2").limit(MEASURED_ON).toArrow()
    if not some.num_rows:
        return int(filled.sum())
    sample = vectors(some.column("vector").combine_chunks())

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = normalised(vectors(batch.column(2)))
            scores = normalised(sample) @ x.T
            keep = np.argsort(-scores, axis=1)[:, : k + 1]
            query = np.repeat(np.arange(len(sample)), keep.shape[1])
            entry = keep.ravel()
            yield pa.RecordBatch.from_arrays([
                pa.array(query), pa.array(scores[query, entry]), *(batch.column(i).take(pa.array(entry)) for i in (4, 5)),
            ], ["query", "score", "c1", "c2"])

    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "c1", "c2"))
    truth = index.mapInArrow(exact, "query long, score double, c1 int, c2 int").withColumn("place", rank).where(F.col("place").between(2, k + 1))
    wanted: dict[int, list[tuple[int, int]]] = {}
    for r in truth.collect():
        wanted.setdefault(r["query"], []).append((r["c1"], r["c2"]))
    first, second = half_distances(normalised(sample), books)
    depth = []
    for q, cells in wanted.items():
        met, at = 0, {}
        for cell in walk(first[q], second[q]):
            met += int(filled[cell])
            at[cell] = met
        depth += [at[cell] for cell in cells]
    return int(np.quantile(depth, recall, method="higher")) if depth else int(filled.sum())
