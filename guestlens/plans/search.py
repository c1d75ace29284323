"""Vector search over all items that a query's filters leave, and the store of embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from guestlens.functions.models import CALL_SIZE, Embed, embed_text, word_hash_embedder
from guestlens.functions.vectors import NO_NORM, cosine_of_normed, with_norm
from guestlens.operators.joins import last_per_key, not_yet_done
from guestlens.operators.matching import BROADCAST_BYTES, Field, SpecMatcher
from guestlens.operators.ranking import first_k_per_group
from guestlens.session import use_checkpoints
from guestlens.sources.files import append, read_if_present

TOP_K = 5
CANDIDATE_POOL = 150
# Bytes of vectors in double precision that a block of queries, or of rows, has, and scores that a task works out at a time.
QUERY_BYTES = 16 << 20
SCORES = 1 << 21
# Rows that a task holds to tell copies from.
HELD = 1 << 16


def with_embeddings(
    rows: DataFrame, text: str, factory: Callable[[], Embed] = word_hash_embedder, name: str = "vector",
    partitions: int | None = None, call_size: int = CALL_SIZE,
) -> DataFrame:
    """Vectors of the texts as ``name`` and the failures as ``<name>_error``.  ``partitions`` as in annotate()."""
    spread = rows.repartition(partitions) if partitions else rows
    called = spread.withColumn("_embedded", embed_text(F.col(text), factory, call_size))
    return called.withColumns({name: F.col("_embedded.vector"), f"{name}_error": F.col("_embedded.error")}).drop("_embedded")


# --- stored embeddings ----------------------------------------------------------------------

def vector_schema(key_type: T.DataType, key: str = "review_uid") -> T.StructType:
    return T.StructType([
        T.StructField(key, key_type), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("vector_norm", T.DoubleType()),
        T.StructField("vector_error", T.StringType()), T.StructField("run_id", T.LongType()),
    ])


def read_vectors(rows: DataFrame, path: str, key: str = "review_uid") -> DataFrame:
    """All stored results; an empty frame before the first run."""
    schema = vector_schema(rows.schema[key].dataType, key)
    stored = read_if_present(rows.sparkSession, path, schema)
    return rows.sparkSession.createDataFrame([], schema) if stored is None else stored


def embed_new(
    rows: DataFrame, path: str, run_id: int, factory: Callable[[], Embed] = word_hash_embedder, key: str = "review_uid",
    text: str = "Review_Text", partitions: int | None = None,
) -> None:
    """Embed the rows that the store has no vector of and append them.  Failures are stored and tried again."""
    done = read_vectors(rows, path, key).filter(F.col("vector").isNotNull())
    todo = not_yet_done(rows.select(key, text), done, key)
    made = with_norm(with_embeddings(todo, text, factory, partitions=partitions), "vector")
    append(made.withColumn("run_id", F.lit(run_id).cast("bigint")).select(*vector_schema(T.NullType(), key).fieldNames()), path)


def latest_vectors(stored: DataFrame, key: str = "review_uid") -> DataFrame:
    """Key, vector and length of the last run that gave a vector."""
    return last_per_key(stored.filter(F.col("vector").isNotNull()), key, F.col("run_id"), ["vector", "vector_norm"])


# --- search ---------------------------------------------------------------------------------

def small_enough(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """``df`` with a broadcast hint if its rows are few enough; else Spark decides."""
    return F.broadcast(df) if df.count() * bytes_per_row <= BROADCAST_BYTES else df


def top_by_similarity(
    pairs: DataFrame, query: str, vector: str, query_vector: str, key: str, k: int = TOP_K,
) -> DataFrame:
    """The ``k`` most similar rows per query, with ``similarity`` and ``rank``.

    ``pairs`` holds both vectors and their lengths, see :func:`with_norm`.  A missing vector sorts last, ties go by
    key; so if no vector is there the first ``k`` keys remain.  Only keys and similarities are ranked and shuffled,
    and each task cuts its rows to ``k`` per query before.
    """
    scored = pairs.select(query, key, cosine_of_normed(vector, query_vector).alias("similarity"))
    return first_k_per_group(
        scored, [query], [F.desc_nulls_last("similarity"), F.col(key)], k, F.col(key), salts=8
    )


def flat_vectors(vector: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers in a row, where each vector starts, and its size; size -1 if it or one of its numbers is missing."""
    starts = vector.offsets.to_numpy(zero_copy_only=False)
    sizes = np.diff(starts)
    missing = pc.is_null(vector).to_numpy(zero_copy_only=False)
    numbers = vector.values
    if numbers.null_count:
        holes = np.concatenate([[0], np.cumsum(pc.is_null(numbers).to_numpy(zero_copy_only=False))])
        missing = missing | (holes[starts[1:]] > holes[starts[:-1]])
        numbers = pc.fill_null(numbers, 0.0)
    return numbers.to_numpy(zero_copy_only=False), starts[:-1], np.where(missing, -1, sizes)


def copy_codes(vector: pa.ListArray, group: pa.Array | None = None) -> np.ndarray:
    """One number for each different vector (of each group), bit by bit; all missing ones count as equal."""
    numbers, starts, sizes = flat_vectors(vector)
    raw, width = memoryview(np.ascontiguousarray(numbers)).cast("B"), numbers.itemsize
    told = [None if n < 0 else bytes(raw[s * width : (s + n) * width]) for s, n in zip(starts.tolist(), sizes.tolist())]
    codes = pd.factorize(np.array([*told, None], object)[:-1], use_na_sentinel=False)[0]
    if group is None:
        return codes
    groups = group.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return pd.factorize(groups * (len(codes) + 1) + codes)[0]


def key_ranks(keys: pa.Array) -> np.ndarray:
    ranks = np.empty(len(keys), np.int64)
    ranks[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
    return ranks


def first_of_each(codes: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each run of equal codes."""
    new = np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]
    return np.flatnonzero(np.arange(len(codes)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k)


def cut_copies(k: int) -> Callable:
    """Rows (group, key, vector) to those with the least ``k`` keys of each group and vector that the task holds."""

    def cut(rows: pa.Table) -> pa.Table:
        group, key, vector = (rows.column(i).combine_chunks() for i in range(3))
        codes = copy_codes(vector, group)
        order = np.lexsort((key_ranks(key), codes))
        return rows.take(pa.array(order[first_of_each(codes[order], k)]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows:
                held.append(cut(pa.Table.from_batches([batch])))
            if sum(t.num_rows for t in held) > HELD:
                held = [cut(pa.concat_tables(held))]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from cut(pa.concat_tables(held)).to_batches()

    return work


def guarded_lengths(vectors: np.ndarray) -> np.ndarray:
    total = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        total += vectors[:, d] * vectors[:, d]
    lengths = np.sqrt(total)
    return np.where(lengths == 0, NO_NORM, lengths)


def directions(vectors: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in single precision, and which cannot be told so: numbers that are not finite, very large or small."""
    odd = ~((lengths == NO_NORM) | ((lengths > 1e-100) & (lengths < 1e100)))
    return np.where(odd[:, None], 0.0, vectors / lengths[:, None]).astype(np.float32), odd


class Block:
    """Different items and different queries with vectors of one size, and the best ``k`` keys of each query.

    A product in single precision leaves out what cannot be among the best, by its largest possible error; the rest is
    summed in double, in order, as a column would.
    """

    def __init__(self, items: np.ndarray, item_of_key: np.ndarray, ranks: np.ndarray, asks: np.ndarray, k: int) -> None:
        self.items, self.asks, self.k = items, asks, k
        order = np.lexsort((ranks, item_of_key))
        kept = order[first_of_each(item_of_key[order], k)]
        self.keys, self.ranks = kept, ranks
        self.start = np.searchsorted(item_of_key[kept], np.arange(len(items) + 1))
        self.item_lengths, self.ask_lengths = guarded_lengths(items), guarded_lengths(asks)
        self.margin = np.float32((items.shape[1] + 8) * 2.0**-22)
        self.best = (np.array([], int), np.array([], int), np.array([], float))

    def scores(self, ask: np.ndarray, item: np.ndarray) -> np.ndarray:
        total = np.zeros(len(ask))
        for d in range(self.items.shape[1]):
            total += self.items[item, d] * self.asks[ask, d]
        return total / (self.item_lengths[item] * self.ask_lengths[ask])

    def settle(self, ask: np.ndarray, item: np.ndarray) -> None:
        """Take these pairs into the best: (query, place of the key, similarity)."""
        score, copies = self.scores(ask, item), self.start[item + 1] - self.start[item]
        within = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        found = (np.repeat(ask, copies), self.keys[np.repeat(self.start[item], copies) + within], np.repeat(score, copies))
        ask, key, score = (np.concatenate(both) for both in zip(self.best, found))
        order = np.lexsort((self.ranks[key], -np.where(np.isnan(score), np.inf, score), ask))
        order = order[first_of_each(ask[order], self.k)]
        self.best = (ask[order], key[order], score[order])

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, places of keys and similarities: at most ``k`` for each query."""
        with np.errstate(all="ignore"):
            turned, odd_items = directions(self.items, self.item_lengths)
            asked, odd_asks = directions(self.asks, self.ask_lengths)
            step = max(self.k, SCORES // max(len(asked), 1))
            top = np.full((len(asked), self.k), -np.inf, np.float32)
            waiting: list[tuple] = []
            bound = np.full(len(asked), -np.inf, np.float32)
            for start in range(0, len(turned), step):
                odd = odd_items[start : start + step]
                rough = asked @ turned[start : start + step].T
                rough[:, odd] = np.inf
                rough[odd_asks, :] = np.inf
                hit = np.flatnonzero(rough.max(axis=1) >= bound)
                rough = rough[hit]
                both = np.concatenate([top[hit], np.where(odd, np.float32(-np.inf), rough)], axis=1)  # odd ones raise no bound
                top[hit] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
                top[odd_asks] = -np.inf
                bound[hit] = top[hit].min(axis=1) - self.margin
                ask, item = np.nonzero(rough >= bound[hit][:, None])
                waiting.append((hit[ask], item + start, rough[ask, item]))
                if sum(len(w[0]) for w in waiting) > SCORES or start + step >= len(turned):
                    ask, item, about = (np.concatenate(c) for c in zip(*waiting))
                    near, waiting = about >= bound[ask], []
                    self.settle(ask[near], item[near])
            return self.best


def best_of_block(k: int, ask_type: pa.DataType, key_type: pa.DataType) -> Callable:
    """Rows (group, key, vector) and (group, ask, query_vector) of one block to each ask's best ``k``: (ask, key, similarity)."""

    def matrix(numbers: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        return numbers[starts[:, None] + np.arange(size)].astype(float)

    def work(items: pa.Table, asks: pa.Table) -> pa.Table:
        if not (items.num_rows and asks.num_rows):
            return pa.table({"ask": pa.array([], ask_type), "key": pa.array([], key_type), "similarity": pa.array([], pa.float64())})
        key, vector = (items.column(n).combine_chunks() for n in ("key", "vector"))
        ask, asked = (asks.column(n).combine_chunks() for n in ("ask", "query_vector"))
        ranks, codes = key_ranks(key), copy_codes(vector)
        numbers, starts, sizes = flat_vectors(vector)
        ask_numbers, ask_starts, ask_sizes = flat_vectors(asked)
        found: list[tuple] = []
        for size in np.unique(ask_sizes):
            mine = np.flatnonzero(ask_sizes == size)
            known = np.flatnonzero(sizes == size) if size >= 0 else np.array([], int)
            if len(known):
                _, one, item = np.unique(codes[known], return_index=True, return_inverse=True)
                block = Block(matrix(numbers, starts[known[one]], size), item, ranks[known], matrix(ask_numbers, ask_starts[mine], size), k)
                a, place, score = block.search()
                found.append((mine[a], known[place], score, np.zeros(len(a), bool)))
            if len(known) < k:
                rest = np.flatnonzero(sizes != size) if size >= 0 else np.arange(len(sizes))
                rest = rest[np.argsort(ranks[rest])][:k]
                n = len(mine) * len(rest)
                found.append((np.repeat(mine, len(rest)), np.tile(rest, len(mine)), np.zeros(n), np.ones(n, bool)))
        a, place, score, missing = (np.concatenate(c) for c in zip(*found))
        return pa.table({
            "ask": ask.take(pa.array(a)).cast(ask_type), "key": key.take(pa.array(place)).cast(key_type),
            "similarity": pa.array(score, pa.float64(), mask=missing, from_pandas=False),
        })

    return work


def blocks_of(rows: DataFrame, vector: str, name: str) -> DataFrame:
    """For each group, into how many blocks of ``QUERY_BYTES`` its rows go."""
    told = F.sum(F.coalesce(F.size(vector), F.lit(0)) * 8 + 64)
    return rows.groupBy("group").agg(F.ceil(told / QUERY_BYTES).cast("int").alias(name))


def search_matches(
    matcher: SpecMatcher, asking: DataFrame, query: str, key: str, vector: str = "vector", query_vector: str = "query_vector", k: int = TOP_K,
) -> DataFrame:
    """The most similar of all matching rows, exactly.  ``asking`` has ``query``, the matcher's key and the query's vector.

    Queries of one specification with one vector are asked once.  A row is listed once for each specification that it
    matches; of rows with one vector a task leaves the first ``k``, as no more can be found.  What is left is written to the
    checkpoint folder, so rows are read and matched once, however many queries there are.  Then each specification's rows
    and queries are dealt into blocks of ``QUERY_BYTES``, and each block of rows meets each block of queries in a task,
    as a matrix product that keeps ``k`` rows of each query.  A missing vector, or one of another size than the query's,
    sorts last, ties go by key.  The products grow with different vectors times different queries; nothing else does.
    """
    group, spark = matcher.spec_key, asking.sparkSession
    told = asking.select(F.col(query).alias("query"), F.col(group).alias("group"), F.col(query_vector).alias("query_vector"))
    asks = told.groupBy("group", "query_vector").agg(F.min("query").alias("ask"))
    pairs = matcher.matches(key, vector).select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(vector).alias("vector"))
    use_checkpoints(spark)
    items = pairs.mapInArrow(cut_copies(k), pairs.schema).checkpoint()

    many, few = blocks_of(items, "vector", "item_blocks"), blocks_of(asks, "query_vector", "ask_blocks")
    dealt = many.join(few, many["group"].eqNullSafe(few["group"])).select(many["group"].alias("of"), "item_blocks", "ask_blocks").checkpoint()
    dealt = small_enough(dealt, 64)
    tasks = dealt.agg(F.coalesce(F.sum(F.col("item_blocks").cast("bigint") * F.col("ask_blocks")), F.lit(0))).first()[0]
    parts = max(1, min(4 * tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    block = ["group", "item_block", "ask_block"]

    def placed(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        met = rows.join(dealt, rows["group"].eqNullSafe(dealt["of"])).drop("of")
        met = met.withColumn(f"{own}_block", F.pmod(F.xxhash64(by), F.col(f"{own}_blocks")).cast("int"))
        met = met.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
        return met.drop("item_blocks", "ask_blocks").repartition(parts, *block)

    ask_type, key_type = told.schema["query"].dataType, pairs.schema["key"].dataType
    schema = T.StructType([T.StructField("ask", ask_type), T.StructField("key", key_type), T.StructField("similarity", T.DoubleType())])
    left, right = placed(items, "vector", "item", "ask"), placed(asks, "ask", "ask", "item")
    work = best_of_block(k, to_arrow_type(ask_type), to_arrow_type(key_type))
    found = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(work, schema)
    top = first_k_per_group(found, ["ask"], [F.desc_nulls_last("similarity"), F.col("key")], k, F.col("key"), salts=8)
    same = told["group"].eqNullSafe(asks["group"]) & told["query_vector"].eqNullSafe(asks["query_vector"])
    fanned = told.join(asks, same).select("query", "ask").join(top, "ask")
    return fanned.select(F.col("query").alias(query), F.col("key").alias(key), "similarity", "rank")


def filtered_search(
    queries: DataFrame, items: DataFrame, on: Sequence[str], query: str, key: str, vector: str = "vector",
    query_vector: str = "query_vector", k: int = TOP_K, shown: Sequence[str] = (),
) -> DataFrame:
    """Exact search among the items that agree with the query in the metadata columns ``on``.

    A null leaves a column open, so a query may set all, some or none of them; ``on`` may be empty.  Of an array
    column one common value is enough.  ``shown`` columns are fetched for the rows found only.
    """
    def field(name: str) -> Field:
        many = isinstance(items.schema[name].dataType, T.ArrayType)
        wanted = F.when(F.size(f"_on_{name}") > 0, F.col(f"_on_{name}")) if many else F.col(f"_on_{name}")
        return Field(name, F.col(name), wanted, many=many, several=many)

    names = [f"_on_{c}" for c in on]
    asked = queries.select(query, query_vector, *[F.col(c).alias(n) for c, n in zip(on, names)])
    specs = asked.groupBy(*names).agg(F.min(query).alias("_spec"))  # equal filters are matched once
    same = F.lit(True)
    for n in names:
        same = same & asked[n].eqNullSafe(specs[n])
    matcher = SpecMatcher(items.select(key, vector, *on), specs, [field(c) for c in on], "_spec")
    asking = asked.join(specs, same).select(F.col(query).alias("_query"), query_vector, "_spec")
    found = search_matches(matcher, asking, "_query", key, vector, query_vector, k).withColumnRenamed("_query", query)
    if not shown:
        return found
    return items.select(key, *shown).join(small_enough(found, 100), key).select(*found.columns, *shown)


def mean_vectors(items: DataFrame, group: str, vector: str = "vector", name: str = "query_vector") -> DataFrame:
    """Mean vector per group, place by place.

    Places are averaged as rows of (group, place), with partial sums before the shuffle.
    """
    places = items.select(group, F.posexplode(vector).alias("place", "value"))
    means = places.groupBy(group, "place").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "mean")))
    return means.groupBy(group).agg(F.transform(ordered, lambda p: p["mean"]).alias(name))
