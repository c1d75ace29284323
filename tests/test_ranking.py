"""Positions and top-k against brute force, with small ranges and hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from guestlens.operators import dialogue, ranking
from guestlens.sources import paging


@pytest.fixture(scope="module")
def keys():
    rng = random.Random(7)
    # Two thirds of the keys sit in a tenth of the key space.
    return rng.sample(range(1000), 600) + rng.sample(range(1000, 10_000), 300)


@pytest.fixture(scope="module")
def numbered(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "k long").repartition(5).persist()


@pytest.mark.parametrize("rows_per_bucket", [7, 50, 10_000])
def test_positions_are_exact_for_any_ranges(numbered, keys, rows_per_bucket):
    got = {r.k: (r.position, r.total) for r in ranking.positions(numbered, "k", rows_per_bucket).collect()}
    assert got == {k: (i, len(keys)) for i, k in enumerate(sorted(keys))}


def test_positions_of_text_keys(spark):
    texts = [f"review-{i}" for i in range(300)] + ["", "z", "é", "reviewer-with-a-long-name"]
    rows = spark.createDataFrame([(t,) for t in texts], "k string")
    got = {r.k: r.position for r in ranking.positions(rows, "k", 20).collect()}
    assert got == {t: i for i, t in enumerate(sorted(texts, key=lambda t: t.encode()))}


def test_ranges_are_balanced(numbered):
    bounds = ranking.key_bounds(numbered, "k", 90)
    sizes = [r["count"] for r in numbered.groupBy(ranking.bucket_of(numbered, "k", bounds).alias("b")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200


@pytest.mark.parametrize("collected", [1_000, 3])
def test_ranges_of_texts_with_a_common_prefix(spark, monkeypatch, collected):
    monkeypatch.setattr(ranking, "COLLECTED", collected)
    rows = spark.range(50_000).select(F.concat(F.lit("review-"), F.col("id")).alias("k"))
    bounds = ranking.key_bounds(rows, "k", 2_500)
    sizes = [r["count"] for r in rows.groupBy(ranking.bucket_of(rows, "k", bounds).alias("b")).count().collect()]
    assert 19 <= len(sizes) <= 21 and max(sizes) < 5_500


def test_one_path_without_a_single_partition(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    for frame in (ranking.positions(rows, "k"), ranking.even_batches(rows, "k", 50), ranking.chunks(rows, "k", 10), paging.with_pages(rows, "k")):
        assert "SinglePartition" not in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows, size", [(173, 50), (150, 50), (20, 50), (101, 10), (0, 50)])
def test_even_batches_have_the_sizes_of_a_numpy_split(spark, rows, size):
    frame = spark.range(rows).withColumnRenamed("id", "k")
    got = {}
    for r in ranking.even_batches(frame, "k", size).collect():
        got.setdefault(r.batch_id, []).append(r.k)
    expected = np.array_split(np.arange(rows), max(1, rows // size)) if rows else []
    assert [sorted(got[b]) for b in sorted(got)] == [list(c) for c in expected]


def test_chunks_and_hashed_batches(numbered, keys):
    chunked = sorted((r.k, r.chunk_id) for r in ranking.chunks(numbered, "k", 100).collect())
    assert chunked == [(k, i // 100) for i, k in enumerate(sorted(keys))]
    hashed = ranking.hashed_batches(numbered, "k", 6).groupBy("batch_id").count().collect()
    assert len(hashed) == 6 and sum(r["count"] for r in hashed) == len(keys)


def test_first_k_per_group_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 else i % 40, rng.randrange(50), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g int, v int, k int").repartition(6)
    got = sorted((r.g, r["rank"], r.k) for r in ranking.first_k_per_group(
        frame, ["g"], [F.desc("v"), F.col("k")], 4, F.col("k"), salts=8).collect())
    expected = []
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:4]
        expected += [(g, i + 1, r[2]) for i, r in enumerate(best)]
    assert got == sorted(expected)


@pytest.mark.parametrize("span", [3, 10, 1000])
def test_positions_in_groups_with_gaps(spark, span):
    rng = random.Random(5)
    rows = [("hot", t) for t in rng.sample(range(500), 200)] + [(f"g{i}", t) for i in range(20) for t in rng.sample(range(30), 5)]
    frame = spark.createDataFrame(rows, "g string, t long").repartition(4)
    got = sorted((r.g, r.t, r.position) for r in ranking.group_positions(frame, ["g"], "t", span).collect())
    expected = []
    for g in {r[0] for r in rows}:
        expected += [(g, t, i) for i, t in enumerate(sorted(t for h, t in rows if h == g))]
    assert got == sorted(expected)


@pytest.mark.parametrize("span", [10, 12, 1000])
def test_context_of_long_dialogues(spark, span):
    roles = ["user", "assistant", "system"]
    rows = [(c, t * 3 if c else t, roles[(t * 7 + c) % 3], f"{c}-{t}") for c, n in ((0, 60), (1, 4), (2, 25)) for t in range(n)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r.conv_id, r.turn): [t["text"] for t in r.context] for r in dialogue.recent_context(frame, span=span).collect()}
    expected = {}
    for c, turn, _, _ in rows:
        earlier = sorted(r for r in rows if r[0] == c and r[1] < turn)[-10:]
        expected[c, turn] = [r[3] for r in earlier if r[2] != "system"]
    assert got == expected


def test_pages(numbered, keys):
    paged = {r.k: (r.page, r.pages) for r in paging.with_pages(numbered, "k", 100).collect()}
    ordered = sorted(keys)
    assert paged == {k: (i // 100, 9) for i, k in enumerate(ordered)}
    for number in (0, 4, 8, 9):
        for per_bucket in (30, 10_000):
            page = [r.k for r in paging.page(numbered, "k", number, 100, per_bucket).collect()]
            assert page == ordered[number * 100:(number + 1) * 100]


def test_sample_is_repeatable(numbered, keys):
    pick = lambda df, seed: [r.k for r in ranking.repeatable_sample(df, "k", 5, seed).collect()]
    assert pick(numbered, 1) == pick(numbered.repartition(2), 1) != pick(numbered, 2)
    assert len(pick(numbered.filter("k < 3"), 1)) == sum(k < 3 for k in keys)
