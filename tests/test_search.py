"""Search in blocks: rows are read once, odd numbers keep their place, what is left out cannot be among the best."""

import random

import numpy as np
import pytest

from guestlens.functions.models import word_hash_embedder
from guestlens.functions.vectors import cosine
from guestlens.plans import answers, search
from guestlens.sources import tables
from pyspark.sql import Window, functions as F

SF = "/root/testdata/sf0.001"


def brute_force(items, asks, k):
    """By the columns' cosine, as (ask, key, rank) and similarity."""
    pairs = items.crossJoin(asks).withColumn("similarity", cosine(F.col("vector"), F.col("query_vector")))
    order = Window.partitionBy("query").orderBy(F.desc_nulls_last("similarity"), "key")
    found = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return {(r["query"], r["rank"]): (r["key"], r["similarity"]) for r in found.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for place, (key, similarity) in want.items():
        assert got[place][0] == key, place
        assert got[place][1] == pytest.approx(similarity, nan_ok=True) if similarity is not None else got[place][1] is None


def test_reviews_are_embedded_once_however_many_questions(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def counting():
        embed = word_hash_embedder()

        def one(texts):
            calls.add(len(texts))
            return embed(texts)

        return one

    reviews = tables.reviews(spark, SF)
    n, different = reviews.count(), reviews.select("Review_Text").distinct().count()
    asked = spark.createDataFrame([(i, "spec", f"question {i} of the staff") for i in range(60)], "qid long, spec_key string, question string")
    asked = asked.withColumns({c: F.lit(None).cast(t) for c, t in [(f.name, f.dataType) for f in answers.FILTER_SPEC.fields] if c in answers.MATCH_FIELDS})
    monkeypatch.setattr(search, "QUERY_BYTES", 40 * 600)
    top = answers.top_reviews(reviews, asked, factory=counting)
    assert top.count() == 60 * 5
    assert calls.value <= min(n, different + 50) + 60  # in batches, reviews with one text are embedded once, too


def test_numbers_that_are_not_finite_very_large_or_nearly_equal(spark, monkeypatch):
    rng = random.Random(7)
    near = [[1.0, 2.0, 3.0 + i * 1e-9] for i in range(8)]
    odd = [[float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0], [1e200, -1e200, 1e200], [1e-200, 1e-200, 0.0], [0.0] * 3, [1.0, None, 2.0], [1.0, 2.0], [], None]
    made = [*near, *odd, *[[v * 2.0 for v in x] for x in near], *[[float(rng.randint(-2, 2)) for _ in range(3)] for _ in range(120)]]
    rows = list(enumerate(made))
    rng.shuffle(rows)
    items = spark.createDataFrame(rows, "key long, vector array<double>").repartition(3)
    asked = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0 + 4e-9], [0.0] * 3, [1e200, 0.0, 0.0], [1.0, 2.0], [1.0, None, 2.0], [], None, [-1.0, 0.5, 2.0]]
    asks = spark.createDataFrame(list(enumerate(asked)), "query long, query_vector array<double>")
    want = brute_force(items, asks, 5)
    for bytes_ in (search.QUERY_BYTES, 2_000):
        monkeypatch.setattr(search, "QUERY_BYTES", bytes_)
        got = {(r["query"], r["rank"]): (r["key"], r["similarity"]) for r in search.filtered_search(asks, items, [], "query", "key").collect()}
        same(got, want)


def test_names_as_keys_and_copies_over_tasks(spark):
    rows = [(f"r{i:03}", [float(i % 4), 1.0]) for i in range(200)]
    items = spark.createDataFrame(rows, "key string, vector array<float>").repartition(7)
    asks = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 1.0])], "query long, query_vector array<float>")
    got = {(r["query"], r["rank"]): (r["key"], r["similarity"]) for r in search.filtered_search(asks, items, [], "query", "key", k=60).collect()}
    same(got, brute_force(items, asks, 60))


def test_block_against_all_pairs(monkeypatch):
    """Many directions within the single precision's error, in pieces of few scores."""
    rng = np.random.default_rng(3)
    items = np.concatenate([rng.integers(0, 4, (400, 6)), 1 + rng.random((300, 6)) * 1e-7]).astype(float)
    items = np.unique(items, axis=0)
    copies = rng.integers(0, len(items), 900)
    item_of_key, ranks = np.concatenate([np.arange(len(items)), copies]), rng.permutation(len(items) + 900)
    asks = np.concatenate([rng.integers(0, 4, (30, 6)), np.ones((2, 6)), np.zeros((1, 6))]).astype(float)
    monkeypatch.setattr(search, "SCORES", 500)
    ask, key, score = search.Block(items, item_of_key, ranks, asks, 7).search()
    for a, vector in enumerate(asks):
        total = np.zeros(len(items))
        for d in range(6):
            total += items[:, d] * vector[d]
        every = total / (search.guarded_lengths(items) * search.guarded_lengths(asks)[a])
        order = np.lexsort((ranks, -every[item_of_key]))[:7]
        assert key[ask == a].tolist() == order.tolist()
        assert score[ask == a].tolist() == every[item_of_key][order].tolist()
