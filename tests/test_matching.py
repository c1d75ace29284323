"""Specifications in bulk against one filter after the other."""

import itertools
import random

import pytest

from guestlens.operators import matching
from guestlens.operators.filters import FilterSpec, apply_filters
from guestlens.operators.matching import SpecMatcher, question_fields
from guestlens.plans.quant import keyed_specs
from guestlens.plans.answers import MATCH_FIELDS
from guestlens.schema import FILTER_SPEC

SPECS = [
    {"branch": "Disneyland_Paris", "season": "spring"}, {"branch": "DISNEYLAND_paris"}, {"season": "Autumn"},
    {"month": 6}, {"month": 6, "branch": "Disneyland_HongKong", "season": "Summer"},
    {"month": 1, "branch": "Disneyland_HongKong", "season": "Summer"}, {"month": 0, "crowd_level": ""},
    {"topics": ["food", "QUEUES"]}, {"topics": ["Rides"], "is_complaint": False}, {"topics": [], "is_complaint": True},
    {"sentiment_label": "Negative"}, {"crowd_level": "Packed", "staff_sentiment": "Rude"},
    {"price_sensitivity": "Cheap", "reviewer_location": "france"}, {"family_sentiment": "Joyful"},
    {"year_month": "2019-3"}, {"topics": ["nothing like it"]},
    {"branch": "Disneyland_Paris", "season": "spring", "topics": ["Food", "Queues", "food"], "reviewer_location": "FRANCE"},
]


@pytest.fixture(scope="module")
def reviews(spark):
    rng = random.Random(11)
    pick = lambda *values: rng.choice(values)
    rows = [(
        uid, pick("Disneyland_Paris", "Disneyland_HongKong", "Disneyland_Paris", None), rng.randint(1, 5),
        pick("2019-3", "2019-6", "2019-12", "missing", None, "2018-06"), pick("France", "UK", None, "FRANCE"), f"text {uid}",
        pick(None, 1, 3, 5), pick("Negative", "Positive", None), pick(True, False, None),
        pick(["Food"], ["Food", "Queues"], ["rides", "food", "Food"], [], None, ["Queues", None]), pick("Packed", "None", None),
        pick("Rude", None), pick("Cheap", None), pick("Joyful", "Tired", None),
    ) for uid in range(400)]
    return spark.createDataFrame(rows, (
        "review_uid long, Branch string, Rating int, Year_Month string, Reviewer_Location string, Review_Text string, "
        "sentiment_score int, sentiment_label string, is_complaint boolean, topics array<string>, crowd_level string, "
        "staff_sentiment string, price_sensitivity string, family_sentiment string")).repartition(3).persist()


@pytest.fixture(scope="module")
def specs(spark):
    rows = [[s.get(n) for n in FILTER_SPEC.fieldNames()] for s in SPECS]
    return keyed_specs(spark.createDataFrame(rows, FILTER_SPEC), MATCH_FIELDS).persist()


@pytest.fixture(scope="module")
def expected(reviews):
    return [sorted(r.review_uid for r in apply_filters(reviews, FilterSpec(**s)).collect()) for s in SPECS]


def spec_numbers(specs):
    from pyspark.sql import functions as F

    found = {}
    for r in specs.collect():
        found[r.spec_key] = next(
            i for i, s in enumerate(SPECS) if all(r[n] == s.get(n) for n in MATCH_FIELDS))
    return found


@pytest.fixture(params=["cut values", "all values"])
def matcher(request, reviews, specs, monkeypatch):
    if request.param == "all values":
        monkeypatch.setattr(matching, "VALUES_BYTES", 0)
    return SpecMatcher(reviews, specs.select("spec_key", *MATCH_FIELDS).distinct(), question_fields())


def test_counts_agree_with_single_filters(matcher, specs, expected):
    numbers = spec_numbers(specs)
    got = {numbers[r.spec_key]: r.matches for r in matcher.counts().collect()}
    assert got == {i: len(uids) for i, uids in enumerate(expected) if uids}


def test_first_matches_agree_with_single_filters(matcher, specs, expected):
    numbers = spec_numbers(specs)
    got = {}
    for r in matcher.first_matches(20).orderBy("rank").collect():
        got.setdefault(numbers[r.spec_key], []).append(r.review_uid)
    assert got == {i: uids[:20] for i, uids in enumerate(expected) if uids}


def test_label_counts_and_metrics(matcher, specs, reviews, expected):
    numbers = spec_numbers(specs)
    rows = {r.review_uid: r for r in reviews.collect()}
    labels = {}
    for r in matcher.label_counts().collect():
        labels[numbers[r.spec_key], r.sentiment_label] = r.reviews
    wanted = {}
    for i, uids in enumerate(expected):
        for uid in uids:
            wanted[i, rows[uid].sentiment_label] = wanted.get((i, rows[uid].sentiment_label), 0) + 1
    assert labels == wanted
    for r in matcher.metrics().collect():
        mine = [rows[u] for u in expected[numbers[r.spec_key]]]
        scores = [m.sentiment_score for m in mine if m.sentiment_score is not None]
        assert r.review_count == len(mine)
        assert r.avg_rating == pytest.approx(sum(m.Rating for m in mine) / len(mine))
        assert r.avg_sentiment == (pytest.approx(sum(scores) / len(scores)) if scores else None)


def test_all_matches_agree_with_single_filters(matcher, specs, expected):
    numbers = spec_numbers(specs)
    got = sorted((numbers[r.spec_key], r.review_uid) for r in matcher.matches("review_uid").collect())
    assert got == [(i, uid) for i, uids in enumerate(expected) for uid in uids]


def test_every_mask_at_once(spark):
    from pyspark.sql import functions as F

    from guestlens.operators.matching import Field

    names = [f"f{i}" for i in range(11)]
    fields = tuple(Field(n, F.col(n), F.col(n)) for n in names)
    schema = ", ".join(f"{n} string" for n in names)
    reviews = spark.createDataFrame([(1, *"abcdefghijk"), (2, *"abcdefghijx"), (3, *"xbcdefghijk")], "review_uid long, " + schema)
    asked = spark.createDataFrame([(m, *(c if m >> i & 1 else None for i, c in enumerate("abcdefghijk"))) for m in range(1, 2048)], "spec_key int, " + schema)
    got = {r.spec_key: r.matches for r in SpecMatcher(reviews, asked, fields).counts().collect()}
    assert got == {m: 1 + (not m >> 10 & 1) + (not m & 1) for m in range(1, 2048)}


def test_a_common_topic_makes_no_list_of_all_pairs(spark, reviews):
    from pyspark.sql import functions as F

    from guestlens.operators.matching import Field

    fields = (Field("place", F.col("place"), F.col("place")), Field("topic", F.col("topics"), F.col("topics"), many=True, several=True))
    rows = spark.range(2_000).select(F.col("id").alias("review_uid"), F.lit("p").alias("place"), F.array(F.lit("food"), F.concat(F.lit("own"), "id")).alias("topics"))
    asked = spark.range(500).select(F.col("id").alias("spec_key"), F.when(F.col("id") % 2 == 0, "p").alias("place"), F.array(F.lit("food")).alias("topics"))
    matcher = SpecMatcher(rows, asked, fields)
    met = matcher._met(matcher._signed(matcher.reviews.groupBy(*matcher.columns).count()))
    assert met.count() == 2
    assert {r.matches for r in matcher.counts().collect()} == {2_000} and matcher.counts().count() == 500


def test_filters_commute(reviews):
    parts = [FilterSpec(branch="Disneyland_Paris"), FilterSpec(topics=["food"]), FilterSpec(sentiment_label="Negative")]
    results = set()
    for order in itertools.permutations(parts):
        left = reviews
        for part in order:
            left = apply_filters(left, part)
        results.add(tuple(sorted(r.review_uid for r in left.collect())))
    assert len(results) == 1


def test_an_empty_specification_retrieves_nothing(reviews):
    assert apply_filters(reviews, FilterSpec()).count() == 0
    assert apply_filters(reviews, FilterSpec(unsupported_entity="Tokyo")).count() == reviews.count()


def test_values_with_separators_do_not_collide(spark, specs):
    from pyspark.sql import functions as F

    from guestlens.operators.matching import Field

    fields = (Field("x", F.col("x"), F.col("x")), Field("y", F.col("y"), F.col("y")))
    reviews = spark.createDataFrame([(1, "a|1:b", "c"), (2, "a", "b|1:c")], "review_uid long, x string, y string")
    asked = spark.createDataFrame([("k", "a|1:b", "c")], "spec_key string, x string, y string")
    assert [r.review_uid for r in SpecMatcher(reviews, asked, fields).first_matches(5).collect()] == [1]
