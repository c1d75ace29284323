import datetime

import pytest
from pyspark.sql import functions as F

from guestlens import fixed_values as fixed
from guestlens.functions import calendar, lexicon, text, themes, words
from guestlens.functions.vectors import cosine


def column(spark, values, kind, make):
    """The values of one derived column, in input order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", make(F.col("v"))).orderBy("i").collect()]


def test_months(spark):
    given = ["2019-4", "2019-04", "missing", "2019-13", "2019-x", "", None, "2019-4-1"]
    assert column(spark, given, "string", calendar.visit_month) == [4, 4, None, 13, None, None, None, 4]
    assert column(spark, given, "string", calendar.visit_month_or_zero)[2:5] == [0, 13, 0]
    starts = column(spark, given[:5], "string", calendar.month_start)
    assert starts == [datetime.date(2019, 4, 1)] * 2 + [None, None, None]


@pytest.mark.parametrize("branch, year_month, expected", [
    ("Disneyland_Paris", "2019-3", "Spring"), ("Disneyland_Paris", "2019-12", "Winter"),
    ("disney_world", "2019-7", "Summer"), ("Disneyland", "2019-10", "Autumn"), ("", "2019-1", "Winter"),
    ("Tokyo", "2019-1", None), (None, "2019-1", None), ("Disneyland_Paris", "2019-13", None),
    ("Disneyland_Paris", "missing", None), ("Disneyland_Paris", None, None),
])
def test_season(spark, branch, year_month, expected):
    row = spark.createDataFrame([(branch, year_month)], "b string, ym string")
    assert row.select(calendar.season(F.col("b"), F.col("ym"))).first()[0] == expected


def test_season_follows_each_parks_own_calendar(spark):
    seasons = [("North", "Summer", [6, 7, 8]), ("North", "Winter", [12, 1, 2]), ("South", "Summer", [12, 1, 2]), ("South", "Winter", [6, 7, 8])]
    rows = spark.createDataFrame([("North", "2020-1"), ("South", "2020-1"), ("South", "2020-4")], "b string, ym string")
    got = [r[0] for r in rows.select(calendar.season(F.col("b"), F.col("ym"), seasons)).collect()]
    assert got == ["Winter", "Summer", None]


def test_seasons_of_any_length_and_broken_spans(spark):
    seasons = [("Park", "High", [1, 5, 6, 7, 8, 12]), ("Park", "Low", [10])]
    rows = spark.createDataFrame([("park", f"2020-{m}") for m in (1, 2, 8, 10, 12, 13)], "b string, ym string")
    assert [r[0] for r in rows.select(calendar.season(F.col("b"), F.col("ym"), seasons)).collect()] == ["High", None, "High", "Low", "High", None]
    row = spark.createDataFrame([("PARK", "high")], "b string, s string")
    assert row.select(calendar.months_of_season(F.col("b"), F.col("s"), seasons)).first()[0] == [1, 5, 6, 7, 8, 12]


@pytest.mark.parametrize("branch, season, expected", [
    ("Disneyland_Paris", "spring", [3, 4, 5]), ("paris", "WINTER", [12, 1, 2]), ("Disneyland_Paris", "Fall", None),
    ("", "Spring", None), (None, "Spring", None), ("Tokyo", "Spring", None), ("paris", None, None),
])
def test_months_of_season(spark, branch, season, expected):
    row = spark.createDataFrame([(branch, season)], "b string, s string")
    assert row.select(calendar.months_of_season(F.col("b"), F.col("s"))).first()[0] == expected


@pytest.mark.parametrize("topics, crowd, price, staff, expected", [
    (["Queues", "Food"], None, None, None, ["Food", "Queue/Crowd"]),
    (["Waiting staff"], None, None, None, ["Queue/Crowd"]),
    (["Parking"], None, None, None, []),
    (None, None, None, None, []),
    (["Parking", None], "Packed", "Rip-off", "Neutral", ["Price", "Queue/Crowd", "Staff"]),
    ([], "Moderate", "Worth it", "None", []),
    ([], "None", "None", "nan", []),
    (["Kids and rides", "cleaning", "Weather", "COSTLY"], None, None, "", ["Cleanliness", "Price", "Rides", "Weather"]),
])
def test_themes(spark, topics, crowd, price, staff, expected):
    row = spark.createDataFrame([(topics, crowd, price, staff)], "t array<string>, c string, p string, s string")
    assert row.select(themes.themes_of(themes.theme_mask(*[F.col(c) for c in "tcps"]))).first()[0] == expected


def test_exploding_themes_drops_reviews_without_one(spark):
    rows = spark.createDataFrame(
        [(1, ["Food", "Food court"], None, None, None), (2, ["Parking"], None, None, None), (3, None, "Packed", None, "Rude")],
        "review_uid int, topics array<string>, crowd_level string, price_sensitivity string, staff_sentiment string",
    )
    got = sorted((r.review_uid, r.theme) for r in themes.explode_themes(rows).collect())
    assert got == [(1, "Food"), (3, "Queue/Crowd"), (3, "Staff")]


@pytest.mark.parametrize("current, said, expected", [
    (None, "It was PACKED today", "Packed"), (None, "we unpacked", None), ("None", "empty, then crowded", "Packed"),
    ("Empty", "packed", "Empty"), (None, "no wait at all", "Empty"), ("None", "nothing", None), (None, None, None),
    (None, "ça était quiet", "Empty"), (None, "équeue", None), (None, "queue.", "Packed"),
])
def test_keyword_label(spark, current, said, expected):
    row = spark.createDataFrame([(current, said)], "c string, t string")
    assert row.select(lexicon.keyword_label(F.col("c"), F.lower("t"), "crowd_level")).first()[0] == expected


def test_users_can_bring_their_own_lexicon(spark):
    own = [("mood", "Happy", r"\byay\b"), ("mood", "Sad", r"\bno+\b"), ("mood", "Happy", r"\bfun\b")]
    rows = spark.createDataFrame([(1, "nooo"), (2, "no fun"), (3, "hm")], "review_uid int, Review_Text string")
    got = [r.mood for r in lexicon.fill_labels(rows, own).orderBy("review_uid").collect()]
    assert got == ["Sad", "Happy", None]


def test_only_plain_patterns_are_searched_as_words():
    assert lexicon.plain_words("crowd_level", "Moderate") == ["moderate", "okay wait"]
    assert lexicon.plain_words("f", "l", [("f", "l", r"\bno+\b"), ("f", "l", r"\byes\b")]) is None


WORDS = ["ac", "ab", "aba", "a", "b", "c", "aaaaa", "ca", "cb", "bb", "ad", "", "ba"]
VALID = [False, False, True, True, False, True, True, True, False, False, False, False, True]


def test_word_rules(spark):
    assert column(spark, WORDS + [None], "string", words.is_valid_word) == VALID + [False]


def test_word_rules_hold_for_very_long_words(spark):
    assert column(spark, ["ab" * 200_000 + "a", "ab" * 200_000], "string", words.is_valid_word) == [True, False]


def test_valid_words_of_a_text(spark):
    assert column(spark, ["A ca\nab  aba", None], "string", words.valid_words) == [["a", "ca", "aba"], None]


def test_snippets_and_names(spark):
    cut = column(spark, ["x" * 300, "x" * 301, None], "string", lambda c: text.snippet(c, 300))
    assert cut == ["x" * 300, "x" * 300 + "...", None]
    assert column(spark, ["ab"], "string", lambda c: text.snippet(c, 150, always=True)) == ["ab..."]
    assert column(spark, ["Disneyland_HongKong", "Disney_World_Florida", None], "string", text.park_name) == [
        "HongKong", "Disney World Florida", None]
    assert column(spark, ["Food", "Ghosts"], "string", text.action_for) == [fixed.ACTIONS["Food"], fixed.DEFAULT_ACTION]
    assert column(spark, ["Rides"], "string", text.finding_action_for) == [fixed.DEFAULT_FINDING_ACTION]
    assert column(spark, [12.5, 100.0, 0.0], "double", text.evidence_text) == [
        "12.5% negative", "100.0% negative", "0.0% negative"]


def test_numbers_are_rounded_like_python(spark):
    numbers = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.75, 1.25, 2.35, 12.25, 12.35, 33.349999999999994, 77.65, 99.95, 100.0, 3.0]
    assert column(spark, numbers, "double", text.one_decimal) == [f"{n:.1f}" for n in numbers]
    import numpy as np

    assert column(spark, numbers, "double", text.round_one) == [float(np.round(n, 1)) for n in numbers]


def test_mentions_and_quotable(spark):
    assert column(spark, ["ONLINE shop", "nothing", None], "string", lambda c: text.mentions(c, ["line"])) == [True, False, False]
    lengths = ["x" * n for n in (39, 40, 300, 301)]
    assert column(spark, lengths + [None], "string", text.quotable) == [False, True, True, False, False]


def test_cosine_guards_zero_vectors(spark):
    rows = spark.createDataFrame(
        [(0, [1.0, 0.0], [1.0, 0.0]), (1, [0.0, 0.0], [1.0, 0.0]), (2, [1.0, 1.0], [1.0, 0.0]), (3, None, [1.0, 0.0])],
        "i int, a array<double>, b array<double>")
    got = [r[0] for r in rows.orderBy("i").select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [1.0, 0.0] and abs(got[2] - 0.5**0.5) < 1e-12 and got[3] is None
