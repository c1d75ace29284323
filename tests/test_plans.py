import statistics

import pytest
from pyspark.sql import functions as F

from guestlens import fixed_values as fixed
from guestlens.functions.vectors import with_norm
from guestlens.operators import compare, insights
from guestlens.plans import answers, playbook, quant, search
from guestlens.plans.answers import answered, chart_selection, guard, parse_specs
from guestlens.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reviews(spark):
    return tables.reviews(spark, SF).persist()


# --- the metric tasks of the original test suite ------------------------------------------

def test_quant_tasks(spark, raw):
    scored = raw.withColumn("sentiment_score", F.lit(None).cast("int"))
    tasks = spark.createDataFrame(
        [("australia", None, None, None, "Australia"), ("spring", None, "spring", None, None), ("december", None, None, 12, None),
         ("nowhere", "Tokyo", None, None, None), ("all", None, None, None, None)],
        "task_id string, branch string, season string, month int, reviewer_location string")
    got = {r.task_id: r for r in quant.task_metrics(scored, tasks).collect()}
    assert (got["australia"].review_count, got["australia"].avg_rating) == (2, 4.0)
    assert got["spring"].review_count == 2 and got["december"].review_count == 1
    assert (got["nowhere"].review_count, got["nowhere"].avg_rating) == (0, None)
    assert got["all"].review_count == 3
    compared = quant.against_baseline(quant.task_metrics(scored, tasks), quant.overall_metrics(scored))
    shown = {r.task_id: r for r in compared.collect()}
    assert shown["australia"].avg_rating_vs_baseline_pct == pytest.approx((4.0 - 3.0) / 3.0 * 100)


def test_vector_search_of_the_original_test_suite(spark):
    items = spark.createDataFrame([(1, [0.1, 0.2, 0.3]), (2, [0.9, 0.8, 0.7]), (3, [0.1, 0.2, 0.3])], "key int, vector array<double>")
    queries = spark.createDataFrame([(1, [0.1, 0.2, 0.3])], "query int, query_vector array<double>")
    got = [(r.key, r["rank"]) for r in search.filtered_search(queries, items, [], "query", "key", k=3).orderBy("rank").collect()]
    assert got == [(1, 1), (3, 2), (2, 3)]


def test_search_with_open_filters_and_topics(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], "a", ["x", "y"], "one"), (2, [0.9, 0.1], "b", ["y"], "two"), (3, [0.0, 1.0], "a", None, "three")],
                                  "key int, vector array<double>, place string, topics array<string>, text string")
    queries = spark.createDataFrame([(1, [1.0, 0.0], None, None), (2, [1.0, 0.0], "a", None), (3, [1.0, 0.0], None, ["y", "x"]), (4, [1.0, 0.0], "b", ["x"]), (5, [0.0, 1.0], None, [])],
                                    "query int, query_vector array<double>, place string, topics array<string>")
    found = {}
    for r in search.filtered_search(queries, items, ["place", "topics"], "query", "key", shown=["text"]).orderBy("rank").collect():
        found.setdefault(r["query"], []).append(r.text)
    assert found == {1: ["one", "two", "three"], 2: ["one", "three"], 3: ["one", "two"], 5: ["three", "two", "one"]}


def test_without_vectors_the_first_keys_remain(spark):
    pairs = spark.createDataFrame([(1, k, None, [1.0]) for k in range(9)], "query int, key int, vector array<double>, query_vector array<double>")
    pairs = with_norm(with_norm(pairs, "vector"), "query_vector")
    got = [r.key for r in search.top_by_similarity(pairs, "query", "vector", "query_vector", "key").orderBy("rank").collect()]
    assert got == [0, 1, 2, 3, 4]


# --- playbook -----------------------------------------------------------------------------

def brute_force_cells(reviews):
    from guestlens.functions.themes import explode_themes

    cells = {}
    for r in explode_themes(insights.with_season(reviews)).collect():
        cells.setdefault((r.Branch, r.Season, r.theme), []).append(r)
    return {k: v for k, v in cells.items() if None not in k}


def test_heatmap_against_plain_python(reviews):
    cells = brute_force_cells(reviews)
    got = {(r.Branch, r.Season, r.theme): r for r in insights.theme_season_heatmap(reviews, least=5).collect()}
    assert got.keys() == cells.keys()
    for key, rows in cells.items():
        scores = [r.sentiment_score for r in rows if r.sentiment_score is not None]
        expected = statistics.median(scores) if len(rows) >= 5 and scores else None
        assert (got[key].volume, got[key].median_sentiment) == (len(rows), expected)


def test_playbook_does_not_depend_on_the_order_of_rows(reviews):
    first = [tuple(r) for r in playbook.cx_playbook(reviews).collect()]
    second = [tuple(r) for r in playbook.cx_playbook(reviews.orderBy(F.desc("review_uid")).repartition(7)).collect()]
    assert first == second and len(first) == 11
    assert all(r[11] is False for r in first)


def test_window_baseline_equals_joined_baseline(reviews):
    cells = insights.theme_cells(reviews)
    joined = playbook.with_baseline(playbook.playbook_cells(cells, 5), cells).filter("NOT low_data_flag")
    left = {(r.Branch, r.Season, r.theme): r.baseline_severity for r in joined.collect()}
    right = {(r.Branch, r.Season, r.theme): r.baseline_severity for r in playbook.playbook_trends(reviews, 5).collect()}
    assert left == right


def test_quotes(spark):
    def row(uid, text, label="Negative", topics=("Food",)):
        return (uid, "Disneyland_Paris", "2019-3", text, label, list(topics), None, None, None, 1)

    rows = [row(5, "x" * 301), row(4, "short"), row(9, "y" * 40), row(12, "z" * 50), row(1, "p" * 100, "Positive"),
            row(6, "s" * 10, topics=["Rides"]), row(3, "t" * 400, topics=["Rides"]), row(7, "ok" * 30, "Positive", ["Weather"])]
    frame = spark.createDataFrame(rows, (
        "review_uid long, Branch string, Year_Month string, Review_Text string, sentiment_label string, topics array<string>, "
        "crowd_level string, price_sensitivity string, staff_sentiment string, sentiment_score int"))
    got = {r.theme: r.quote for r in playbook.quotes(frame).collect()}
    assert got == {"Food": "y" * 40, "Rides": "t" * 150 + "..."}
    issues = playbook.critical_issues(playbook.playbook_trends(frame, min_volume=1))
    told = {r.theme: r.representative_quote for r in playbook.with_quotes(issues, frame).collect()}
    assert told["Weather"] == fixed.NO_QUOTE


def test_trend_limits(spark):
    deltas = [-0.21, -0.2, 0.0, 0.2, 0.21, None]
    rows = spark.createDataFrame([(d,) for d in deltas], "d double")
    same = fixed.TREND_SAME
    assert [r[0] for r in rows.select(playbook.trend(F.col("d"))).collect()] == [fixed.TREND_WORSE, same, same, same, fixed.TREND_BETTER, same]


def test_narrative_of_an_empty_playbook(reviews):
    empty = playbook.cx_playbook(reviews, min_volume=10**9)
    assert [r[0] for r in playbook.narrative(empty).collect()] == [fixed.NO_ISSUES]
    assert playbook.narrative_lines(empty).count() == 0


def test_narrative_without_worsening(reviews):
    calm = playbook.cx_playbook(reviews).withColumn("trend", F.lit(fixed.TREND_SAME))
    assert fixed.NO_WORSENING in playbook.narrative(calm).first()[0]


def test_findings_of_parks_without_enough_data(reviews):
    assert {r.finding for r in playbook.insight_findings(reviews, least=10**9).collect()} == {fixed.NO_THEMES_MET}


def test_crowd_levels_keep_their_order_and_missing_ones(reviews):
    got = [(r.position, r.crowd_level) for r in insights.crowd_impact(reviews.filter("crowd_level = 'Empty'")).collect()]
    assert got == list(enumerate(fixed.CROWD_LEVEL_ORDER))


def test_confusion_adds_up(reviews):
    from guestlens.functions.lexicon import fill_labels

    paired = compare.side_by_side(reviews, fill_labels(reviews), "crowd_level")
    assert sum(r.reviews for r in compare.confusion(paired, "crowd_level_a", "crowd_level_b").collect()) == reviews.count()


def test_report_tables(reviews):
    from guestlens.plans.report import report_tables

    tables_of = report_tables(reviews)
    assert [tuple(r) for r in tables_of["playbook"].collect()] == [tuple(r) for r in playbook.cx_playbook(reviews).collect()]
    heat = {(r.Branch, r.Season, r.theme): r.volume for r in tables_of["theme_season_heatmap"].collect()}
    assert heat == {(r.Branch, r.Season, r.theme): r.volume for r in insights.theme_season_heatmap(reviews).collect()}
    assert all(t.count() > 0 for t in tables_of.values())


# --- questions ----------------------------------------------------------------------------

def ask(spark, *specs):
    return spark.createDataFrame([(i, q, s) for i, (q, s) in enumerate(specs)], "qid long, question string, spec_json string")


def test_specifications_that_do_not_parse_become_the_default(spark):
    asked = ask(spark, ("", "junk"), ("", None), ("", "{}"), ("", '{"month": "June", "reasoning": "r"}'), ("", '{"intent": "dance", "reasoning": "r"}'),
                ("", '{"month": 6, "reasoning": "r", "branch": null}'), ("", '{"intent": "view_report", "reasoning": "r"}'))
    got = [(r.parsed, r.intent, r.month) for r in parse_specs(asked).orderBy("qid").collect()]
    assert got == [(False, "search_reviews", None)] * 5 + [(True, "search_reviews", 6), (True, "view_report", None)]


def test_numbers_and_truth_values_may_be_texts(spark):
    asked = ask(spark, ("", '{"month": "6", "branch": "Paris", "is_complaint": "yes", "reasoning": "r"}'), ("", '{"month": 6.0, "is_complaint": false, "reasoning": "r"}'),
                ("", '{"month": 6.5, "branch": "Paris", "reasoning": "r"}'), ("", '{"is_complaint": "perhaps", "reasoning": "r"}'))
    got = [(r.parsed, r.month, r.branch, r.is_complaint) for r in parse_specs(asked).orderBy("qid").collect()]
    assert got == [(True, 6, "Paris", True), (True, 6, None, False), (False, None, None, None), (False, None, None, None)]


@pytest.mark.parametrize("spec, branch, refused", [
    ('"branch": "Paris"', "Disneyland_Paris", None), ('"branch": " disneyland_hongKong "', "Disneyland_HongKong", None),
    ('"branch": "EuroDisney resort"', "Disneyland_Paris", None), ('"branch": "Disneyland"', "Disneyland", "Disneyland"),
    ('"branch": "orlando"', "Disney_World_Florida", "Disney_World_Florida"),
    ('"unsupported_entity": "Tel-Aviv"', "Tel-Aviv", "Tel-Aviv"), ('"unsupported_entity": "HK"', "Disneyland_HongKong", None),
    ('"unsupported_entity": "disneyland", "branch": "Paris"', "Paris", "disneyland"), ('"month": 3', None, None),
    ('"intent": "view_report", "branch": "Atlantis"', "Atlantis", None), ('"branch": ""', "", None),
])
def test_guard(spark, spec, branch, refused):
    parks = spark.createDataFrame([("Disneyland_Paris",), ("Disneyland_HongKong",)], "Branch string")
    got = guard(parse_specs(ask(spark, ("", '{"reasoning": "r", ' + spec + "}"))), parks).first()
    assert (got.branch, got.refusal_reason) == (branch, refused)
    if refused:
        assert got.refusal == f"I do not have data about {refused}. I only have data for: Disneyland_HongKong, Disneyland_Paris."


def test_chart_selection(spark):
    parks = spark.createDataFrame([("Disneyland_Paris",), ("Disneyland_HongKong",)], "Branch string")
    asked = ask(
        spark, ("How long is the QUEUE?", '{"reasoning": "r", "branch": "paris"}'), ("hello", '{"reasoning": "r", "topics": ["Queues", "Staffing"]}'),
        ("hello", '{"reasoning": "r", "reviewer_location": "UK", "sentiment_label": "Negative"}'), ("sum up", '{"reasoning": "r", "intent": "view_report", "branch": "Disneyland_Paris"}'),
        ("list the charts", '{"reasoning": "r", "intent": "view_report"}'), ("hello", '{"reasoning": "r", "intent": "capability_discovery"}'),
        ("worst queue", '{"reasoning": "r", "unsupported_entity": "Tokyo"}'))
    got = {}
    for r in chart_selection(guard(parse_specs(asked), parks), parks).orderBy("qid", "position").collect():
        got.setdefault(r.qid, []).append(r.type)
    every = [kind for _, kind, _ in fixed.GLOBAL_CHARTS]
    assert got == {0: ["sent_heatmap", "crowd"], 1: ["staff", "crowd"], 2: ["drivers", "country"], 3: ["sent_heatmap", *every],
                   4: ["sent_heatmap", "sent_heatmap", *every]}


def test_answers_of_questions(spark, reviews):
    asked = ask(spark, ("friendly cast", '{"reasoning": "r", "branch": "paris"}'), ("", '{"reasoning": "r", "branch": "Atlantis"}'), ("", '{"reasoning": "r"}'),
                ("", '{"reasoning": "r", "topics": ["nothing"]}'))
    got = {r.qid: r for r in answered(reviews, asked).collect()}
    paris = reviews.filter("Branch = 'Disneyland_Paris'").count()
    assert got[0].matches == paris and f"Found {paris} matches of 1500 entries. Using top 5." in got[0].summary
    assert got[0].context.startswith("1. ") and len(got[0].context.split("\n5. ")) == 2
    assert got[1].refusal.startswith("I do not have data about Atlantis.") and got[1].summary is None
    assert got[2].summary is None and got[2].refusal is None
    assert (got[3].matches, got[3].distribution, got[3].context) == (0, "N/A", None)


def test_candidates_come_in_key_order(spark, reviews):
    asked = answers.searches(guard(parse_specs(ask(spark, ("", '{"reasoning": "r", "topics": []}'))), insights.valid_branches(reviews)))
    got = [r.review_uid for r in answers.candidates(reviews, asked, 10).orderBy("rank").collect()]
    assert got == [r.review_uid for r in reviews.orderBy("review_uid").limit(10).collect()]


def test_search_in_blocks_equals_brute_force(spark, monkeypatch):
    """Ties, equal vectors, zeros, missing and short vectors; questions that share a text; passes over few queries each."""
    import random

    rng = random.Random(4)
    made = lambda: rng.choice([None, [0.0] * 3, [1.0, 0.0, 1.0], [float(rng.randint(-2, 2)) for _ in range(3)], [1.0]])
    rows = [(i, rng.choice("ab"), made()) for i in range(300)]
    asks = [(i, rng.choice(["a", "b", None]), rng.choice([None, [1.0, 0.0, 1.0], [0.5, -1.0, 2.0], [0.0] * 3])) for i in range(40)]
    items = spark.createDataFrame(rows, "key long, place string, vector array<float>").repartition(5)
    queries = spark.createDataFrame(asks, "query long, place string, query_vector array<double>")

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b):
            return None
        length = lambda v: sum(x * x for x in v) ** 0.5 or 1e-9
        return sum(x * y for x, y in zip(a, b)) / (length(a) * length(b))

    want = set()
    for query, place, vector in asks:
        scored = [(key, cosine(v, vector)) for key, p, v in rows if place in (None, p)]
        scored.sort(key=lambda s: (s[1] is None, -(s[1] or 0), s[0]))
        want |= {(query, key, None if c is None else round(c, 9), rank + 1) for rank, (key, c) in enumerate(scored[:5])}
    for bytes_ in (search.QUERY_BYTES, 200):
        monkeypatch.setattr(search, "QUERY_BYTES", bytes_)
        monkeypatch.setattr(search, "SCORES", 64 if bytes_ == 200 else 1 << 21)
        got = search.filtered_search(queries, items, ["place"], "query", "key").collect()
        assert {(r.query, r.key, None if r.similarity is None else round(r.similarity, 9), r["rank"]) for r in got} == want
        assert len(got) == len(want)


def test_answers_from_stored_vectors(spark, tmp_path):
    """A second run embeds new reviews only and gives the same answers."""
    from guestlens.functions.models import word_hash_embedder

    calls = spark.sparkContext.accumulator(0)

    def counting():
        embed = word_hash_embedder()

        def one(texts):
            calls.add(len(texts))
            return embed(texts)

        return one

    schema = ("review_uid long, Branch string, Rating int, Year_Month string, Reviewer_Location string, Review_Text string, sentiment_score int, "
              "sentiment_label string, topics array<string>, is_complaint boolean, crowd_level string, staff_sentiment string, price_sensitivity string, family_sentiment string")
    rows = [(i, "Disneyland_Paris", 3, "2019-4", "UK", f"text number {i} of staff", 3, "Neutral", ["Staff"], False, None, None, None, None) for i in range(12)]
    asked = spark.createDataFrame([(1, "text number 7", '{"reasoning": "r", "branch": "Paris"}')], "qid long, question string, spec_json string")
    path = str(tmp_path / "vectors")
    plain = answered(spark.createDataFrame(rows, schema), asked).collect()
    first = answered(spark.createDataFrame(rows[:10], schema), asked, path, 1, counting)
    first.collect()
    assert search.read_vectors(spark.createDataFrame(rows, schema), path).count() == 10
    before = calls.value
    second = answered(spark.createDataFrame(rows, schema), asked, path, 2, counting).collect()
    assert second == plain
    assert search.read_vectors(spark.createDataFrame(rows, schema), path).groupBy("run_id").count().orderBy("run_id").collect() == [(1, 10), (2, 2)]
    assert calls.value - before < 10
