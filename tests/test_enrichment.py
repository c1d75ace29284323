import json

import pytest
from pyspark.sql import functions as F

from guestlens.functions.models import annotate, embed_text, expand_json, rule_annotator, word_hash_embedder
from guestlens.operators import joins, quality
from guestlens.plans import enrichment
from guestlens.schema import ENRICHMENT, ENRICHMENT_WITH_SUMMARY
from guestlens.streaming.enrich_stream import enrich_batch, start_enrichment

FIELDS = ENRICHMENT.fieldNames()


def flaky(bad):
    """An annotator that fails on texts with a word, and on whole batches with another."""

    def factory():
        good = rule_annotator()

        def call(texts):
            if any("crash" in t for t in texts):
                raise RuntimeError("model is down")
            return [ValueError("refused") if bad in t else a for t, a in zip(texts, good(texts))]

        return call

    return factory


@pytest.fixture()
def base(spark):
    rows = [(i, f"visit {i} lovely" if i % 2 else f"visit {i} rude and packed", None if i % 5 else 3) for i in range(40)]
    return spark.createDataFrame(rows, "review_uid long, Review_Text string, sentiment_score int")


def test_annotation_gives_typed_columns(spark):
    rows = spark.createDataFrame([(1, "Lovely and quiet"), (2, "Rude staff, overpriced food"), (3, None)], "review_uid int, Review_Text string")
    got = {r.review_uid: r for r in annotate(rows).collect()}
    assert (got[1].sentiment_score, got[1].sentiment_label, got[1].crowd_level, got[1].family_sentiment) == (5, "Positive", "Empty", "Joyful")
    assert (got[2].sentiment_score, got[2].is_complaint, got[2].staff_sentiment, got[2].price_sensitivity) == (1, True, "Rude", "Expensive")
    assert got[2].topics == ["Food", "Staff", "Price"] and got[3].sentiment_score == 3
    assert json.loads(got[1].enriched_json)["sentiment_label"] == "Positive" and got[1].enrich_error is None


def test_json_expansion_of_junk_and_larger_records(spark):
    rows = spark.createDataFrame([(1, "{}"), (2, "junk"), (3, '{"sentiment_score": 4, "topics": ["a"], "summary": "s", "other": 1}'), (4, None)], "i int, j string")
    got = [tuple(r) for r in expand_json(rows, "j", ENRICHMENT_WITH_SUMMARY).orderBy("i").select("sentiment_score", "topics", "summary").collect()]
    assert got == [(None, None, None), (None, None, None), (4, ["a"], "s"), (None, None, None)]


def test_failures_stay_null_and_are_retried(base, tmp_path):
    store = str(tmp_path / "results")
    enrichment.run_enrichment(base, store, 1, flaky("visit 3 "))
    first = enrichment.read_store(base, store)
    assert first.count() == 32 and first.filter("enrich_error IS NOT NULL").count() == 1
    assert [r.review_uid for r in enrichment.remaining(base, first).collect()] == [3]
    enrichment.run_enrichment(base, store, 2)
    second = enrichment.read_store(base, store)
    assert second.count() == 33 and enrichment.remaining(base, second).count() == 0
    view = enrichment.enriched_view(base, store)
    assert view.count() == 40 and view.filter("sentiment_score IS NULL").count() == 0


def test_a_failing_model_is_recorded_per_row(spark):
    rows = spark.createDataFrame([(1, "crash"), (2, "fine")], "review_uid int, Review_Text string").coalesce(1)
    got = {r.review_uid: r for r in annotate(rows, flaky("none")).collect()}
    assert got[1].enriched_json is None and "model is down" in got[1].enrich_error
    assert got[2].enriched_json and got[2].enrich_error is None


def test_running_twice_equals_running_once(base, tmp_path):
    store = str(tmp_path / "results")
    for run in (1, 2):
        enrichment.run_enrichment(base, store, run)
    assert enrichment.read_store(base, store).count() == 32
    whole = {r.review_uid: r.sentiment_score for r in enrichment.enriched_view(base, store).collect()}
    piecewise = str(tmp_path / "piecewise")
    for run in range(1, 9):
        enrichment.run_enrichment(base.repartition(run), piecewise, run, batch_size=5, limit_batches=1)
    assert {r.review_uid: r.sentiment_score for r in enrichment.enriched_view(base, piecewise).collect()} == whole


@pytest.mark.parametrize("exact, expected", [(True, 20), (False, None)])
def test_limit_on_batches(base, tmp_path, exact, expected):
    # 32 rows in batches of 10 make 3 batches of 11, 11 and 10 rows; two of them hold 22 rows.
    store = str(tmp_path / "results")
    enrichment.run_enrichment(base, store, 1, batch_size=10, limit_batches=2, exact_batches=exact, partitions=2)
    done = sorted(r.review_uid for r in enrichment.read_store(base, store).collect())
    todo = [i for i in range(40) if i % 5]
    assert done == todo[:22] if exact else 0 < len(done) < 32


def results(spark, rows):
    schema = "review_uid long, sentiment_score int, sentiment_label string, topics array<string>, is_complaint boolean, " \
        "crowd_level string, staff_sentiment string, price_sensitivity string, family_sentiment string, seq int"
    return spark.createDataFrame(rows, schema)


def test_merge_policies(spark):
    old = results(spark, [
        (1, None, None, None, None, "Packed", None, None, None, 0), (2, 4, "Positive", ["a"], False, "Empty", None, None, None, 0),
        (3, None, None, None, None, None, "Rude", None, None, 0),
    ]).drop("seq")
    new = results(spark, [
        (1, 2, "Negative", ["b"], True, "Empty", None, None, None, 1), (1, 1, "Negative", ["c"], True, None, None, None, None, 2),
        (2, 1, "Negative", ["d"], True, None, "Rude", None, None, 1), (3, None, "Negative", None, None, "Empty", None, None, None, 1),
    ])
    shown = ["review_uid", "sentiment_score", "topics", "crowd_level", "staff_sentiment"]

    def rows(df):
        return [tuple(r) for r in df.select(*shown).orderBy("review_uid").collect()]

    resumed = joins.fill_from_checkpoint(old, new, order=F.col("seq"))
    assert rows(resumed) == [(1, 1, ["c"], "Packed", None), (2, 4, ["a"], "Empty", "Rude"), (3, None, None, None, "Rude")]
    written = joins.overwrite_from_results(old, new.filter("review_uid < 3"), order=F.col("seq"))
    assert rows(written) == [(1, 1, ["c"], None, None), (2, 1, ["d"], None, "Rude"), (3, None, None, None, "Rude")]
    latest = joins.last_per_key(new, "review_uid", F.col("seq"), FIELDS)
    assert rows(enrichment.merged(old, latest)) == [(1, 1, ["c"], "Packed", None), (2, 1, ["d"], "Empty", "Rude"), (3, None, None, "Empty", "Rude")]
    with pytest.raises(ValueError):
        enrichment.merged(old, latest, "other")


def test_whole_job(spark, raw, tmp_path):
    out = enrichment.enrich_reviews(spark, raw, str(tmp_path / "root"), str(tmp_path / "v4"), 1, stage_out=str(tmp_path / "stage2"))
    rows = {r.review_uid: r for r in out.collect()}
    assert [rows[k].Season for k in "123"] == ["Spring", "Spring", "Winter"]
    assert all(r.sentiment_score for r in rows.values())
    assert out.columns[0] == "Branch" and out.columns[-1] == "review_uid"
    again = enrichment.enrich_reviews(spark, raw, str(tmp_path / "root"), str(tmp_path / "v5"), 2)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, out.select(again.columns).collect()), key=repr)


def test_embedder_counts_words(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None)], "i int, t string")
    got = {r.i: r.v for r in rows.select("i", embed_text(F.col("t"))["vector"].alias("v")).collect()}
    assert sum(got[1]) == 3.0 and max(got[1]) in (2.0, 3.0) and sum(got[2]) == 0.0
    assert list(word_hash_embedder()(["a b a"])[0]) == got[1]


def choosy():
    """A model that fails a whole call if one text of it is bad."""
    def embed(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no such text")
        return word_hash_embedder()(texts)

    return embed


def test_one_bad_text_fails_one_row(spark):
    rows = spark.createDataFrame([(i, "bad text" if i == 77 else f"text {i}") for i in range(200)], "review_uid int, Review_Text string").coalesce(1)
    from guestlens.plans.search import with_embeddings

    got = {r.review_uid: r for r in with_embeddings(rows, "Review_Text", choosy).collect()}
    assert [i for i, r in got.items() if r.vector is None] == [77]
    assert "no such text" in got[77].vector_error and got[78].vector_error is None

    def annotator():
        def call(texts):
            choosy()(texts)
            return rule_annotator()(texts)
        return call

    labelled = {r.review_uid: r for r in annotate(rows, annotator).collect()}
    assert [i for i, r in labelled.items() if r.sentiment_score is None] == [77] and labelled[77].enrich_error


def test_embeddings_are_stored_once(spark, tmp_path):
    from guestlens.plans import search

    path = str(tmp_path / "vectors")
    rows = spark.createDataFrame([(i, "bad text" if i == 3 else f"text {i}") for i in range(8)], "review_uid int, Review_Text string")
    search.embed_new(rows.filter("review_uid < 5"), path, 1, choosy)
    search.embed_new(rows, path, 2, choosy)
    stored = search.read_vectors(rows, path)
    assert sorted((r.review_uid, r.run_id) for r in stored.collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (5, 2), (6, 2), (7, 2)]
    search.embed_new(rows, path, 3)
    latest = {r.review_uid: r.vector_norm for r in search.latest_vectors(search.read_vectors(rows, path)).collect()}
    assert len(latest) == 8 and all(n > 0 for n in latest.values())


def test_stream_takes_every_review_once(spark, base, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "results", "checkpoint"))

    def run(where):
        start_enrichment(spark, source, base.schema, store, where, max_files_per_batch=1).awaitTermination(120)
        return enrichment.read_store(base, store)

    base.filter("review_uid < 20").write.mode("append").parquet(source)
    assert run(checkpoint).count() == 20
    assert run(checkpoint).count() == 20
    base.filter("review_uid >= 10").write.mode("append").parquet(source)
    assert run(checkpoint).count() == 40
    # A lost checkpoint replays all files; known keys are left out.
    assert run(str(tmp_path / "fresh")).count() == 40
    assert run(checkpoint).select("review_uid").distinct().count() == 40


def test_a_replayed_batch_adds_nothing(base, tmp_path):
    store = str(tmp_path / "results")
    doubled = base.unionByName(base)
    for _ in range(2):
        enrich_batch(doubled, 0, store, rule_annotator)
    assert enrichment.read_store(base, store).count() == 40


ANSWERS = [
    ("good enough for an answer about Paris", ["paris", "rome"], ["cannot answer"], True),
    ("good enough for an answer about Rome", ["Paris"], [], False),
    ("I Cannot Answer that, not about Paris", ["Paris"], ["cannot answer"], False),
    ("Paris, short", ["Paris"], [], False), ("an answer with \U0001F603 and enough text", [], [], False),
    ("an answer with \U0001F600 and enough text", [], [], True), ("no words expected at all here", [], [], True),
    (None, [], [], False), ("no lists are given for this one", None, None, True),
]


def test_answer_checks(spark):
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(ANSWERS)], "i int, answer string, expected array<string>, forbidden array<string>, wanted boolean")
    checked = quality.check_answers(rows)
    assert all(r.passed == r.wanted for r in checked.collect())
    assert tuple(quality.suite_summary(checked).first()) == (sum(a[3] for a in ANSWERS), len(ANSWERS))


def test_router_accuracy(spark):
    golden = spark.createDataFrame([(1, "a", None), (2, None, 6), (3, "c", 1)], "qid int, branch string, month int")
    guessed = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "qid int, branch string, month int")
    got = {r.field: r.match_rate for r in quality.router_accuracy(golden, guessed, ["branch", "month"]).collect()}
    assert got == {"branch": pytest.approx(2 / 3), "month": pytest.approx(1 / 3)}
