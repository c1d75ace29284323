"""The laid-out table, the bucketed store, calls in flight, attempts, and the stream over them."""

import threading
import time

import pytest
from pyspark.sql import functions as F, types as T

from guestlens.functions.models import annotate, answers_of, calls_in_flight, rule_annotator
from guestlens.operators.filters import FilterSpec, apply_filters
from guestlens.plans import enrichment
from guestlens.sources import enriched
from guestlens.sources.buckets import BucketedStore
from guestlens.streaming import enrich_stream

KEY = T.StructField("review_uid", T.LongType())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def reviews(spark):
    parks = ["Disneyland_Paris", "Disneyland_California", None, "2019"]
    rows = [(i, 3, f"2019-{i % 12 + 1}" if i % 7 else "missing", ["UK", "uk", None, "Spain"][i // 4 % 4], f"text {i}", parks[i % 4] if i % 3 else parks[0]) for i in range(400)]
    return spark.createDataFrame(rows, "review_uid long, Rating int, Year_Month string, Reviewer_Location string, Review_Text string, Branch string")


@pytest.mark.parametrize("spec", [
    FilterSpec(branch="disneyland_PARIS"), FilterSpec(branch="Disneyland_Paris", season="spring"), FilterSpec(month=6),
    FilterSpec(reviewer_location="UK", branch="2019"), FilterSpec(branch="nowhere"), FilterSpec(),
])
def test_laid_out_table_filters_like_the_raw_one(spark, tmp_path, reviews, spec):
    path = str(tmp_path / "t")
    enriched.write_enriched(reviews, path)
    table = enriched.read_laid_out(spark, path)
    want = {r.review_uid for r in apply_filters(reviews, spec).collect()}
    assert {r.review_uid for r in apply_filters(table, spec).collect()} == want
    assert table.count() == 400 and table.filter("Branch IS NULL").count() == reviews.filter("Branch IS NULL").count()


def test_filters_reach_the_scan(spark, tmp_path, reviews):
    path = str(tmp_path / "t")
    enriched.write_enriched(reviews, path)
    plan = plan_of(apply_filters(enriched.read_laid_out(spark, path), FilterSpec(branch="Disneyland_Paris", month=6, reviewer_location="UK")))
    assert "PartitionFilters: [isnotnull(branch_key" in plan and "= disneyland_paris)" in plan
    assert "EqualTo(visit_month,6)" in plan and "EqualTo(location_key,uk)" in plan
    assert sorted(p.name for p in (tmp_path / "t").glob("branch_key=*")) == [
        "branch_key=2019", "branch_key=__HIVE_DEFAULT_PARTITION__", "branch_key=disneyland_california", "branch_key=disneyland_paris"]


def store_of(spark, root, buckets=4):
    schema = T.StructType([KEY, T.StructField("value", T.StringType()), T.StructField("run_id", T.LongType())])
    return BucketedStore(spark, root, schema, "review_uid", ["run_id"], buckets)


def test_store_is_grouped_and_joined_where_it_lies(spark, tmp_path):
    store = store_of(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.compact() == 0 and store.read().count() == 0
    for run in range(3):
        store.append(spark.range(run * 10, 60).select(F.col("id").alias("review_uid"), F.lit(f"run {run}").alias("value"), F.lit(run).cast("long").alias("run_id")))
    want = {(i, f"run {min(i // 10, 2)}") for i in range(60)}
    latest = store.latest()
    assert {(r.review_uid, r.value) for r in latest.collect()} == want
    assert "Exchange" not in plan_of(latest)
    base = spark.range(0, 100).select(F.col("id").alias("review_uid")).hint("merge")
    joined = base.join(store.latest(), "review_uid", "left")
    assert joined.filter("value IS NOT NULL").count() == 60
    assert plan_of(joined).count("Exchange hashpartitioning") == 1  # the base's


def test_compaction_leaves_one_row_a_key_and_can_be_repeated(spark, tmp_path):
    store = store_of(spark, str(tmp_path / "s"))
    for run in (2, 1):
        store.append(spark.range(30).select(F.col("id").alias("review_uid"), F.lit(f"run {run}").alias("value"), F.lit(run).cast("long").alias("run_id")))
    store.append(spark.createDataFrame([(None, "lost", 9)], store.schema))
    assert store.compact() == 2 and store.version() == 2
    once = sorted(map(tuple, store.read().collect()))
    assert once == [(i, "run 2", 2) for i in range(30)]
    assert store.compact() == 3 and sorted(map(tuple, store.read().collect())) == once
    (tmp_path / "s" / "v4").mkdir()  # broken off: no mark of completeness
    assert store_of(spark, store.root).version() == 3
    store.append(spark.createDataFrame([(5, "new", 7)], store.schema))
    assert {r.value for r in store.latest().filter("review_uid = 5").collect()} == {"new"}


def test_only_the_buckets_of_the_keys_are_read(spark, tmp_path):
    store = store_of(spark, str(tmp_path / "s"), buckets=16)
    store.append(spark.range(200).select(F.col("id").alias("review_uid"), F.lit("x").alias("value"), F.lit(1).cast("long").alias("run_id")))
    keys = spark.createDataFrame([(3,), (3,), (7,), (None,), (999,)], "review_uid long")
    found = store.of_keys(keys)
    assert sorted(r.review_uid for r in found.collect()) == [3, 7]
    selected = plan_of(found.groupBy("review_uid").count()).split("SelectedBucketsCount: ")[1].split(" ")[0]
    assert int(selected) <= 3
    assert sorted(r.review_uid for r in store.of_keys(keys, most=1).collect()) == [3, 7]


def test_calls_in_flight_take_the_time_of_one_and_keep_the_order():
    running, most, lock = [0], [0], threading.Lock()

    def slow(texts):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.2)
        with lock:
            running[0] -= 1
        if "bad" in texts:
            raise ValueError("bad text")
        return [t.upper() for t in texts]

    texts = [f"t{i}" for i in range(50)]
    with calls_in_flight(50) as pool:
        start = time.perf_counter()
        assert answers_of(slow, texts, 1, pool) == [t.upper() for t in texts]
        assert time.perf_counter() - start < 2 and most[0] > 10
    most[0] = 0
    with calls_in_flight(4) as pool:
        answers = answers_of(slow, ["a", "bad", "c", "d", "e"], 2, pool)
    assert [str(a) for a in answers] == ["A", "bad text", "C", "D", "E"] and most[0] <= 4
    with calls_in_flight(1) as pool:
        assert pool is None


def test_calls_in_flight_inside_tasks(spark):
    rows = spark.range(40).select(F.col("id").alias("review_uid"), F.concat(F.lit("lovely "), F.col("id")).alias("Review_Text"))
    plain = annotate(rows, rule_annotator).collect()
    assert annotate(rows, rule_annotator, call_size=3, in_flight=8).collect() == plain


def failing_on(words):
    def factory():
        good = rule_annotator()

        def model(texts):
            if any(w in t for t in texts for w in words):
                raise ValueError("model is down")
            return good(texts)

        return model

    return factory


def test_attempts_back_off_and_end(spark, tmp_path):
    base = spark.createDataFrame([(1, "lovely"), (2, "broken")], "review_uid long, Review_Text string")
    path, tried = str(tmp_path / "store"), []
    for run in range(1, 9):
        left = enrichment.remaining(base, enrichment.read_store(base, path), run_id=run, most_attempts=3)
        tried.append(sorted(r.review_uid for r in left.collect()))
        enrichment.run_enrichment(base, path, run, failing_on(["broken"]), most_attempts=3)
    # Tried in run 1, one run later, two runs later; then it is given up.
    assert tried == [[1, 2], [2], [], [2], [], [], [], []]
    (dead,) = enrichment.dead_letters(enrichment.read_store(base, path), 3).collect()
    assert (dead.review_uid, dead.attempts, dead.last_run) == (2, 3, 4) and "model is down" in dead.enrich_error


def test_stream_tries_failed_rows_again_without_their_file(spark, tmp_path):
    results = enrich_stream.result_store(spark, str(tmp_path / "results"), KEY, 4)
    retries = enrich_stream.retry_store(spark, str(tmp_path / "retries"), KEY, 4)
    schema = T.StructType([KEY, T.StructField("Review_Text", T.StringType())])
    source = str(tmp_path / "in")

    def run(rows, down):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        enrich_stream.start_enrichment_into(
            spark, source, schema, results, retries, str(tmp_path / "ck"), failing_on(down), most_attempts=2, in_flight=2
        ).awaitTermination()

    run([(1, "lovely"), (2, "shaky"), (3, "hopeless"), (None, "no key")], ["shaky", "hopeless"])
    scored = lambda: {r.review_uid for r in results.read().filter("sentiment_score IS NOT NULL").collect()}
    assert scored() == {1} and {r.review_uid for r in retries.latest().filter("NOT done").collect()} == {2, 3}
    run([(4, "great"), (1, "lovely")], ["hopeless"])
    assert scored() == {1, 2, 4}
    assert results.read().filter("review_uid = 1").count() == 1
    assert [(r.review_uid, r.attempts) for r in enrich_stream.exhausted(retries, 2).collect()] == [(3, 2)]
    run([(5, "nice")], [])
    assert scored() == {1, 2, 4, 5}
