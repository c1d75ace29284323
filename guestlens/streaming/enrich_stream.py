"""Incremental enrichment: new review files are labelled once per key and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from guestlens.functions.models import Annotate, annotate, rule_annotator
from guestlens.operators.joins import last_per_key, not_yet_done
from guestlens.plans.enrichment import read_store, store_schema
from guestlens.session import use_checkpoints
from guestlens.sources.buckets import BUCKETS, BucketedStore
from guestlens.sources.files import append


def enrich_batch(
    reviews: DataFrame, batch_id: int, store_path: str, factory: Callable[[], Annotate],
    partitions: int | None = None, key: str = "review_uid",
) -> None:
    """Append the rows of one batch that the store does not hold yet.

    Spark may hand over a batch again after a crash; the anti-join makes the second time empty.  Rows without a key
    cannot be told from each other and are left out.
    """
    one_each = last_per_key(reviews.filter(F.col(key).isNotNull()), key, F.xxhash64("Review_Text"), ["Review_Text"])
    scored = read_store(reviews, store_path, key).filter(F.col("sentiment_score").isNotNull())
    labelled = annotate(not_yet_done(one_each, scored, key), factory, partitions=partitions)
    columns = store_schema(reviews.schema[key].dataType, key).fieldNames()
    append(labelled.withColumn("run_id", F.lit(batch_id).cast("bigint")).select(*columns), store_path)


def retry_store(spark: SparkSession, root: str, key: T.StructField, buckets: int = BUCKETS) -> BucketedStore:
    """Texts of failed rows, with their attempts; ``done`` rows need no further one."""
    schema = T.StructType([
        key, T.StructField("Review_Text", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("done", T.BooleanType()),
        T.StructField("run_id", T.LongType()),
    ])
    return BucketedStore(spark, root, schema, key.name, ["run_id", "attempts"], buckets)


def result_store(spark: SparkSession, root: str, key: T.StructField, buckets: int = BUCKETS) -> BucketedStore:
    """Results in buckets by key; the last scored one of a key counts (see ``plans.enrichment.latest_results``)."""
    return BucketedStore(spark, root, store_schema(key.dataType, key.name), key.name, ["run_id", "enriched_json"], buckets)


def enrich_into(
    store: BucketedStore, retries: BucketedStore, reviews: DataFrame, batch_id: int, factory: Callable[[], Annotate] = rule_annotator,
    most_attempts: int = 3, partitions: int | None = None, in_flight: int = 1,
) -> None:
    """Label one batch and the rows that failed in earlier ones, up to ``most_attempts`` times each.

    Of the store only the buckets of the batch's keys are read.  Failed texts wait in ``retries``, so that they are tried
    again without their file.  The labelled rows are checkpointed: the model is asked once, both stores are written from them.
    A batch that Spark hands over again finds its scored rows done; its failed rows count one attempt more.
    """
    key = store.key
    use_checkpoints(store.spark)
    fresh = last_per_key(reviews.filter(F.col(key).isNotNull()), key, F.xxhash64("Review_Text"), ["Review_Text"])
    scored = store.of_keys(fresh).filter(F.col("sentiment_score").isNotNull())
    waiting = retries.latest().filter(~F.col("done"))
    new = not_yet_done(not_yet_done(fresh, scored, key), waiting, key).withColumn("attempts", F.lit(0))
    again = waiting.filter(F.col("attempts") < most_attempts).select(key, "Review_Text", "attempts")
    labelled = annotate(new.unionByName(again), factory, partitions=partitions, in_flight=in_flight)
    labelled = labelled.withColumn("run_id", F.lit(batch_id).cast("bigint")).checkpoint()
    store.append(labelled)
    good = F.col("sentiment_score").isNotNull()
    told = labelled.filter(~good | (F.col("attempts") > 0)).withColumns({"attempts": F.col("attempts") + 1, "done": good})
    retries.append(told)


def exhausted(retries: BucketedStore, most_attempts: int = 3) -> DataFrame:
    """Rows that failed ``most_attempts`` times and are not tried any more."""
    return retries.latest().filter(~F.col("done") & (F.col("attempts") >= most_attempts))


def start_enrichment_into(
    spark: SparkSession, source: str, schema: T.StructType, store: BucketedStore, retries: BucketedStore, checkpoint: str,
    factory: Callable[[], Annotate] = rule_annotator, most_attempts: int = 3, partitions: int | None = None, in_flight: int = 1,
    max_files_per_batch: int | None = None,
) -> StreamingQuery:
    """Take in all new review files through :func:`enrich_into`, then stop."""
    reader = spark.readStream.schema(schema)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        enrich_into(store, retries, batch, batch_id, factory, most_attempts, partitions, in_flight)

    return (
        reader.parquet(source).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def start_enrichment(
    spark: SparkSession, source: str, schema: T.StructType, store_path: str, checkpoint: str,
    factory: Callable[[], Annotate] = rule_annotator, partitions: int | None = None,
    max_files_per_batch: int | None = None,
) -> StreamingQuery:
    """Take in all review files that are new since the last start, then stop.

    ``checkpoint`` and ``store_path`` must be on storage that all executors share.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        enrich_batch(batch, batch_id, store_path, factory, partitions)

    return (
        reader.parquet(source).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
