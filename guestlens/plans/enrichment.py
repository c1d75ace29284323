"""Resumable model enrichment.

Results go to an append-only store of (key, enrichment, run).  A run takes the rows of the base that
have neither a score of their own nor one in the store, labels them and appends.  A lost executor
repeats its tasks; a lost driver leaves the store with the runs that were committed.  Rows that failed
are stored with their error, do not count as done, and are tried again by the next run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from guestlens.functions.lexicon import fill_labels
from guestlens.functions.models import Annotate, annotate, rule_annotator
from guestlens.operators.insights import with_season
from guestlens.operators.joins import fill_from_checkpoint, last_per_key, not_yet_done, overwrite_from_results, with_keys
from guestlens.operators.ranking import even_batches, hashed_batches
from guestlens.schema import ENRICHMENT, ensure_columns, layout
from guestlens.sources.enriched import read_laid_out, write_enriched
from guestlens.sources.files import append, read_if_present, write_stage

FIELDS = tuple(ENRICHMENT.fieldNames())
BATCH_SIZE = 50


def store_schema(key_type: T.DataType, key: str = "review_uid") -> T.StructType:
    return T.StructType(
        [T.StructField(key, key_type), *ENRICHMENT.fields,
         T.StructField("enriched_json", T.StringType()), T.StructField("enrich_error", T.StringType()),
         T.StructField("run_id", T.LongType())]
    )


def read_store(base: DataFrame, path: str, key: str = "review_uid") -> DataFrame:
    """All stored results; an empty frame before the first run."""
    spark = base.sparkSession
    schema = store_schema(base.schema[key].dataType, key)
    stored = read_if_present(spark, path, schema)
    return spark.createDataFrame([], schema) if stored is None else stored


def latest_results(store: DataFrame, key: str = "review_uid") -> DataFrame:
    """The last scored result per key: copies from repeated runs count once."""
    scored = store.filter(F.col("sentiment_score").isNotNull())
    return last_per_key(scored, key, F.struct("run_id", "enriched_json"), [*FIELDS, "run_id"])


def failures(store: DataFrame, key: str = "review_uid") -> DataFrame:
    """Keys without a score in any run: number of runs that tried, the last of them and its error."""
    scored = F.max(F.col("sentiment_score").isNotNull())
    last = F.max_by(F.struct("run_id", "enrich_error"), F.struct("run_id", F.col("enrich_error").isNotNull(), "enrich_error"))
    tried = store.groupBy(key).agg(scored.alias("_scored"), F.count_distinct("run_id").alias("attempts"), last.alias("_last"))
    return tried.filter(~F.col("_scored")).select(key, "attempts", F.col("_last.run_id").alias("last_run"), F.col("_last.enrich_error").alias("enrich_error"))


def dead_letters(store: DataFrame, most_attempts: int, key: str = "review_uid") -> DataFrame:
    """Rows that failed in ``most_attempts`` runs and are not tried any more."""
    return failures(store, key).filter(F.col("attempts") >= most_attempts)


def remaining(
    base: DataFrame, store: DataFrame, key: str = "review_uid", run_id: int | None = None, most_attempts: int | None = None,
) -> DataFrame:
    """Rows without a score in the base and in the store.

    With ``most_attempts`` rows that failed so often are left out, and one that failed n times waits for 2 ** (n - 1)
    runs after the last one that tried it (``run_id`` counts the runs).
    """
    unscored = ensure_columns(base, ENRICHMENT).filter(F.col("sentiment_score").isNull())
    todo = not_yet_done(unscored, store.filter(F.col("sentiment_score").isNotNull()), key)
    if most_attempts is None:
        return todo
    waiting = F.lit(run_id) < F.col("last_run") + F.pow(F.lit(2.0), F.col("attempts") - 1)
    held = failures(store, key).filter((F.col("attempts") >= most_attempts) | waiting)
    return not_yet_done(todo, held, key)


def first_batches(todo: DataFrame, key: str, batch_size: int, limit: int | None, exact: bool = True) -> DataFrame:
    """The rows of the first ``limit`` batches; all rows without a limit.

    Only keys are numbered; texts stay out of the sort.  ``exact`` counts batches in key order; otherwise a hash of the key assigns the rows, which costs
    one count and no shuffle.
    """
    if limit is None:
        return todo
    keys = todo.select(key)
    if exact:
        numbered = even_batches(keys, key, batch_size, "_batch")
    else:
        numbered = hashed_batches(keys, key, max(1, keys.count() // batch_size), "_batch")
    return with_keys(todo, numbered.filter(F.col("_batch") < limit), key)


def run_enrichment(
    base: DataFrame, store_path: str, run_id: int, factory: Callable[[], Annotate] = rule_annotator,
    key: str = "review_uid", batch_size: int = BATCH_SIZE, limit_batches: int | None = None,
    partitions: int | None = None, exact_batches: bool = True, in_flight: int = 1, most_attempts: int | None = None,
) -> None:
    """Label what is left of ``base`` and append it to the store.

    Each task has up to ``in_flight`` calls under way.  ``most_attempts`` as in :func:`remaining`.
    """
    todo = remaining(base, read_store(base, store_path, key), key, run_id, most_attempts)
    todo = first_batches(todo, key, batch_size, limit_batches, exact_batches)
    labelled = annotate(
        todo.select(key, "Review_Text"), factory, partitions=partitions, call_size=batch_size, in_flight=in_flight)
    columns = store_schema(base.schema[key].dataType, key).fieldNames()
    append(labelled.withColumn("run_id", F.lit(run_id).cast("bigint")).select(*columns), store_path)


def merged(base: DataFrame, results: DataFrame, policy: str = "model", key: str = "review_uid") -> DataFrame:
    """The base with results, of which a key's last run counts.

    ``model``: the model's value, or the present one where the model has none.
    ``resume``: present values stay, results fill nulls; as when a run is taken up again.
    ``overwrite``: the model's values for all its rows, nulls too; as within one run.
    """
    base = ensure_columns(base, ENRICHMENT)
    if policy == "resume":
        return fill_from_checkpoint(base, results, F.col("run_id"), key)
    if policy == "overwrite":
        return overwrite_from_results(base, results, F.col("run_id"), key)
    if policy != "model":
        raise ValueError(f"unknown policy {policy!r}")
    new = results.select(key, *[F.col(c).alias(f"_new_{c}") for c in FIELDS])
    joined = base.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in FIELDS}).drop(
        *[f"_new_{c}" for c in FIELDS]
    )


def enriched_view(base: DataFrame, store_path: str, policy: str = "model", key: str = "review_uid") -> DataFrame:
    return merged(base, latest_results(read_store(base, store_path, key), key), policy, key)


def prepared(raw: DataFrame) -> DataFrame:
    """Keyword labels, season, column order: everything before the model, as one lazy plan."""
    return layout(with_season(fill_labels(raw)))


def enrich_reviews(
    spark: SparkSession, raw: DataFrame, root: str, out_path: str, run_id: int,
    factory: Callable[[], Annotate] = rule_annotator, limit_batches: int | None = None,
    stage_out: str | None = None, policy: str = "model", partitions: int | None = None, in_flight: int = 1,
    most_attempts: int | None = None, laid_out: bool = False,
) -> DataFrame:
    """The whole job: raw reviews to a versioned enriched table, ``laid_out`` for filters on request.

    ``root`` holds the result store and survives between runs.  ``stage_out`` keeps the table before
    the model; without it that stage is only a plan.
    """
    base = prepared(raw)
    if stage_out:
        write_stage(base, stage_out)
        base = spark.read.parquet(stage_out)
    store_path = f"{root.rstrip('/')}/results"
    run_enrichment(
        base, store_path, run_id, factory, limit_batches=limit_batches, partitions=partitions, in_flight=in_flight, most_attempts=most_attempts)
    out = layout(enriched_view(base, store_path, policy))
    if laid_out:
        write_enriched(out, out_path)
        return read_laid_out(spark, out_path)
    write_stage(out, out_path)
    return spark.read.parquet(out_path)
