"""Exact duplicates by a content sort, in DataFrame operations.

Normalised bytes are dealt to tasks in ranges between sampled splitters and sorted there, on disk where memory is short, so
that equal texts lie next to each other; texts with the same first ``HEAD`` bytes go by their hash and then by all bytes.  A run of equal neighbours, compared byte by byte, is a group: its rows are numbered
from the identifier that stays, and counted.

A text that holds a large share of all rows would be one run in one task.  A sample names such texts; their rows are
dealt over slices that are sorted apart, and the few slices of a text are put together again by one more comparison of
whole texts.  The sample only balances the work: groups are the same with any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from guestlens.llm.common import stored

#: Splitters are told by so many first bytes of a text and then by its hash, as the driver gets a sample of them.
HEAD = 64
#: A text with a larger share of the rows than one in so many is sorted in slices of about that share.
SLICES = 4096
#: Rows of the sample, and how often a text must be in it for its share to be told.
SAMPLE_ROWS = 1 << 19
LEAST_HITS = 32


def frequent_texts(rows: DataFrame, body: str, slices: int, sample_rows: int, least_hits: int) -> DataFrame:
    """(code, slices): hashes of texts with a share of more than 1 in ``slices``; at most ``slices`` rows."""
    total = rows.count()
    drawn = rows.select(F.xxhash64(body).alias("code")).sample(min(1.0, sample_rows / max(total, 1)), seed=13)
    counted = stored(drawn.groupBy("code").agg(F.count("*").alias("n")), "sampled-texts")
    every = counted.agg(F.sum("n")).first()[0] or 0
    frequent = counted.where((F.col("n") >= least_hits) & (F.col("n") * slices > every))
    return frequent.select("code", F.ceil(F.col("n") * slices / max(every, 1)).alias("slices"))


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = lambda c: c,
    largest_stays: bool = False, slices: int = SLICES, sample_rows: int = SAMPLE_ROWS, least_hits: int = LEAST_HITS,
) -> DataFrame:
    """Every row's key, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Rows are equal when the bytes of their normalised texts are; a null text counts as empty.  Of equal rows the one with
    the smallest key stays, or the largest on request; a null key stays only where all are null, and ``keep_id`` is null
    then.  Of rows that repeat the key that stays one is kept, so each group keeps exactly one row.  ``text_sha256`` is
    of the normalised text.  An empty table gives an empty result; other columns are not read, whatever their names.
    """
    kind = docs.schema[key].dataType
    body = F.coalesce(normalise(F.col(text)), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), body.alias("body"))
    frequent = F.broadcast(frequent_texts(rows, "body", slices, sample_rows, least_hits))
    dealt = rows.withColumn("code", F.xxhash64("body")).join(frequent, "code", "left")
    # Repeated rows of one key come from many partitions, so their own partition helps to deal them out.
    slice_ = F.when(F.col("slices").isNotNull(), F.pmod(F.xxhash64("key", F.spark_partition_id()), F.col("slices")))
    dealt = dealt.select("key", "body", F.substring("body", 1, HEAD).alias("head"), "code", slice_.cast("int").alias("slice"))
    sorted_rows = dealt.repartitionByRange("head", "code", "slice")

    run = W.partitionBy("head", "code", "slice", "body").orderBy(F.desc_nulls_last("key") if largest_stays else F.asc_nulls_last("key"))
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    placed = sorted_rows.withColumn("id", F.monotonically_increasing_id()).select(
        "key", "body", F.col("slice").isNotNull().alias("sliced"), F.row_number().over(run).alias("place"),
        F.first("key").over(whole).alias("keep"), F.count("*").over(whole).alias("n"), F.min("id").over(whole).alias("run"),
    )
    first, sliced = F.col("place") == 1, F.col("sliced")
    runs = stored(
        placed.select("key", "sliced", "place", "keep", "n", "run", F.sha2("body", 256).alias("sha"), F.when(first & sliced, F.col("body")).alias("body")),
        "sorted-runs",
    )
    # Slices of one text; there are at most 2 * ``slices`` of all texts.  The other rows are final.
    if largest_stays:
        best = F.max_by(F.struct("keep", "run"), F.struct(F.col("keep").isNotNull(), "keep", "run"))
    else:
        best = F.min_by(F.struct("keep", "run"), F.struct(F.col("keep").isNull(), "keep", "run"))
    texts = runs.where(F.col("body").isNotNull()).groupBy("body").agg(best.alias("best"), F.sum("n").alias("total"), F.collect_list("run").alias("runs"))
    parts = texts.select(F.explode("runs").alias("run"), F.col("best.keep").alias("text_keep"), F.col("best.run").alias("text_run"), "total")
    joined = runs.drop("body").join(F.broadcast(parts), "run", "left")
    stays = first & (~sliced | (F.col("run") == F.col("text_run")))
    return joined.select(
        F.col("key").alias(key),
        F.when(sliced, F.col("text_keep")).otherwise(F.col("keep")).cast(kind).alias("keep_id"),
        F.when(sliced, F.col("total")).otherwise(F.col("n")).cast("long").alias("group_size"),
        stays.alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
