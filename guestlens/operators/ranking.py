"""Order, position and top-k without a window over the whole table or over one hot group."""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Ranges of a table that has rows for them, sampled keys per range, and ranges up to which the sample is collected.
LEAST_BUCKETS = 8
SAMPLED = 20
COLLECTED = 1_000


def first_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, spread: Column,
    salts: int = 32, rank: str = "rank",
) -> DataFrame:
    """The first ``k`` rows of every group in ``order``, with their rank from 1.

    Rows are ranked first within (group, salt), then the at most ``salts * k`` survivors within the
    group.  Spark also cuts to ``k`` before each shuffle, so a group with a third of all rows costs
    no task more than its share.  ``order`` must be total; ``spread`` is hashed into the salt.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    part = Window.partitionBy(*group, "_salt").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn(rank, F.row_number().over(part))
        .filter(F.col(rank) <= k)
        .withColumn(rank, F.row_number().over(whole))
        .filter(F.col(rank) <= k)
        .drop("_salt")
    )


def key_bounds(df: DataFrame, key: str, rows_per_bucket: int) -> list:
    """Keys that split the unique ``key``, of any type, into ranges of about ``rows_per_bucket`` rows.

    The keys come from a sample by hash, so a repeated run gets the same, and are real keys, so common prefixes do no
    harm.  Of a sample too large for the driver only every ``SAMPLED``-th key in order reaches it, by the positions of the
    sample itself: one bound for each range.  Bounds only balance the work: positions are exact for any.
    """
    keys = df.select(key)
    rows = keys.count()
    buckets = max(-(-rows // rows_per_bucket), min(LEAST_BUCKETS, COLLECTED, rows))
    if buckets < 2:
        return []
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    sample = keys.filter(draw < min(1 << 40, -(-(SAMPLED * buckets << 40) // rows)))
    if buckets > COLLECTED:
        numbered = positions(sample, key, max(rows_per_bucket, -(-SAMPLED * buckets // COLLECTED)), "_position", "_total")
        every = F.greatest(F.lit(1), F.floor(F.col("_total") / buckets))
        return sorted(r[0] for r in numbered.filter(F.col("_position") % every == every - 1).select(key).collect())
    drawn = sorted(r[0] for r in sample.collect())
    return sorted({drawn[len(drawn) * i // buckets - 1] for i in range(1, buckets) if len(drawn) * i // buckets})


def bucket_of(df: DataFrame, key: str, bounds: Sequence) -> Column:
    """Number of bounds below the key, by halving steps over the list, which is one literal."""
    text = json.dumps([None if b is None else str(b) for b in bounds])
    points = F.from_json(F.lit(text), T.ArrayType(T.StringType())).cast(T.ArrayType(df.schema[key].dataType))
    steps = F.array(*[F.lit(2**i) for i in reversed(range(max(1, len(bounds).bit_length())))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when(F.get(points, low + step - 1) < F.col(key), low + step).otherwise(low),
    )


def _running_offsets(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*group)
    return counts.select(
        *group,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(every).alias("_total"),
    )


def positions(
    df: DataFrame, key: str, rows_per_bucket: int = 1_000_000,
    position: str = "position", total: str = "total",
) -> DataFrame:
    """The position of every row from 0 in the order of the unique ``key``, and the number of rows.

    Rows are ranked within key ranges; the ranges before them add their row counts.  The driver gets one key and one count
    for each range, that is for about ``rows_per_bucket`` rows.
    """
    placed = df.withColumn("_bucket", bucket_of(df, key, key_bounds(df, key, rows_per_bucket)))
    counts = sorted(tuple(r) for r in placed.groupBy("_bucket").count().collect())
    before = [0, *accumulate(n for _, n in counts)]
    offsets = df.sparkSession.createDataFrame(
        [(bucket, start, before[-1]) for (bucket, _), start in zip(counts, before)], "_bucket int, _offset bigint, _total bigint")
    in_bucket = Window.partitionBy("_bucket").orderBy(key)
    return (
        placed.join(offsets, "_bucket")
        .withColumn(position, F.row_number().over(in_bucket) - 1 + F.col("_offset"))
        .withColumnRenamed("_total", total)
        .drop("_bucket", "_offset")
    )


def group_positions(
    df: DataFrame, group: Sequence[str], ordinal: str, span: int, position: str = "position",
) -> DataFrame:
    """The position from 0 of every row in its group, in the order of the unique whole number ``ordinal``.

    Rows are ranked within stretches of ``span`` ordinals, so that no task holds a whole hot group.
    Only groups longer than one stretch take part in the join with the counts of earlier stretches.
    """
    placed = df.withColumn("_bucket", F.floor(F.col(ordinal) / span))
    counts = placed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    later = _running_offsets(counts, group).filter("_offset > 0").drop("_total")
    in_bucket = Window.partitionBy(*group, "_bucket").orderBy(ordinal)
    return (
        placed.join(later, [*group, "_bucket"], "left")
        .withColumn(position, F.row_number().over(in_bucket) - 1 + F.coalesce("_offset", F.lit(0)))
        .drop("_bucket", "_offset")
    )


def even_batches(df: DataFrame, key: str, batch_size: int, batch: str = "batch_id") -> DataFrame:
    """Split into ``max(1, rows // batch_size)`` batches in key order; earlier batches are one longer."""
    batches = F.greatest(F.lit(1), F.floor(F.col("_rows") / batch_size))
    short = F.floor(F.col("_rows") / batches)
    longer = F.col("_rows") % batches
    in_longer = F.col("_position") < longer * (short + 1)
    number = F.when(in_longer, F.floor(F.col("_position") / (short + 1))).otherwise(
        longer + F.floor((F.col("_position") - longer * (short + 1)) / F.greatest(short, F.lit(1)))
    )
    return (
        positions(df, key, position="_position", total="_rows")
        .withColumn(batch, number.cast("bigint"))
        .drop("_position", "_rows")
    )


def hashed_batches(df: DataFrame, key: str, batches: int, batch: str = "batch_id") -> DataFrame:
    """Split into ``batches`` parts of about equal size by a hash of the key: no shuffle, no sort."""
    return df.withColumn(batch, F.pmod(F.xxhash64(key), F.lit(batches)))


def chunks(df: DataFrame, key: str, size: int, chunk: str = "chunk_id") -> DataFrame:
    """Number consecutive chunks of ``size`` rows in key order."""
    return (
        positions(df, key, position="_position", total="_rows")
        .withColumn(chunk, F.floor(F.col("_position") / size))
        .drop("_position", "_rows")
    )


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def repeatable_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows picked by a hash of the key and the seed; all rows when there are no more."""
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return df.orderBy(draw, key).limit(n)
