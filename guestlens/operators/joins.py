"""Joins of the resumable enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from guestlens.schema import ENRICHMENT

ENRICHED = tuple(ENRICHMENT.fieldNames())


def not_yet_done(base: DataFrame, done: DataFrame, key: str = "review_uid") -> DataFrame:
    """Rows of ``base`` whose key is not in ``done``."""
    return base.join(done.select(key), key, "left_anti")


def with_keys(base: DataFrame, keys: DataFrame, key: str = "review_uid") -> DataFrame:
    """Rows of ``base`` whose key is in ``keys``."""
    return base.join(keys.select(key), key, "left_semi")


def last_per_key(df: DataFrame, key: str, order: Column, columns: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key.  Copies of a key merge before the shuffle."""
    record = F.max_by(F.struct(*columns), order).alias("_row")
    return df.groupBy(key).agg(record).select(key, "_row.*")


def fill_from_checkpoint(
    base: DataFrame, checkpoint: DataFrame, order: Column, key: str = "review_uid", columns: Sequence[str] = ENRICHED,
) -> DataFrame:
    """Fill nulls of ``base`` from scored checkpoint rows; a value of ``base`` stays.

    ``order`` tells which of several checkpoint rows of a key is the last one.
    """
    scored = checkpoint.filter(F.col("sentiment_score").isNotNull())
    last = last_per_key(scored, key, order, columns)
    saved = last.select(key, *[F.col(c).alias(f"_saved_{c}") for c in columns])
    joined = base.join(saved, key, "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_saved_{c}")) for c in columns}
    return joined.withColumns(filled).drop(*[f"_saved_{c}" for c in columns])


def overwrite_from_results(
    base: DataFrame, results: DataFrame, order: Column, key: str = "review_uid", columns: Sequence[str] = ENRICHED,
) -> DataFrame:
    """Take all enrichment columns from ``results`` for its keys, nulls too; of several rows the last in ``order``."""
    last = last_per_key(results, key, order, columns)
    new = last.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(new, key, "left")
    taken = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(taken).drop("_hit", *[f"_new_{c}" for c in columns])
