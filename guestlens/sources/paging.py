"""Pages of an ordered table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from guestlens.operators.ranking import bucket_of, key_bounds, positions

PAGE_SIZE = 100


def with_pages(df: DataFrame, key: str, size: int = PAGE_SIZE) -> DataFrame:
    """Every row with its page from 0 and the number of pages, in key order."""
    return (
        positions(df, key, position="_position", total="_rows")
        .withColumn("page", F.floor(F.col("_position") / size))
        .withColumn("pages", F.ceil(F.col("_rows") / size))
        .drop("_position", "_rows")
    )


def page(df: DataFrame, key: str, number: int, size: int = PAGE_SIZE, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """One page, reading only the key ranges that hold it.

    The counts of the ranges tell which ranges to keep; the rest is a filter on the key.
    """
    bounds = key_bounds(df, key, rows_per_bucket)
    first, skip = number * size, 0
    if bounds:
        counted = sorted(df.groupBy(bucket_of(df, key, bounds).alias("bucket")).count().collect())
        wanted, before = [], 0
        for row in counted:
            if before + row["count"] > first and before < first + size:
                if not wanted:
                    skip = before
                wanted.append(row["bucket"])
            before += row["count"]
        if not wanted:
            return df.limit(0)
        if wanted[0] > 0:
            df = df.filter(F.col(key) > bounds[wanted[0] - 1])
        if wanted[-1] < len(bounds):
            df = df.filter(F.col(key) <= bounds[wanted[-1]])
    return df.orderBy(key).offset(first - skip).limit(size)


def peek(df: DataFrame, rows: int = 5, key: str | None = None) -> DataFrame:
    """A few rows for a look at the data: the first by ``key``, else those that come fastest."""
    return (df.orderBy(key) if key else df).limit(rows)


def columns_of(df: DataFrame) -> DataFrame:
    """Column names and types of a frame, as rows."""
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, column_type string")
