"""Explicit schemas and the helpers that make a frame fit them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from guestlens import fixed_values as fixed

RAW_REVIEW = T.StructType([
    T.StructField("Review_ID", T.StringType()),
    T.StructField("Rating", T.IntegerType()),
    T.StructField("Year_Month", T.StringType()),
    T.StructField("Reviewer_Location", T.StringType()),
    T.StructField("Review_Text", T.StringType()),
    T.StructField("Branch", T.StringType()),
])

ENRICHMENT = T.StructType([
    T.StructField("sentiment_score", T.IntegerType()),
    T.StructField("sentiment_label", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("is_complaint", T.BooleanType()),
    T.StructField("crowd_level", T.StringType()),
    T.StructField("staff_sentiment", T.StringType()),
    T.StructField("price_sensitivity", T.StringType()),
    T.StructField("family_sentiment", T.StringType()),
])

# The larger record of the first model runs; the summary is wanted back.
ENRICHMENT_WITH_SUMMARY = T.StructType(
    ENRICHMENT.fields
    + [
        T.StructField("queue_time_rating", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("entities", T.ArrayType(T.StringType())),
    ]
)

FILTER_SPEC = T.StructType([
    T.StructField("intent", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("sentiment_label", T.StringType()),
    T.StructField("is_complaint", T.BooleanType()),
    T.StructField("crowd_level", T.StringType()),
    T.StructField("staff_sentiment", T.StringType()),
    T.StructField("price_sensitivity", T.StringType()),
    T.StructField("family_sentiment", T.StringType()),
    T.StructField("reviewer_location", T.StringType()),
    T.StructField("branch", T.StringType()),
    T.StructField("year_month", T.StringType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("season", T.StringType()),
    T.StructField("unsupported_entity", T.StringType()),
    T.StructField("reasoning", T.StringType()),
])


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that are missing, as nulls of the right type."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def layout(
    df: DataFrame,
    first: Sequence[str] = tuple(fixed.FIRST_COLUMNS),
    last: Sequence[str] = tuple(fixed.LAST_COLUMNS),
) -> DataFrame:
    """Put the columns named in ``first`` in front and those in ``last`` behind; others stay between."""
    placed = {*first, *last}
    middle = [c for c in df.columns if c not in placed]
    return df.select([c for c in [*first, *middle, *last] if c in df.columns])
