"""Column profiles and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from guestlens.operators.ranking import first_k_per_group

CHECKED = ("staff_sentiment", "price_sensitivity", "crowd_level", "topics", "sentiment_score")


def _as_text(df: DataFrame, name: str) -> Column:
    if df.schema[name].dataType.typeName() == "array":
        return F.when(F.col(name).isNotNull(), F.concat(F.lit("["), F.concat_ws(", ", name), F.lit("]")))
    return F.col(name).cast("string")


def filled_counts(df: DataFrame, columns: Sequence[str] = CHECKED) -> DataFrame:
    """Type and number of non-null values per column."""
    kinds = dict(df.dtypes)
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("column_type"), F.count(c).alias("filled"))
        for c in columns if c in df.columns
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def top_values(df: DataFrame, columns: Sequence[str] = CHECKED, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column, ties by value.  All columns in one pass."""
    present = [c for c in columns if c in df.columns]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _as_text(df, c).alias("value")) for c in present
    ]))
    counted = (
        df.select(pairs.alias("pair")).select("pair.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("reviews"))
    )
    return first_k_per_group(counted, ["column_name"], [F.desc("reviews"), F.col("value")], k, F.col("value"))


def progress(base: DataFrame, score: str = "sentiment_score") -> DataFrame:
    """Rows in all, rows with a score, rows still to do."""
    return base.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(score).alias("enriched"),
        F.count_if(F.col(score).isNull()).alias("remaining"),
    )
