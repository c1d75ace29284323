"""Two versions of a label compared, and keywords compared with labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from guestlens.functions.lexicon import LEXICON, Lexicon, fill_labels, lexicon_fields
from guestlens.functions.text import mentions


def side_by_side(
    first: DataFrame, second: DataFrame, label: str, key: str = "review_uid",
    suffixes: tuple[str, str] = ("_a", "_b"), keep: Sequence[str] = (),
) -> DataFrame:
    """Rows whose key is in both versions, with both labels."""
    a, b = (label + s for s in suffixes)
    left = first.select(key, *keep, F.col(label).alias(a))
    return left.join(second.select(key, F.col(label).alias(b)), key)


def extraction_rate(paired: DataFrame, a: str, b: str) -> DataFrame:
    """Percent of shared rows with a label, per version."""
    rate = lambda c: (F.avg(F.col(c).isNotNull().cast("int")) * 100)
    return paired.agg(F.count(F.lit(1)).alias("shared"), rate(a).alias("rate_a"), rate(b).alias("rate_b"))


def change_kind(a: str, b: str) -> Column:
    """``new``, ``lost``, ``differs`` or null when the versions agree."""
    first, second = F.col(a), F.col(b)
    return (
        F.when(first.isNull() & second.isNotNull(), F.lit("new"))
        .when(first.isNotNull() & second.isNull(), F.lit("lost"))
        .when(first != second, F.lit("differs"))
    )


def changed_rows(paired: DataFrame, a: str, b: str) -> DataFrame:
    return paired.withColumn("change", change_kind(a, b)).filter(F.col("change").isNotNull())


def change_counts(paired: DataFrame, a: str, b: str) -> DataFrame:
    kind = change_kind(a, b)
    return paired.agg(
        F.count_if(kind == "new").alias("new_finds"),
        F.count_if(kind == "lost").alias("lost_finds"),
        F.count_if(kind == "differs").alias("disagreements"),
    )


def confusion(paired: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per pair of labels; a missing label shows as ``None``."""
    shown = [F.coalesce(F.col(c), F.lit("None")).alias(c) for c in (a, b)]
    return paired.groupBy(*shown).agg(F.count(F.lit(1)).alias("reviews"))


def confusion_matrix(paired: DataFrame, a: str, b: str, labels: Sequence[str]) -> DataFrame:
    """The confusion counts with the second version's labels as columns, zero where there are none."""
    wide = confusion(paired, a, b).groupBy(a).pivot(b, list(labels)).agg(F.sum("reviews"))
    return wide.fillna(0)


def miss_rate(reviews: DataFrame, label: str, words: Sequence[str], *group: str) -> DataFrame:
    """Of the reviews that mention a word: how many, how many without a label, and the percentage."""
    said = mentions(F.col("Review_Text"), words)
    counted = reviews.groupBy(*group).agg(
        F.count_if(said).alias("mentioned"),
        F.count_if(said & F.col(label).isNull()).alias("missed"),
    )
    rate = F.coalesce(F.try_divide(F.col("missed"), F.col("mentioned")) * 100, F.lit(0.0))
    return counted.withColumn("miss_rate", rate)


def backfill_stats(reviews: DataFrame, lexicon: Lexicon = LEXICON) -> DataFrame:
    """New values per field through keywords: one pass over the reviews, one row per field."""
    fields = lexicon_fields(lexicon)
    before = reviews.withColumns({f"_before_{f}": F.col(f) for f in fields if f in reviews.columns})
    filled = fill_labels(before, lexicon)
    gains = [
        F.struct(
            F.lit(f).alias("field"),
            (F.count(f) - (F.count(f"_before_{f}") if f in reviews.columns else F.lit(0))).alias("filled"),
        )
        for f in fields
    ]
    return filled.agg(F.array(*gains).alias("gains")).select(F.inline("gains"))
