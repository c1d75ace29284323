"""Themes of a review, from its topics and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from guestlens import fixed_values as fixed

ThemeWords = Sequence[tuple[str, Sequence[str]]]


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Does ``text`` contain one of ``words``?  Substrings count, case matters."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def _bits(rules: ThemeWords) -> dict[str, int]:
    return {theme: 2**i for i, (theme, _) in enumerate(rules)}


def _topic_bit(topic: Column, rules: ThemeWords) -> Column:
    """The bit of the first theme with a word in ``topic``, or 0."""
    out = F.when(F.lit(False), F.lit(0))
    for theme, words in rules:
        out = out.when(contains_any(topic, words), F.lit(_bits(rules)[theme]))
    return out.otherwise(F.lit(0))


def theme_mask(
    topics: Column, crowd_level: Column, price_sensitivity: Column, staff_sentiment: Column,
    rules: ThemeWords = fixed.THEME_WORDS,
) -> Column:
    """The set of themes of a review as a number, one bit per theme in rule order.

    A number groups, shuffles and hashes faster than an array of names.
    """
    bits = _bits(rules)
    of_topics = F.aggregate(
        topics, F.lit(0), lambda mask, t: mask.bitwiseOR(_topic_bit(F.lower(t), rules))
    )

    def bit(theme: str, applies: Column) -> Column:
        return F.when(applies, F.lit(bits[theme])).otherwise(F.lit(0))

    return (
        F.coalesce(of_topics, F.lit(0))
        .bitwiseOR(bit("Queue/Crowd", contains_any(F.lower(crowd_level), fixed.CROWDED_WORDS)))
        .bitwiseOR(bit("Price", contains_any(F.lower(price_sensitivity), fixed.COSTLY_WORDS)))
        .bitwiseOR(bit("Staff", ~F.lower(staff_sentiment).isin(fixed.NO_STAFF_LABELS)))
    )


def _named(mask: Column, rules: ThemeWords) -> Column:
    """One place per theme in alphabetical order: its name if the bit is set, else null."""
    return F.array(*[
        F.when(mask.bitwiseAND(bit) != 0, F.lit(theme)) for theme, bit in sorted(_bits(rules).items())
    ])


def review_mask() -> Column:
    return theme_mask(*[F.col(c) for c in ("topics", "crowd_level", "price_sensitivity", "staff_sentiment")])


def themes_of(mask: Column, rules: ThemeWords = fixed.THEME_WORDS) -> Column:
    """Sorted array of the themes in a mask; empty when there are none."""
    return F.array_compact(_named(mask, rules))


def with_themes(reviews: DataFrame, name: str = "themes") -> DataFrame:
    return reviews.withColumn("_mask", review_mask()).withColumn(name, themes_of(F.col("_mask"))).drop("_mask")


def explode_mask(rows: DataFrame, mask: str, name: str = "theme", rules: ThemeWords = fixed.THEME_WORDS) -> DataFrame:
    """One row per theme in the mask; rows without a theme fall out."""
    return rows.withColumn(name, F.explode(_named(F.col(mask), rules))).filter(F.col(name).isNotNull()).drop(mask)


def explode_themes(reviews: DataFrame, name: str = "theme") -> DataFrame:
    """One row per review and theme; reviews without a theme fall out."""
    return explode_mask(reviews.withColumn("_mask", review_mask()), "_mask", name)
