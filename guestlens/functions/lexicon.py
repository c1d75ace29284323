"""Keyword labels: a lexicon of (field, label, pattern) rows folded into one expression per field."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from guestlens.fixed_values import LEXICON
from guestlens.functions.themes import contains_any

Lexicon = Sequence[tuple[str, str, str]]


def lexicon_fields(lexicon: Lexicon = LEXICON) -> list[str]:
    return list(dict.fromkeys(field for field, _, _ in lexicon))


def label_patterns(field: str, lexicon: Lexicon = LEXICON) -> list[tuple[str, str]]:
    """(label, one pattern for all its keywords) in lexicon order."""
    labels: dict[str, list[str]] = {}
    for of_field, label, pattern in lexicon:
        if of_field == field:
            labels.setdefault(label, []).append(pattern)
    return [(label, "|".join(f"(?:{p})" for p in patterns)) for label, patterns in labels.items()]


def plain_words(field: str, label: str, lexicon: Lexicon = LEXICON) -> list[str] | None:
    """The keywords of a label if all its patterns are plain words between word boundaries."""
    patterns = [p for f, n, p in lexicon if (f, n) == (field, label)]
    found = [re.fullmatch(r"\\b([\w ]+)\\b", p) for p in patterns]
    return [m.group(1) for m in found] if all(found) else None


def has_label(label: Column) -> Column:
    """Is there a label?  The text ``None`` stands for a missing one."""
    return label.isNotNull() & (label != "None")


def keyword_label(current: Column, low_text: Column, field: str, lexicon: Lexicon = LEXICON) -> Column:
    """The present label, else the first label with a keyword in the lower-case text, else null.

    A plain search for the words comes first: it is many times faster than the pattern, which then
    runs only on the few texts that can match.
    """
    out = F.when(has_label(current), current)
    for label, pattern in label_patterns(field, lexicon):
        words = plain_words(field, label, lexicon)
        hit = low_text.rlike(pattern)
        out = out.when(contains_any(low_text, words) & hit if words else hit, F.lit(label))
    return out


def fill_labels(reviews: DataFrame, lexicon: Lexicon = LEXICON, text: str = "Review_Text") -> DataFrame:
    """Fill every field of the lexicon from keywords; fields that are missing are added."""
    lowered = reviews.withColumn("_low", F.lower(text))
    filled = {}
    for field in lexicon_fields(lexicon):
        current = F.col(field) if field in reviews.columns else F.lit(None).cast("string")
        filled[field] = keyword_label(current, F.col("_low"), field, lexicon)
    return lowered.withColumns(filled).drop("_low")
