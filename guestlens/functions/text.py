"""Display texts, keyword flags and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from guestlens import fixed_values as fixed
from guestlens.functions.themes import contains_any


def park_name(branch: Column) -> Column:
    """Short park name: without the common prefix and with blanks for underscores."""
    return F.replace(F.replace(branch, F.lit("Disneyland_"), F.lit("")), F.lit("_"), F.lit(" "))


def spaced(branch: Column) -> Column:
    return F.replace(branch, F.lit("_"), F.lit(" "))


def snippet(text: Column, length: int, always: bool = False) -> Column:
    """The first ``length`` characters and three dots; short texts stay whole unless ``always``."""
    cut = F.concat(F.substring(text, 1, length), F.lit("..."))
    return cut if always else F.when(F.length(text) > length, cut).otherwise(text)


def lookup(key: Column, table: Mapping[str, str], default: str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, value in table.items():
        out = out.when(key == name, F.lit(value))
    return out.otherwise(F.lit(default))


def action_for(theme: Column, table: Mapping[str, str] = fixed.ACTIONS, default: str = fixed.DEFAULT_ACTION) -> Column:
    return lookup(theme, table, default)


def finding_action_for(theme: Column) -> Column:
    return lookup(theme, fixed.FINDING_ACTIONS, fixed.DEFAULT_FINDING_ACTION)


def issue_text(theme: Column) -> Column:
    return F.concat(F.lit("High "), theme, F.lit(" friction"))


def evidence_text(pct_negative: Column) -> Column:
    return F.concat(pct_negative.cast("string"), F.lit("% negative"))


def round_one(number: Column) -> Column:
    """One digit behind the point: ten times the number, to the nearest whole, ties to even."""
    return F.rint(number * 10) / 10


def one_decimal(number: Column) -> Column:
    """Text of a non-negative number with one digit behind the point, rounded from its exact value.

    8x + 2x splits 10x into a double and the part lost in adding, so that 0.35 (a little less than
    its text) goes down and only true ties go to the even digit.
    """
    tenths = number * 8 + number * 2
    lost = number * 2 - (tenths - number * 8)
    whole = F.floor(tenths)
    rest = tenths - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
    digits = whole + up.cast("bigint")
    return F.concat(
        F.floor(digits / 10).cast("bigint").cast("string"), F.lit("."), (digits % 10).cast("string")
    )


def mentions(text: Column, words: Sequence[str]) -> Column:
    """Does the text contain one of the words, ignoring case?  Null text does not."""
    return F.coalesce(contains_any(F.lower(text), words), F.lit(False))


def quotable(text: Column, shortest: int = 40, longest: int = 300) -> Column:
    return F.coalesce(F.length(text).between(shortest, longest), F.lit(False))
