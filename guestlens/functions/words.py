"""Words checked against character rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from guestlens.fixed_values import WORD_RULES

Rules = Sequence[tuple[str, Sequence[str], bool]]

BLANKS = "[ \\t\\n\\r]+"


def _one_of(chars: Sequence[str], negate: bool = False) -> str:
    return "[" + ("^" if negate else "") + "".join(re.escape(c) for c in chars) + "]"


def fault_pattern(rules: Rules = WORD_RULES) -> str:
    """A pattern that finds the first fault of a word.

    A fault is a character without a rule, a pair that is not allowed, or an end on a character that
    may not end a word.  Looking for a fault needs no repetition, so word length does not matter.
    """
    faults = [_one_of([c for c, _, _ in rules], negate=True)]
    for char, followers, _ in rules:
        faults.append(re.escape(char) + (_one_of(followers, negate=True) if followers else "."))
    open_ended = [c for c, _, final in rules if not final]
    if open_ended:
        faults.append(_one_of(open_ended) + "\\z")
    return "|".join(faults)


def is_valid_word(word: Column, rules: Rules = WORD_RULES) -> Column:
    return F.coalesce((F.length(word) > 0) & ~word.rlike("(?s)" + fault_pattern(rules)), F.lit(False))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: F.length(w) > 0)


def valid_words(text: Column, rules: Rules = WORD_RULES) -> Column:
    """The words of a text that keep the rules, in order."""
    return F.filter(words_of(F.lower(text)), lambda w: is_valid_word(w, rules))
