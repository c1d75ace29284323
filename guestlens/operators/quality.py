"""Checks of answers and of question routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SHORTEST_ANSWER = 20
# The emoticon block of Unicode without its first character.
EMOTICON = "[\\x{1F601}-\\x{1F64F}]"


def _any_in(answer: Column, words: Column) -> Column:
    low = F.lower(answer)
    return F.exists(words, lambda w: low.contains(F.lower(w)))


def check_answers(
    answers: DataFrame, answer: str = "answer", expected: str = "expected", forbidden: str = "forbidden",
) -> DataFrame:
    """Single checks and the verdict: no forbidden word, an expected word if any are given,
    long enough, no emoticon."""
    text = F.coalesce(F.col(answer), F.lit(""))
    checks = {
        "no_forbidden": ~F.coalesce(_any_in(text, F.col(forbidden)), F.lit(False)),
        "has_expected": (F.coalesce(F.size(expected), F.lit(0)) < 1) | _any_in(text, F.col(expected)),
        "long_enough": F.length(text) >= SHORTEST_ANSWER,
        "no_emoticon": ~text.rlike(EMOTICON),
    }
    passed = F.col("no_forbidden") & F.col("has_expected") & F.col("long_enough") & F.col("no_emoticon")
    return answers.withColumns(checks).withColumn("passed", passed)


def suite_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))


def router_accuracy(golden: DataFrame, predicted: DataFrame, fields: Sequence[str], key: str = "qid") -> DataFrame:
    """Share of golden questions whose predicted value is the same, per field.

    Nulls equal nulls; a question without a prediction counts as wrong in every field.
    """
    guess = predicted.select(key, F.lit(True).alias("_found"), *[F.col(f).alias(f"_guess_{f}") for f in fields])
    joined = golden.join(guess, key, "left")
    rates = [
        F.struct(
            F.lit(f).alias("field"),
            F.avg((F.coalesce("_found", F.lit(False)) & F.col(f).eqNullSafe(F.col(f"_guess_{f}"))).cast("int"))
            .alias("match_rate"),
        )
        for f in fields
    ]
    return joined.agg(F.array(*rates).alias("rates")).select(F.inline("rates"))
