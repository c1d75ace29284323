"""Metrics of a table of tasks, their baselines, and metrics over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from guestlens.functions.calendar import month_start
from guestlens.operators.insights import weighted_mean, with_season
from guestlens.operators.matching import SpecMatcher, task_fields

TASK_COLUMNS = ("branch", "season", "month", "reviewer_location")


def keyed_specs(rows: DataFrame, columns: tuple[str, ...], key: str = "spec_key") -> DataFrame:
    """Rows with a key that equal specifications share."""
    return rows.withColumn(key, F.to_json(F.struct(*columns)))


def task_metrics(reviews: DataFrame, tasks: DataFrame, task: str = "task_id") -> DataFrame:
    """Review count, mean rating and mean score per task; tasks without a match have count 0.

    ``tasks`` holds ``branch``, ``season``, ``month`` and ``reviewer_location``, null for no restriction.
    """
    keyed = keyed_specs(tasks, TASK_COLUMNS)
    specs = keyed.select("spec_key", *TASK_COLUMNS).distinct()
    measured = SpecMatcher(with_season(reviews), specs, task_fields()).metrics()
    return (
        keyed.select(task, "spec_key").join(measured, "spec_key", "left")
        .withColumn("review_count", F.coalesce("review_count", F.lit(0)))
        .drop("spec_key")
    )


def overall_metrics(reviews: DataFrame) -> DataFrame:
    return reviews.agg(
        F.count(F.lit(1)).alias("review_count"),
        F.avg("Rating").alias("avg_rating"),
        F.avg("sentiment_score").alias("avg_sentiment"),
    )


def pct_difference(value: str, base: str):
    return F.try_divide(F.col(value) - F.col(base), F.col(base)) * 100


def against_baseline(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every metric with its difference in percent from the one-row ``baseline``."""
    names = ("review_count", "avg_rating", "avg_sentiment")
    based = metrics.withColumn("_base", baseline.select(F.struct(*names)).scalar())
    return based.withColumns({
        f"{n}_vs_baseline_pct": F.try_divide(F.col(n) - F.col(f"_base.{n}"), F.col(f"_base.{n}")) * 100
        for n in names
    }).drop("_base")


def period_over_period(reviews: DataFrame) -> DataFrame:
    """Metrics per park and month, and the change in percent from the park's month before in the data.

    Months are counted first; the window sees one row per park and month.
    """
    cells = (
        reviews.withColumn("month_start", month_start(F.col("Year_Month")))
        .filter(F.col("month_start").isNotNull() & F.col("Branch").isNotNull())
        .groupBy("Branch", "month_start", "Rating", "sentiment_score")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    monthly = cells.groupBy("Branch", "month_start").agg(
        F.sum("rows").alias("review_count"),
        weighted_mean("Rating", "rows").alias("avg_rating"),
        weighted_mean("sentiment_score", "rows").alias("avg_sentiment"),
    )
    before = Window.partitionBy("Branch").orderBy("month_start")
    names = ("review_count", "avg_rating", "avg_sentiment")
    lagged = monthly.withColumns({f"_last_{n}": F.lag(n).over(before) for n in names})
    return lagged.withColumns({f"{n}_change_pct": pct_difference(n, f"_last_{n}") for n in names}).drop(
        *[f"_last_{n}" for n in names]
    )
