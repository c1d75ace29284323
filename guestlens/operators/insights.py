"""Insight tables.

Reviews are first counted into cells: one row per combination of the few columns that an insight
needs, with the number of reviews.  A cell count is a hash aggregate with partial sums before the
shuffle, so hot groups cost nothing; medians, quartiles, means and theme explosions then run on the
cells.  Scores have five values, so the exact median comes from at most five counts per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from guestlens import fixed_values as fixed
from guestlens.functions.calendar import month_start, season
from guestlens.functions.lexicon import has_label
from guestlens.functions.text import one_decimal, round_one
from guestlens.functions.themes import explode_mask, review_mask
from guestlens.operators.filters import branch_contains, gate, low_rating

CELL = ["Branch", "Season", "theme"]


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of ``value`` over ``weight`` copies of each row; null values do not count."""
    counted = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return F.try_divide(F.sum(F.col(value) * F.col(weight)).cast("double"), counted)


def weighted_rate(flag: str, weight: str) -> Column:
    """Share of true among the non-null flags."""
    counted = F.sum(F.when(F.col(flag).isNotNull(), F.col(weight)))
    return F.try_divide(F.sum(F.col(flag).cast("int") * F.col(weight)).cast("double"), counted)


def weighted_median(value: str, weight: str) -> Column:
    """Median that interpolates, over ``weight`` copies of each row; null values do not count."""
    return F.percentile(F.col(value), 0.5, F.col(weight))


def with_season(reviews: DataFrame) -> DataFrame:
    if "Season" in reviews.columns:
        return reviews
    return reviews.withColumn("Season", season(F.col("Branch"), F.col("Year_Month")))


def theme_cells(reviews: DataFrame) -> DataFrame:
    """Counts by (Branch, Season, theme, score, label): the base of heatmaps and playbook.

    Reviews are counted by their set of themes first and exploded afterwards, so the explosion
    works on cells.  ``rows`` counts reviews, ``n`` those with a key.
    """
    counted = (
        with_season(reviews).withColumn("_mask", review_mask())
        .groupBy("Branch", "Season", "_mask", "sentiment_score", "sentiment_label")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("review_uid").alias("n"))
    )
    return explode_mask(counted, "_mask")


def grouped_cells(cells: DataFrame) -> DataFrame:
    """Cells with a park and a season: groups with a missing key do not appear in the tables."""
    return cells.filter(F.col("Branch").isNotNull() & F.col("Season").isNotNull())


def heatmap_from_cells(cells: DataFrame, least: int = 30) -> DataFrame:
    volume = F.col("volume")
    return (
        grouped_cells(cells)
        .groupBy(*CELL)
        .agg(
            weighted_median("sentiment_score", "rows").alias("median_sentiment"),
            F.sum("n").alias("volume"),
        )
        .withColumn("median_sentiment", gate(F.col("median_sentiment"), volume, least))
    )


def theme_season_heatmap(reviews: DataFrame, least: int = 30) -> DataFrame:
    """Median score and volume per park, season and theme; medians of thin cells are null."""
    return heatmap_from_cells(theme_cells(reviews), least)


def extended_metrics(reviews: DataFrame, least: int = 30) -> DataFrame:
    """The heatmap with mean, negative count and share of negatives; thin cells keep the counts only."""
    cells = grouped_cells(theme_cells(reviews)).groupBy(*CELL).agg(
        weighted_mean("sentiment_score", "rows").alias("mean_sentiment"),
        weighted_median("sentiment_score", "rows").alias("median_sentiment"),
        F.sum("n").alias("volume"),
        negative_count().alias("neg_count"),
    )
    share = F.try_divide(F.col("neg_count").cast("double"), F.col("volume"))
    volume = F.col("volume")
    return cells.withColumns({
        "share_negative": gate(share, volume, least),
        "mean_sentiment": gate(F.col("mean_sentiment"), volume, least),
        "median_sentiment": gate(F.col("median_sentiment"), volume, least),
    })


def negative_count() -> Column:
    return F.sum(F.when(F.col("sentiment_label") == "Negative", F.col("rows")).otherwise(F.lit(0)))


def season_pivot(heatmap: DataFrame, value: str) -> DataFrame:
    """Seasons as columns in fixed order; absent seasons are null."""
    return heatmap.groupBy("Branch", "theme").pivot("Season", fixed.SEASON_ORDER).agg(F.first(value))


def low_rating_drivers(reviews: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent themes of reviews rated 1 or 2."""
    low = reviews.filter(low_rating()).withColumn("_mask", review_mask())
    counted = low.groupBy("_mask").agg(F.count(F.lit(1)).alias("rows"))
    return (
        explode_mask(counted, "_mask")
        .groupBy("theme")
        .agg(F.sum("rows").alias("reviews"))
        .orderBy(F.desc("reviews"), "theme")
        .limit(top)
    )


def score_cells(reviews: DataFrame, *keys: str) -> DataFrame:
    """Counts by ``keys``, score and complaint flag."""
    return reviews.groupBy(*keys, "sentiment_score", "is_complaint").agg(F.count(F.lit(1)).alias("rows"))


def monthly_seasonality(reviews: DataFrame) -> DataFrame:
    """Mean score and complaint rate per month in date order."""
    dated = reviews.withColumn("month_start", month_start(F.col("Year_Month")))
    return (
        score_cells(dated.filter(F.col("month_start").isNotNull()), "month_start")
        .groupBy("month_start")
        .agg(
            weighted_mean("sentiment_score", "rows").alias("sentiment"),
            weighted_rate("is_complaint", "rows").alias("complaint_rate"),
        )
        .orderBy("month_start")
    )


def top_locations(reviews: DataFrame, top: int = 10) -> DataFrame:
    """The locations with most reviews, ties by name."""
    return (
        reviews.filter(F.col("Reviewer_Location").isNotNull())
        .groupBy("Reviewer_Location")
        .agg(F.count(F.lit(1)).alias("reviews"))
        .orderBy(F.desc("reviews"), "Reviewer_Location")
        .limit(top)
    )


def from_top_locations(reviews: DataFrame, top: int = 10) -> DataFrame:
    """Reviews from the top locations.  Spark broadcasts a list of ``top`` rows if that is small."""
    wanted = top_locations(reviews, top).select("Reviewer_Location")
    return reviews.join(wanted, "Reviewer_Location", "left_semi")


def country_sentiment(reviews: DataFrame, top: int = 10) -> DataFrame:
    """Mean score of the top locations, lowest first.  Volume and mean come from one aggregate."""
    return (
        reviews.filter(F.col("Reviewer_Location").isNotNull())
        .groupBy("Reviewer_Location")
        .agg(F.count(F.lit(1)).alias("reviews"), F.avg("sentiment_score").alias("avg_sentiment"))
        .orderBy(F.desc("reviews"), "Reviewer_Location")
        .limit(top)
        .orderBy("avg_sentiment", "Reviewer_Location")
    )


def staff_impact(reviews: DataFrame) -> DataFrame:
    """Box of the scores per staff label: quartiles, whiskers at 1.5 times their distance, outliers."""
    scores = (
        reviews.filter(has_label(F.col("staff_sentiment")) & F.col("sentiment_score").isNotNull())
        .groupBy("staff_sentiment", "sentiment_score")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    quartiles = scores.groupBy("staff_sentiment").agg(
        F.sum("rows").alias("reviews"),
        F.percentile("sentiment_score", F.lit([0.25, 0.5, 0.75]), F.col("rows")).alias("q"),
        F.collect_list(F.struct("sentiment_score", "rows")).alias("scores"),
    )
    q1, q3 = F.col("q")[0], F.col("q")[2]
    low, high = q1 - (q3 - q1) * 1.5, q3 + (q3 - q1) * 1.5
    inside = F.filter("scores", lambda s: s["sentiment_score"].between(low, high))
    outside = F.filter("scores", lambda s: ~s["sentiment_score"].between(low, high))
    return quartiles.select(
        "staff_sentiment",
        "reviews",
        q1.alias("q1"),
        F.col("q")[1].alias("median"),
        q3.alias("q3"),
        F.array_min(F.transform(inside, lambda s: s["sentiment_score"])).alias("whisker_low"),
        F.array_max(F.transform(inside, lambda s: s["sentiment_score"])).alias("whisker_high"),
        F.aggregate(outside, F.lit(0).cast("bigint"), lambda a, s: a + s["rows"]).alias("outliers"),
    )


def crowd_impact(reviews: DataFrame) -> DataFrame:
    """Mean score and complaint rate per crowd level; every level has a row, in fixed order."""
    measured = (
        score_cells(reviews.filter(F.col("crowd_level").isin(fixed.CROWD_LEVEL_ORDER)), "crowd_level")
        .groupBy("crowd_level")
        .agg(
            weighted_mean("sentiment_score", "rows").alias("avg_sentiment"),
            weighted_rate("is_complaint", "rows").alias("complaint_rate"),
        )
    )
    return reindex(measured, "crowd_level", fixed.CROWD_LEVEL_ORDER).orderBy("position")


def reindex(df: DataFrame, key: str, values: list) -> DataFrame:
    """One row per value of the fixed list, with its position; values without data are null rows."""
    domain = df.sparkSession.sql(
        f"SELECT pos AS position, col AS {key} FROM (SELECT posexplode(:domain))", {"domain": F.lit(values)}
    )
    return domain.join(df, key, "left")


def reindex_seasons(heatmap: DataFrame) -> DataFrame:
    """All four seasons for every park and theme of the heatmap."""
    pairs = heatmap.select("Branch", "theme").distinct()
    seasons = F.explode(F.array(*[F.lit(s) for s in fixed.SEASON_ORDER]))
    return pairs.withColumn("Season", seasons).join(heatmap, CELL, "left")


def sentiment_distribution(reviews: DataFrame, *group: str) -> DataFrame:
    """Share of each label in percent, over the reviews that have one."""
    counted = (
        reviews.filter(F.col("sentiment_label").isNotNull())
        .groupBy(*group, "sentiment_label")
        .agg(F.count(F.lit(1)).alias("reviews"))
    )
    return shares(counted, *group)


def shares(counted: DataFrame, *group: str) -> DataFrame:
    total = F.sum("reviews").over(Window.partitionBy(*group))
    return counted.withColumn("share", F.col("reviews") / total * 100)


def share_text(label: Column, share: Column) -> Column:
    return F.concat(label, F.lit(" ("), one_decimal(share), F.lit("%)"))


def distribution_text(shared: DataFrame, *group: str) -> DataFrame:
    """One text per group, most frequent label first: ``Positive (77.7%), Neutral (12.0%)``."""
    entry = F.struct(
        (-F.col("reviews")).alias("order"),
        F.col("sentiment_label").alias("label"),
        share_text(F.col("sentiment_label"), F.col("share")).alias("text"),
    )
    entries = F.array_sort(F.collect_list(entry))
    return shared.groupBy(*group).agg(F.concat_ws(", ", F.transform(entries, lambda e: e["text"])).alias("distribution"))


def coverage(reviews: DataFrame) -> DataFrame:
    """Percent of reviews that have a score."""
    return reviews.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.try_divide(F.count("sentiment_score") * 100.0, F.count(F.lit(1))).alias("coverage"),
    )


def valid_branches(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("Branch").isNotNull()).select("Branch").distinct()


def value_counts(reviews: DataFrame, *columns: str) -> DataFrame:
    """Counts of all values, nulls too."""
    return reviews.groupBy(*columns).agg(F.count(F.lit(1)).alias("reviews"))


def branch_counts(reviews: DataFrame, part: str = "disney") -> DataFrame:
    return value_counts(reviews.filter(branch_contains(part)), "Branch")


def pct_negative() -> Column:
    return round_one(F.try_divide(F.col("neg_count").cast("double"), F.col("volume")) * 100)
