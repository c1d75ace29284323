"""The playbook: issues ranked by severity, with trend, action and a quote.

All numbers come from the theme cells, which are read once from the reviews and are small.  Quotes
need the texts, so they take a second pass, restricted to the issues that made the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from guestlens import fixed_values as fixed
from guestlens.functions.text import (
    action_for, evidence_text, finding_action_for, issue_text, one_decimal, park_name, quotable, snippet,
)
from guestlens.functions.themes import explode_themes
from guestlens.operators.filters import low_data
from guestlens.operators.insights import (
    CELL, grouped_cells, negative_count, pct_negative, theme_cells, weighted_mean, weighted_median, with_season,
)

MIN_VOLUME = 30
TREND_EPS = 0.2
TOP = 15
SHORT_QUOTE = 150


def playbook_cells(cells: DataFrame, least: int = MIN_VOLUME) -> DataFrame:
    """Volume, median, negatives and the flag for thin data per park, season and theme."""
    return (
        grouped_cells(cells)
        .groupBy(*CELL)
        .agg(
            F.sum("n").alias("volume"),
            weighted_median("sentiment_score", "rows").alias("median_sentiment"),
            negative_count().alias("neg_count"),
        )
        .withColumn("pct_negative", pct_negative())
        .withColumn("low_data_flag", low_data(F.col("volume"), least))
    )


def baseline_severity(cells: DataFrame) -> DataFrame:
    """Mean score per park and theme over all reviews, those without a season too."""
    return (
        cells.filter(F.col("Branch").isNotNull())
        .groupBy("Branch", "theme")
        .agg(weighted_mean("sentiment_score", "rows").alias("baseline_severity"))
    )


def with_baseline(issues: DataFrame, cells: DataFrame) -> DataFrame:
    return issues.join(baseline_severity(cells), ["Branch", "theme"], "left")


def trend(delta: Column, eps: float = TREND_EPS) -> Column:
    return (
        F.when(delta < -eps, F.lit(fixed.TREND_WORSE))
        .when(delta > eps, F.lit(fixed.TREND_BETTER))
        .otherwise(F.lit(fixed.TREND_SAME))
    )


def trends_from_cells(cells: DataFrame, min_volume: int = MIN_VOLUME, trend_eps: float = TREND_EPS) -> DataFrame:
    """Cells with enough data, their baseline and trend.

    Baseline and cells come from the same aggregate: the baseline sums the few seasons of a park and
    theme by a window, so the reviews are read once and nothing is joined.
    """
    in_theme = Window.partitionBy("Branch", "theme")
    summed = cells.filter(F.col("Branch").isNotNull()).groupBy(*CELL).agg(
        F.sum("n").alias("volume"),
        weighted_median("sentiment_score", "rows").alias("median_sentiment"),
        negative_count().alias("neg_count"),
        F.sum(F.col("sentiment_score") * F.col("rows")).alias("_scores"),
        F.sum(F.when(F.col("sentiment_score").isNotNull(), F.col("rows"))).alias("_scored"),
    )
    baseline = F.try_divide(F.sum("_scores").over(in_theme).cast("double"), F.sum("_scored").over(in_theme))
    gated = summed.withColumns({
        "pct_negative": pct_negative(),
        "low_data_flag": low_data(F.col("volume"), min_volume),
        "baseline_severity": baseline,
    }).filter(F.col("Season").isNotNull() & ~F.col("low_data_flag")).drop("_scores", "_scored")
    delta = F.col("median_sentiment") - F.col("baseline_severity")
    return gated.withColumn("delta_vs_baseline", delta).withColumn("trend", trend(F.col("delta_vs_baseline"), trend_eps))


def playbook_trends(reviews: DataFrame, min_volume: int = MIN_VOLUME, trend_eps: float = TREND_EPS) -> DataFrame:
    """Every cell with enough data, with its baseline and trend."""
    return trends_from_cells(theme_cells(reviews), min_volume, trend_eps)


def severity_order() -> list[Column]:
    return [F.asc_nulls_last("median_sentiment"), F.desc("volume"), F.asc("Branch"), F.asc("Season"), F.asc("theme")]


def critical_issues(trends: DataFrame, top: int = TOP) -> DataFrame:
    """The most severe cells, larger ones first among equals."""
    return trends.orderBy(*severity_order()).limit(top)


def quotes(reviews: DataFrame) -> DataFrame:
    """The quote of each cell: the first negative text of 40 to 300 characters, else the start of the
    first negative text.

    The winning keys are found first, without texts; then one text per cell is fetched.  Cells are parks of
    the season table by seasons by themes, a bound that no amount of reviews changes, so they are broadcast.
    """
    whole = quotable(F.col("Review_Text"))
    negative = with_season(reviews).filter(F.col("sentiment_label") == "Negative")
    themed = grouped_cells(explode_themes(negative.withColumn("_whole", whole).drop("Review_Text")))
    key = F.col("review_uid")
    first = themed.groupBy(*CELL).agg(F.min(F.when(F.col("_whole"), key)).alias("_quotable"), F.min(key).alias("_any"))
    winners = first.select(*CELL, F.coalesce("_quotable", "_any").alias("review_uid"))
    shown = F.when(whole, F.col("Review_Text")).otherwise(snippet(F.col("Review_Text"), SHORT_QUOTE, always=True))
    texts = reviews.select("review_uid", shown.alias("quote"))
    return texts.join(F.broadcast(winners), "review_uid").select(*CELL, "quote")


def with_quotes(issues: DataFrame, reviews: DataFrame) -> DataFrame:
    """Issues with their quote."""
    return issues.join(quotes(reviews), CELL, "left").withColumn(
        "representative_quote", F.coalesce("quote", F.lit(fixed.NO_QUOTE))
    ).drop("quote")


def cx_playbook(
    reviews: DataFrame, min_volume: int = MIN_VOLUME, trend_eps: float = TREND_EPS, top: int = TOP,
    cells: DataFrame | None = None,
) -> DataFrame:
    """The ranked issue table.  ``cells`` saves the first pass if the theme cells are there already."""
    cells = theme_cells(reviews) if cells is None else cells
    issues = critical_issues(trends_from_cells(cells, min_volume, trend_eps), top)
    return formatted(with_quotes(issues, reviews)).orderBy(*playbook_order())


def formatted(issues: DataFrame) -> DataFrame:
    return issues.select(
        park_name(F.col("Branch")).alias("park"),
        issue_text(F.col("theme")).alias("issue"),
        "theme",
        F.col("median_sentiment").alias("severity"),
        "baseline_severity",
        "delta_vs_baseline",
        "trend",
        evidence_text(F.col("pct_negative")).alias("evidence_metric"),
        F.col("Season").alias("season"),
        action_for(F.col("theme")).alias("recommended_action"),
        F.col("volume").alias("vol"),
        "low_data_flag",
        "representative_quote",
    )


def playbook_order() -> list[Column]:
    """Severity first; ties by volume, park, season and theme."""
    return [F.asc_nulls_last("severity"), F.desc("vol"), F.asc("park"), F.asc("season"), F.asc("theme")]


def volume_order() -> list[Column]:
    return [F.desc("vol"), F.asc_nulls_last("severity"), F.asc("park"), F.asc("season"), F.asc("theme")]


def ranked_lines(playbook: DataFrame, top: int = 3) -> DataFrame:
    """Every issue with its lines for the three sections, null where it does not appear.

    The playbook is a short list, so its rankings and the one-row summary are small.
    """
    worsens = F.coalesce(F.col("trend").contains("Worse"), F.lit(False))
    ranked = playbook.select("park", "theme", "issue", "season", "severity", "vol", worsens.alias("worsens")).withColumns({
        "by_severity": F.row_number().over(Window.orderBy(*playbook_order())),
        "by_volume": F.row_number().over(Window.orderBy(*volume_order())),
        "by_trend": F.row_number().over(Window.orderBy(F.desc("worsens"), *playbook_order())),
    })
    volume = F.concat(F.lit("Vol: "), F.col("vol").cast("string"), F.lit(")"))
    start = F.concat(F.lit("- "), "park", F.lit(": "), "issue", F.lit(" ("))
    severity = F.concat(start, F.lit("Severity: "), one_decimal(F.col("severity")), F.lit(", "), volume)
    worse = F.concat(F.lit("- "), "park", F.lit(" "), "theme", F.lit(": Sentiment deteriorated vs baseline."))

    def entry(section: int, rank: str, shown: Column, line: Column) -> Column:
        return F.when(shown, F.struct(F.lit(section).alias("section"), F.col(rank).alias("line_no"), line.alias("line")))

    return ranked.select(
        "worsens",
        entry(1, "by_severity", F.col("by_severity") <= top, severity).alias("worst"),
        entry(2, "by_volume", F.col("by_volume") <= top, F.concat(start, volume)).alias("largest"),
        entry(3, "by_trend", F.col("worsens") & (F.col("by_trend") <= top), worse).alias("worsening"),
    )


def narrative_lines(playbook: DataFrame, top: int = 3) -> DataFrame:
    """The lines of the summary, as (section, line_no, line): worst, largest and worsening issues."""
    return ranked_lines(playbook, top).select(F.inline(F.array_compact(F.array("worst", "largest", "worsening"))))


def narrative(playbook: DataFrame, top: int = 3) -> DataFrame:
    """The summary as one text; a fixed sentence for an empty playbook."""

    def section(name: str) -> Column:
        in_order = F.array_sort(F.collect_list(F.col(name)))
        return F.array_join(F.transform(in_order, lambda e: F.concat(e["line"], F.lit("\n"))), "")

    told = ranked_lines(playbook, top).agg(
        F.count(F.lit(1)).alias("issues"),
        F.count_if("worsens").alias("worse"),
        *[section(name).alias(name) for name in ("worst", "largest", "worsening")],
    )
    worsening = F.concat(F.lit("Verified Worsening Trends ("), F.col("worse").cast("string"), F.lit(" items):\n"), "worsening")
    text = F.concat(
        F.lit("Playbook Statistical Summary:\n\nTop 3 High Severity Issues (Lowest Sentiment):\n"), "worst",
        F.lit("\nTop 3 High Volume Issues (Most Frequent):\n"), "largest", F.lit("\n"),
        F.when(F.col("worse") > 0, worsening).otherwise(F.lit(fixed.NO_WORSENING + "\n")),
    )
    return told.select(F.when(F.col("issues") == 0, F.lit(fixed.NO_ISSUES)).otherwise(text).alias("narrative"))


def worst_cells(cells: DataFrame, least: int = MIN_VOLUME) -> DataFrame:
    """Per park the cell with the lowest median among those with enough data, and the mean of the
    medians of its theme in the park.

    Parks without such a cell keep one row with ``low_data_flag`` set.
    """
    thin = F.col("low_data_flag") | F.col("median_sentiment").isNull()
    in_theme = Window.partitionBy("Branch", "theme")
    in_park = Window.partitionBy("Branch").orderBy("low_data_flag", "median_sentiment", "Season", "theme")
    return (
        playbook_cells(cells, least)
        .withColumn("low_data_flag", thin)
        .withColumn("theme_average", F.avg(F.when(~F.col("low_data_flag"), F.col("median_sentiment"))).over(in_theme))
        .withColumn("rank", F.row_number().over(in_park))
        .filter("rank = 1")
        .drop("rank")
    )


def insight_findings(reviews: DataFrame, least: int = MIN_VOLUME, least_drop: float = 0.3) -> DataFrame:
    """Per park the critical issue, an action, and its drop below the theme's average if large."""
    return findings_from_cells(theme_cells(reviews), least, least_drop)


def findings_from_cells(cells: DataFrame, least: int = MIN_VOLUME, least_drop: float = 0.3) -> DataFrame:
    found = worst_cells(cells, least)
    met = ~F.col("low_data_flag")
    drop = F.col("theme_average") - F.col("median_sentiment")
    issue = F.concat(
        F.lit("CRITICAL ISSUE: '"), "theme", F.lit("' in "), "Season", F.lit(" has lowest sentiment ("),
        one_decimal(F.col("median_sentiment")), F.lit(", N="), F.col("volume").cast("string"), F.lit(")."),
    )
    note = F.concat(
        F.lit("This is "), one_decimal(drop), F.lit(" points lower than the "), "theme",
        F.lit(" average ("), one_decimal(F.col("theme_average")), F.lit(") at this park."),
    )
    return found.select(
        "Branch",
        F.when(met, issue).otherwise(F.lit(fixed.NO_THEMES_MET)).alias("finding"),
        F.when(met, finding_action_for(F.col("theme"))).alias("action"),
        F.when(met & (drop > least_drop), note).alias("drop_note"),
        F.when(met & (drop > least_drop), drop).alias("drop"),
    )
