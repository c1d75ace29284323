"""Queries: insights, playbook, label comparison and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from guestlens import fixed_values as fixed
from guestlens.functions import lexicon
from guestlens.operators import compare, insights, profile
from guestlens.plans import playbook, quant
from guestlens.registry.base import (
    CELLS, FINDING_CASE, ISSUES, MONTH_START, PLAYBOOK, QUOTES, REVIEWS, SEASONED, THEMED, TRENDS, any_word, as_bigint, as_text,
    keyword_case, labels_of, light_reviews, query, rounded,
)
from guestlens.sources import tables

HEATMAP_SQL = CELLS + """
, heat AS (SELECT Branch, Season, theme, CASE WHEN volume >= 30 THEN median_sentiment END AS median_sentiment, CAST(volume AS BIGINT) AS volume FROM cells)"""
SEASONS_SQL = "(VALUES ('Winter'), ('Spring'), ('Summer'), ('Autumn')) s(Season)"
LABEL_ORDER = ["Crowded", "Empty", "Moderate", "None", "Packed"]


# --- insights -----------------------------------------------------------------------------

@query("theme_season_heatmap", HEATMAP_SQL + " SELECT * FROM heat")
def theme_season_heatmap(spark, sf):
    return insights.theme_season_heatmap(light_reviews(spark, sf))


@query("extended_metrics", CELLS + """
SELECT Branch, Season, theme, round(CASE WHEN volume >= 30 THEN mean_sentiment END, 6) AS mean_sentiment,
 CASE WHEN volume >= 30 THEN median_sentiment END AS median_sentiment, CAST(volume AS BIGINT) AS volume, CAST(neg_count AS BIGINT) AS neg_count,
 round(CASE WHEN volume >= 30 THEN neg_count / volume END, 6) AS share_negative FROM cells""")
def extended_metrics(spark, sf):
    return rounded(insights.extended_metrics(light_reviews(spark, sf)), "mean_sentiment", "share_negative")


def _pivot_sql(value):
    columns = ", ".join(f"max({value}) FILTER (WHERE Season = '{s}') AS \"{s}\"" for s in fixed.SEASON_ORDER)
    return HEATMAP_SQL + f" SELECT Branch, theme, {columns} FROM heat GROUP BY Branch, theme"


@query("sentiment_pivot", _pivot_sql("median_sentiment"))
def sentiment_pivot(spark, sf):
    return insights.season_pivot(insights.theme_season_heatmap(light_reviews(spark, sf)), "median_sentiment")


@query("volume_pivot", _pivot_sql("volume"))
def volume_pivot(spark, sf):
    return insights.season_pivot(insights.theme_season_heatmap(light_reviews(spark, sf)), "volume")


@query("low_rating_drivers", THEMED + " SELECT theme, count(*) AS reviews FROM exploded WHERE Rating <= 2 GROUP BY theme ORDER BY reviews DESC, theme LIMIT 10")
def low_rating_drivers(spark, sf):
    return insights.low_rating_drivers(light_reviews(spark, sf))


@query("monthly_seasonality", REVIEWS + f"""
SELECT CAST({MONTH_START} AS VARCHAR) AS month_start, round(avg(sentiment_score), 6) AS sentiment, round(avg(CAST(is_complaint AS INT)), 6) AS complaint_rate
FROM reviews WHERE {MONTH_START} IS NOT NULL GROUP BY 1""")
def monthly_seasonality(spark, sf):
    monthly = insights.monthly_seasonality(light_reviews(spark, sf))
    return rounded(monthly, "sentiment", "complaint_rate").withColumn("month_start", F.col("month_start").cast("string"))


@query("country_sentiment", REVIEWS + """
, top AS (SELECT Reviewer_Location, count(*) AS reviews FROM reviews GROUP BY 1 ORDER BY reviews DESC, 1 LIMIT 10)
SELECT r.Reviewer_Location, count(*) AS reviews, round(avg(r.sentiment_score), 6) AS avg_sentiment
FROM reviews r JOIN top t ON t.Reviewer_Location = r.Reviewer_Location GROUP BY 1""")
def country_sentiment(spark, sf):
    return rounded(insights.country_sentiment(light_reviews(spark, sf)), "avg_sentiment")


@query("top_location_reviews", REVIEWS + """
, top AS (SELECT Reviewer_Location, count(*) AS reviews FROM reviews GROUP BY 1 ORDER BY reviews DESC, 1 LIMIT 10)
SELECT CAST(review_uid AS BIGINT) AS review_uid, Reviewer_Location FROM reviews WHERE Reviewer_Location IN (SELECT Reviewer_Location FROM top)""")
def top_location_reviews(spark, sf):
    return insights.from_top_locations(light_reviews(spark, sf)).select("review_uid", "Reviewer_Location")


@query("staff_impact", REVIEWS + """
, s AS (SELECT staff_sentiment, sentiment_score AS x FROM reviews WHERE staff_sentiment <> 'None' AND sentiment_score IS NOT NULL),
 q AS (SELECT staff_sentiment, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM s GROUP BY 1)
SELECT s.staff_sentiment, count(*) AS reviews, q1, median, q3,
 CAST(min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS whisker_low,
 CAST(max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS whisker_high,
 count(*) FILTER (WHERE x NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM s JOIN q ON q.staff_sentiment = s.staff_sentiment GROUP BY s.staff_sentiment, q1, median, q3""")
def staff_impact(spark, sf):
    return as_bigint(insights.staff_impact(light_reviews(spark, sf)), "whisker_low", "whisker_high")


@query("crowd_impact", REVIEWS + """
SELECT CAST(d.position AS BIGINT) AS position, d.crowd_level, round(avg(r.sentiment_score), 6) AS avg_sentiment, round(avg(CAST(r.is_complaint AS INT)), 6) AS complaint_rate
FROM (VALUES (0, 'Empty'), (1, 'Moderate'), (2, 'Crowded'), (3, 'Packed')) d(position, crowd_level) LEFT JOIN reviews r ON r.crowd_level = d.crowd_level
GROUP BY d.position, d.crowd_level""")
def crowd_impact(spark, sf):
    return as_bigint(rounded(insights.crowd_impact(light_reviews(spark, sf)), "avg_sentiment", "complaint_rate"), "position")


@query("season_reindex", HEATMAP_SQL + f"""
SELECT p.Branch, p.theme, s.Season, h.median_sentiment, h.volume FROM (SELECT DISTINCT Branch, theme FROM heat) p CROSS JOIN {SEASONS_SQL}
LEFT JOIN heat h ON h.Branch = p.Branch AND h.theme = p.theme AND h.Season = s.Season""")
def season_reindex(spark, sf):
    return insights.reindex_seasons(insights.theme_season_heatmap(light_reviews(spark, sf)))


@query("sentiment_distribution", REVIEWS + """
SELECT sentiment_label, count(*) AS reviews, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share FROM reviews WHERE sentiment_label IS NOT NULL GROUP BY 1""")
def sentiment_distribution(spark, sf):
    return rounded(insights.sentiment_distribution(light_reviews(spark, sf)), "share")


@query("distribution_text", REVIEWS + """
, c AS (SELECT Branch, sentiment_label, count(*) AS n FROM reviews WHERE sentiment_label IS NOT NULL GROUP BY 1, 2),
 s AS (SELECT *, n / sum(n) OVER (PARTITION BY Branch) * 100 AS share FROM c)
SELECT Branch, string_agg(concat(sentiment_label, ' (', printf('%.1f', share), '%)'), ', ' ORDER BY n DESC, sentiment_label) AS distribution FROM s GROUP BY Branch""")
def distribution_text(spark, sf):
    shared = insights.sentiment_distribution(light_reviews(spark, sf), "Branch")
    return insights.distribution_text(shared, "Branch")


@query("enrichment_coverage", REVIEWS + " SELECT count(*) AS reviews, round(count(sentiment_score) * 100.0 / count(*), 6) AS coverage FROM reviews")
def enrichment_coverage(spark, sf):
    return rounded(insights.coverage(light_reviews(spark, sf)), "coverage")


@query("valid_branches", REVIEWS + " SELECT DISTINCT Branch FROM reviews WHERE Branch IS NOT NULL ORDER BY Branch")
def valid_branches(spark, sf):
    return insights.valid_branches(light_reviews(spark, sf)).orderBy("Branch")


@query("crowd_value_counts", REVIEWS + " SELECT Branch, crowd_level, count(*) AS reviews FROM reviews GROUP BY 1, 2")
def crowd_value_counts(spark, sf):
    return insights.value_counts(light_reviews(spark, sf), "Branch", "crowd_level")


@query("branch_counts", REVIEWS + " SELECT Branch, count(*) AS reviews FROM reviews WHERE contains(lower(Branch), 'disney') GROUP BY 1")
def branch_counts(spark, sf):
    return insights.branch_counts(light_reviews(spark, sf))


@query("period_over_period", REVIEWS + f"""
, m AS (SELECT Branch, {MONTH_START} AS month_start, count(*) AS review_count, avg(Rating) AS avg_rating, avg(sentiment_score) AS avg_sentiment
 FROM reviews WHERE Branch IS NOT NULL AND {MONTH_START} IS NOT NULL GROUP BY 1, 2),
 l AS (SELECT *, lag(review_count) OVER w AS n0, lag(avg_rating) OVER w AS r0, lag(avg_sentiment) OVER w AS s0 FROM m WINDOW w AS (PARTITION BY Branch ORDER BY month_start))
SELECT Branch, CAST(month_start AS VARCHAR) AS month_start, review_count, round(avg_rating, 6) AS avg_rating, round(avg_sentiment, 6) AS avg_sentiment,
 round((review_count - n0) / n0 * 100, 6) AS review_count_change_pct, round((avg_rating - r0) / r0 * 100, 6) AS avg_rating_change_pct,
 round((avg_sentiment - s0) / s0 * 100, 6) AS avg_sentiment_change_pct FROM l""")
def period_over_period(spark, sf):
    changes = quant.period_over_period(light_reviews(spark, sf))
    return rounded(changes, "avg_rating", "avg_sentiment", "review_count_change_pct", "avg_rating_change_pct",
                   "avg_sentiment_change_pct").withColumn("month_start", F.col("month_start").cast("string"))


# --- playbook -----------------------------------------------------------------------------

@query("playbook_base", CELLS + """
SELECT Branch, Season, theme, CAST(volume AS BIGINT) AS volume, median_sentiment, CAST(neg_count AS BIGINT) AS neg_count,
 round_even(CAST(neg_count AS DOUBLE) / volume * 100 * 10, 0) / 10 AS pct_negative, volume < 30 AS low_data_flag FROM cells""")
def playbook_base(spark, sf):
    return playbook.playbook_cells(insights.theme_cells(light_reviews(spark, sf)))


@query("baseline_severity", THEMED + " SELECT Branch, theme, round(avg(sentiment_score), 6) AS baseline_severity FROM exploded WHERE Branch IS NOT NULL GROUP BY 1, 2")
def baseline_severity(spark, sf):
    return rounded(playbook.baseline_severity(insights.theme_cells(light_reviews(spark, sf))), "baseline_severity")


@query("baseline_join", TRENDS + " SELECT Branch, Season, theme, median_sentiment, round(baseline_severity, 6) AS baseline_severity, round(delta, 6) AS delta FROM trends")
def baseline_join(spark, sf):
    cells = insights.theme_cells(light_reviews(spark, sf))
    gated = playbook.playbook_cells(cells).filter(~F.col("low_data_flag"))
    joined = playbook.with_baseline(gated, cells)
    delta = (F.col("median_sentiment") - F.col("baseline_severity")).alias("delta")
    return rounded(joined.select(*insights.CELL, "median_sentiment", "baseline_severity", delta), "baseline_severity", "delta")


@query("playbook_trends", TRENDS + """
SELECT Branch, Season, theme, CAST(volume AS BIGINT) AS volume, median_sentiment, CAST(neg_count AS BIGINT) AS neg_count, pct_negative,
 false AS low_data_flag, round(baseline_severity, 6) AS baseline_severity, round(delta, 6) AS delta_vs_baseline, trend FROM trends""")
def playbook_trends(spark, sf):
    return rounded(playbook.playbook_trends(light_reviews(spark, sf)), "baseline_severity", "delta_vs_baseline")


@query("critical_issues", ISSUES + " SELECT Branch, Season, theme, CAST(volume AS BIGINT) AS volume, median_sentiment, trend FROM issues")
def critical_issues(spark, sf):
    issues = playbook.critical_issues(playbook.playbook_trends(light_reviews(spark, sf)))
    return issues.select(*insights.CELL, "volume", "median_sentiment", "trend")


@query("representative_quotes", THEMED + f", {QUOTES} SELECT Branch, Season, theme, quote FROM quotes")
def representative_quotes(spark, sf):
    return playbook.quotes(tables.reviews(spark, sf))


@query("issue_quotes", ISSUES + f""", {QUOTES}
SELECT i.Branch, i.Season, i.theme, coalesce(q.quote, '{fixed.NO_QUOTE}') AS representative_quote
FROM issues i LEFT JOIN quotes q ON q.Branch = i.Branch AND q.Season = i.Season AND q.theme = i.theme""")
def issue_quotes(spark, sf):
    r = tables.reviews(spark, sf)
    issues = playbook.critical_issues(playbook.playbook_trends(r))
    return playbook.with_quotes(issues, r).select(*insights.CELL, "representative_quote")


@query("cx_playbook", PLAYBOOK + """
SELECT park, issue, theme, severity, round(baseline_severity, 6) AS baseline_severity, round(delta_vs_baseline, 6) AS delta_vs_baseline, trend,
 evidence_metric, season, recommended_action, CAST(vol AS BIGINT) AS vol, low_data_flag, representative_quote FROM playbook""")
def cx_playbook(spark, sf):
    return rounded(playbook.cx_playbook(tables.reviews(spark, sf)), "baseline_severity", "delta_vs_baseline")


LINES_SQL = PLAYBOOK + """
, ranked AS (SELECT *, row_number() OVER (ORDER BY severity ASC NULLS LAST, vol DESC, park, season, theme) AS by_severity,
  row_number() OVER (ORDER BY vol DESC, severity ASC NULLS LAST, park, season, theme) AS by_volume FROM playbook),
 worse AS (SELECT *, row_number() OVER (ORDER BY severity ASC NULLS LAST, vol DESC, park, season, theme) AS by_trend FROM playbook WHERE contains(trend, 'Worse')),
 lines AS (
  SELECT 1 AS section, by_severity AS line_no, concat('- ', park, ': ', issue, ' (Severity: ', printf('%.1f', severity), ', Vol: ', CAST(vol AS VARCHAR), ')') AS line FROM ranked WHERE by_severity <= 3
  UNION ALL SELECT 2, by_volume, concat('- ', park, ': ', issue, ' (Vol: ', CAST(vol AS VARCHAR), ')') FROM ranked WHERE by_volume <= 3
  UNION ALL SELECT 3, by_trend, concat('- ', park, ' ', theme, ': Sentiment deteriorated vs baseline.') FROM worse WHERE by_trend <= 3)"""


@query("narrative_lines", LINES_SQL + " SELECT CAST(section AS BIGINT) AS section, CAST(line_no AS BIGINT) AS line_no, line FROM lines")
def narrative_lines(spark, sf):
    lines = playbook.narrative_lines(playbook.cx_playbook(tables.reviews(spark, sf)))
    return as_bigint(lines, "section", "line_no")


@query("playbook_narrative", LINES_SQL + f"""
, parts AS (SELECT section, string_agg(line || chr(10), '' ORDER BY line_no) AS body FROM lines GROUP BY section)
SELECT concat('Playbook Statistical Summary:', chr(10), chr(10), 'Top 3 High Severity Issues (Lowest Sentiment):', chr(10),
 (SELECT body FROM parts WHERE section = 1), chr(10), 'Top 3 High Volume Issues (Most Frequent):', chr(10), (SELECT body FROM parts WHERE section = 2), chr(10),
 CASE WHEN (SELECT count(*) FROM worse) > 0 THEN concat('Verified Worsening Trends (', CAST((SELECT count(*) FROM worse) AS VARCHAR), ' items):', chr(10),
  (SELECT body FROM parts WHERE section = 3)) ELSE concat('{fixed.NO_WORSENING}', chr(10)) END) AS narrative""")
def playbook_narrative(spark, sf):
    return playbook.narrative(playbook.cx_playbook(tables.reviews(spark, sf)))


WORST_SQL = CELLS + """
, gated AS (SELECT *, avg(median_sentiment) OVER (PARTITION BY Branch, theme) AS theme_average,
  row_number() OVER (PARTITION BY Branch ORDER BY median_sentiment, Season, theme) AS rn
  FROM cells WHERE volume >= 30 AND median_sentiment IS NOT NULL), worst AS (SELECT * FROM gated WHERE rn = 1)"""


@query("worst_cells", WORST_SQL + " SELECT Branch, Season, theme, CAST(volume AS BIGINT) AS volume, median_sentiment, round(theme_average, 6) AS theme_average FROM worst")
def worst_cells(spark, sf):
    worst = playbook.worst_cells(insights.theme_cells(light_reviews(spark, sf))).filter("NOT low_data_flag")
    return rounded(worst.select(*insights.CELL, "volume", "median_sentiment", "theme_average"), "theme_average")


@query("insight_findings", WORST_SQL + f"""
SELECT p.Branch, CASE WHEN w.theme IS NULL THEN '{fixed.NO_THEMES_MET}' ELSE concat('CRITICAL ISSUE: ''', theme, ''' in ', Season, ' has lowest sentiment (',
  printf('%.1f', median_sentiment), ', N=', CAST(volume AS VARCHAR), ').') END AS finding,
 CASE WHEN w.theme IS NOT NULL THEN {FINDING_CASE} END AS action,
 CASE WHEN theme_average - median_sentiment > 0.3 THEN concat('This is ', printf('%.1f', theme_average - median_sentiment), ' points lower than the ', theme,
  ' average (', printf('%.1f', theme_average), ') at this park.') END AS drop_note,
 CASE WHEN theme_average - median_sentiment > 0.3 THEN round(theme_average - median_sentiment, 6) END AS "drop"
FROM (SELECT DISTINCT Branch FROM cells) p LEFT JOIN worst w ON w.Branch = p.Branch""")
def insight_findings(spark, sf):
    return rounded(playbook.insight_findings(light_reviews(spark, sf)), "drop")


# --- labels -------------------------------------------------------------------------------

FIELDS = ("crowd_level", "staff_sentiment", "price_sensitivity")
FILLED = ", ".join(f"{keyword_case(f)} AS {f}" for f in FIELDS)
PAIRED_SQL = REVIEWS + f", paired AS (SELECT review_uid, Branch, crowd_level AS crowd_level_a, {keyword_case('crowd_level')} AS crowd_level_b FROM reviews)"


@query("keyword_backfill", REVIEWS + f" SELECT CAST(review_uid AS BIGINT) AS review_uid, {FILLED} FROM reviews")
def keyword_backfill(spark, sf):
    return lexicon.fill_labels(tables.reviews(spark, sf)).select("review_uid", *FIELDS)


@query("backfill_stats", REVIEWS + f", filled AS (SELECT {FILLED} FROM reviews) " + " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST((SELECT count({f}) FROM filled) - (SELECT count({f}) FROM reviews) AS BIGINT) AS filled" for f in FIELDS))
def backfill_stats(spark, sf):
    return compare.backfill_stats(tables.reviews(spark, sf))


def _pairs(spark, sf):
    r = tables.reviews(spark, sf)
    return compare.side_by_side(r, lexicon.fill_labels(r), "crowd_level", keep=["Branch"])


A, B = "crowd_level_a", "crowd_level_b"


@query("version_pairs", PAIRED_SQL + " SELECT CAST(review_uid AS BIGINT) AS review_uid, Branch, crowd_level_a, crowd_level_b FROM paired")
def version_pairs(spark, sf):
    return _pairs(spark, sf)


@query("extraction_rate", PAIRED_SQL + """
SELECT count(*) AS shared, round(count(crowd_level_a) * 100.0 / count(*), 6) AS rate_a, round(count(crowd_level_b) * 100.0 / count(*), 6) AS rate_b FROM paired""")
def extraction_rate(spark, sf):
    return rounded(compare.extraction_rate(_pairs(spark, sf), A, B), "rate_a", "rate_b")


@query("version_changes", PAIRED_SQL + """
SELECT count(*) FILTER (WHERE crowd_level_a IS NULL AND crowd_level_b IS NOT NULL) AS new_finds,
 count(*) FILTER (WHERE crowd_level_a IS NOT NULL AND crowd_level_b IS NULL) AS lost_finds,
 count(*) FILTER (WHERE crowd_level_a <> crowd_level_b) AS disagreements FROM paired""")
def version_changes(spark, sf):
    return compare.change_counts(_pairs(spark, sf), A, B)


@query("changed_rows", PAIRED_SQL + """
SELECT CAST(review_uid AS BIGINT) AS review_uid, crowd_level_a, crowd_level_b,
 CASE WHEN crowd_level_a IS NULL THEN 'new' WHEN crowd_level_b IS NULL THEN 'lost' ELSE 'differs' END AS change
FROM paired WHERE crowd_level_a IS DISTINCT FROM crowd_level_b""")
def changed_rows(spark, sf):
    return compare.changed_rows(_pairs(spark, sf), A, B).drop("Branch")


@query("label_confusion", PAIRED_SQL + """
SELECT coalesce(crowd_level_a, 'None') AS crowd_level_a, coalesce(crowd_level_b, 'None') AS crowd_level_b, count(*) AS reviews FROM paired GROUP BY 1, 2""")
def label_confusion(spark, sf):
    return compare.confusion(_pairs(spark, sf), A, B)


@query("confusion_matrix", PAIRED_SQL + " SELECT coalesce(crowd_level_a, 'None') AS crowd_level_a, " + ", ".join(
    f"count(*) FILTER (WHERE coalesce(crowd_level_b, 'None') = '{label}') AS \"{label}\"" for label in LABEL_ORDER) + " FROM paired GROUP BY 1")
def confusion_matrix(spark, sf):
    return compare.confusion_matrix(_pairs(spark, sf), A, B, LABEL_ORDER)


def _miss_sql(words, group):
    said = any_word("Review_Text", words)
    return f"""SELECT {group}count(*) FILTER (WHERE {said}) AS mentioned, count(*) FILTER (WHERE {said} AND crowd_level IS NULL) AS missed,
 round(coalesce(count(*) FILTER (WHERE {said} AND crowd_level IS NULL) * 100.0 / nullif(count(*) FILTER (WHERE {said}), 0), 0), 6) AS miss_rate"""


@query("label_miss_rate", REVIEWS + f" {_miss_sql(fixed.CROWD_WORDS_COMPARE, 'Branch, ')} FROM reviews GROUP BY Branch")
def label_miss_rate(spark, sf):
    rates = compare.miss_rate(tables.reviews(spark, sf), "crowd_level", fixed.CROWD_WORDS_COMPARE, "Branch")
    return rounded(rates, "miss_rate")


@query("slice_miss_rate", SEASONED + f" {_miss_sql(fixed.CROWD_WORDS_SLICE, '')} FROM seasoned WHERE Branch = 'Disneyland_California' AND visit_month = 6")
def slice_miss_rate(spark, sf):
    from guestlens.operators.filters import park_month

    sliced = tables.reviews(spark, sf).filter(park_month("Disneyland_California", 6))
    return rounded(compare.miss_rate(sliced, "crowd_level", fixed.CROWD_WORDS_SLICE), "miss_rate")


# --- profiles -----------------------------------------------------------------------------

PROFILED = ["staff_sentiment", "price_sensitivity", "crowd_level", "topics", "sentiment_score"]


def _shown(c):
    return "CASE WHEN topics IS NOT NULL THEN concat('[', array_to_string(topics, ', '), ']') END" if c == "topics" else f"CAST({c} AS VARCHAR)"


@query("column_fill", REVIEWS + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS column_type, count({c}) AS filled FROM reviews"
    for c, t in zip(PROFILED, ["string", "string", "string", "array<string>", "int"])))
def column_fill(spark, sf):
    return profile.filled_counts(light_reviews(spark, sf))


@query("column_top_values", REVIEWS + ", v AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {_shown(c)} AS value FROM reviews" for c in PROFILED) + """),
 n AS (SELECT column_name, value, count(*) AS reviews FROM v WHERE value IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY reviews DESC, value) AS rank FROM n)
SELECT column_name, value, reviews, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5""")
def column_top_values(spark, sf):
    return as_bigint(profile.top_values(light_reviews(spark, sf)), "rank")


@query("enrichment_progress", REVIEWS + " SELECT count(*) AS total, count(sentiment_score) AS enriched, count(*) FILTER (WHERE sentiment_score IS NULL) AS remaining FROM reviews")
def enrichment_progress(spark, sf):
    return profile.progress(light_reviews(spark, sf))
