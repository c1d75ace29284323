"""Queries: sources, derived columns and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from guestlens import fixed_values as fixed
from guestlens.functions import calendar, text, themes
from guestlens.operators import filters, insights, joins, ranking
from guestlens.registry.base import (
    ACTION_CASE, CELLS, FINDING_CASE, MONTH, MONTH_START, PARK, REVIEWS, SEASONED, THEMED, TRENDS, any_word, as_bigint,
    as_text, light_reviews, query, rounded,
)
from guestlens.plans import playbook
from guestlens.session import use_checkpoints
from guestlens.sources import enriched, files, paging, tables

UID = "CAST(review_uid AS BIGINT) AS review_uid"


# --- sources ------------------------------------------------------------------------------

@query("surrogate_key", REVIEWS + """
SELECT CAST(review_uid AS BIGINT) AS review_uid, sha256(concat_ws(chr(31), coalesce(CAST(Rating AS VARCHAR), chr(0)),
 coalesce(Year_Month, chr(0)), coalesce(Reviewer_Location, chr(0)), coalesce(Review_Text, chr(0)), coalesce(Branch, chr(0)))) AS row_key
FROM reviews""")
def surrogate_key(spark, sf):
    r = tables.reviews(spark, sf)
    return r.select("review_uid", files.surrogate_key(
        "Rating", "Year_Month", "Reviewer_Location", "Review_Text", "Branch").alias("row_key"))


@query("canonical_id", REVIEWS + " SELECT CAST(review_uid AS VARCHAR) AS review_uid, Rating::BIGINT AS Rating FROM reviews")
def canonical_id(spark, sf):
    raw = light_reviews(spark, sf).withColumnRenamed("review_uid", "Review_ID")
    return as_bigint(files.normalise_id(raw).select("review_uid", "Rating"), "Rating")


@query("column_peek", REVIEWS + f" SELECT {UID}, CAST(Rating AS BIGINT) AS Rating, Year_Month, Reviewer_Location, Branch FROM reviews ORDER BY review_uid LIMIT 5")
def column_peek(spark, sf):
    raw = light_reviews(spark, sf).select("review_uid", "Rating", "Year_Month", "Reviewer_Location", "Branch")
    return as_bigint(paging.peek(raw, key="review_uid"), "Rating")


@query("paged_reviews", REVIEWS + """
SELECT CAST(review_uid AS BIGINT) AS review_uid, CAST((row_number() OVER (ORDER BY review_uid) - 1) // 100 AS BIGINT) AS page,
 CAST(ceil(count(*) OVER () / 100) AS BIGINT) AS pages FROM reviews""")
def paged_reviews(spark, sf):
    return as_bigint(paging.with_pages(light_reviews(spark, sf).select("review_uid"), "review_uid"), "page", "pages")


@query("single_page", REVIEWS + """
SELECT CAST(review_uid AS BIGINT) AS review_uid, Branch, CAST(Rating AS BIGINT) AS Rating FROM reviews ORDER BY review_uid LIMIT 100 OFFSET 700""")
def single_page(spark, sf):
    rows = light_reviews(spark, sf).select("review_uid", "Branch", F.col("Rating").cast("bigint").alias("Rating"))
    return paging.page(rows, "review_uid", 7, rows_per_bucket=1_000)


# --- derived columns ----------------------------------------------------------------------

@query("visit_month", REVIEWS + f" SELECT {UID}, CAST({MONTH} AS BIGINT) AS visit_month FROM reviews")
def visit_month(spark, sf):
    return light_reviews(spark, sf).select("review_uid", calendar.visit_month(F.col("Year_Month")).cast("bigint").alias("visit_month"))


@query("visit_month_or_zero", REVIEWS + f" SELECT {UID}, CAST(coalesce({MONTH}, 0) AS BIGINT) AS visit_month FROM reviews")
def visit_month_or_zero(spark, sf):
    return light_reviews(spark, sf).select("review_uid", calendar.visit_month_or_zero(F.col("Year_Month")).cast("bigint").alias("visit_month"))


@query("month_start", REVIEWS + f" SELECT {UID}, CAST({MONTH_START} AS VARCHAR) AS month_start FROM reviews")
def month_start(spark, sf):
    return light_reviews(spark, sf).select("review_uid", calendar.month_start(F.col("Year_Month")).cast("string").alias("month_start"))


@query("season", SEASONED + f" SELECT {UID}, Branch, Year_Month, Season FROM seasoned")
def season(spark, sf):
    return insights.with_season(light_reviews(spark, sf)).select("review_uid", "Branch", "Year_Month", "Season")


@query("months_of_season", SEASONED + f"""
SELECT {UID}, array_to_string(CASE Season WHEN 'Spring' THEN [3,4,5] WHEN 'Summer' THEN [6,7,8] WHEN 'Autumn' THEN [9,10,11]
 WHEN 'Winter' THEN [12,1,2] END, '|') AS months FROM seasoned""")
def months_of_season(spark, sf):
    r = insights.with_season(light_reviews(spark, sf))
    months = calendar.months_of_season(F.lower("Branch"), F.upper("Season"))
    return r.select("review_uid", as_text(months.cast("array<string>")).alias("months"))


@query("review_themes", THEMED + f" SELECT {UID}, array_to_string(themes, '|') AS themes FROM themed")
def review_themes(spark, sf):
    return themes.with_themes(light_reviews(spark, sf)).select("review_uid", as_text("themes").alias("themes"))


@query("theme_rows", THEMED + f" SELECT {UID}, theme FROM exploded")
def theme_rows(spark, sf):
    return themes.explode_themes(light_reviews(spark, sf)).select("review_uid", "theme")


@query("park_name", REVIEWS + f" SELECT {UID}, {PARK} AS park, replace(Branch, '_', ' ') AS spaced FROM reviews")
def park_name(spark, sf):
    b = F.col("Branch")
    return light_reviews(spark, sf).select("review_uid", text.park_name(b).alias("park"), text.spaced(b).alias("spaced"))


@query("snippets", REVIEWS + f"""
SELECT {UID}, CASE WHEN length(Review_Text) > 300 THEN concat(substr(Review_Text, 1, 300), '...') ELSE Review_Text END AS long_snippet,
 concat(substr(Review_Text, 1, 150), '...') AS short_snippet, concat(substr(Review_Text, 1, 200), '...') AS missed_snippet FROM reviews""")
def snippets(spark, sf):
    t = F.col("Review_Text")
    return tables.reviews(spark, sf).select(
        "review_uid", text.snippet(t, 300).alias("long_snippet"),
        text.snippet(t, 150, always=True).alias("short_snippet"), text.snippet(t, 200, always=True).alias("missed_snippet"))


@query("theme_actions", THEMED + f" SELECT {UID}, theme, {ACTION_CASE} AS action, {FINDING_CASE} AS finding_action FROM exploded")
def theme_actions(spark, sf):
    t = F.col("theme")
    return themes.explode_themes(light_reviews(spark, sf)).select(
        "review_uid", "theme", text.action_for(t).alias("action"), text.finding_action_for(t).alias("finding_action"))


@query("issue_texts", TRENDS + """
SELECT Branch, Season, concat('High ', theme, ' friction') AS issue, concat(CAST(pct_negative AS VARCHAR), '% negative') AS evidence_metric FROM trends""")
def issue_texts(spark, sf):
    return playbook.playbook_trends(light_reviews(spark, sf)).select(
        "Branch", "Season", text.issue_text(F.col("theme")).alias("issue"), text.evidence_text(F.col("pct_negative")).alias("evidence_metric"))


@query("crowd_mentions", REVIEWS + f"""
SELECT {UID}, {any_word('Review_Text', fixed.CROWD_WORDS_SLICE)} AS in_slice_list, {any_word('Review_Text', fixed.CROWD_WORDS_COMPARE)} AS in_compare_list,
 {any_word('Review_Text', fixed.CROWD_WORDS_EXPLORE)} AS in_explore_list FROM reviews""")
def crowd_mentions(spark, sf):
    t = F.col("Review_Text")
    return tables.reviews(spark, sf).select(
        "review_uid", text.mentions(t, fixed.CROWD_WORDS_SLICE).alias("in_slice_list"),
        text.mentions(t, fixed.CROWD_WORDS_COMPARE).alias("in_compare_list"),
        text.mentions(t, fixed.CROWD_WORDS_EXPLORE).alias("in_explore_list"))


@query("quotable_texts", REVIEWS + f" SELECT {UID}, length(Review_Text) BETWEEN 40 AND 300 AS quotable FROM reviews")
def quotable_texts(spark, sf):
    return tables.reviews(spark, sf).select("review_uid", text.quotable(F.col("Review_Text")).alias("quotable"))


# --- filters ------------------------------------------------------------------------------

def _filtered(name: str, spec: filters.FilterSpec, condition: str) -> None:
    @query(name, REVIEWS + f" SELECT {UID} FROM reviews WHERE {condition}")
    def run(spark, sf):
        return filters.apply_filters(light_reviews(spark, sf), spec).select("review_uid")


Spec = filters.FilterSpec
_filtered("filter_season", Spec(branch="Disneyland_Paris", season="spring"), f"Branch = 'Disneyland_Paris' AND {MONTH} IN (3,4,5)")
_filtered("filter_season_unknown_park", Spec(season="Autumn", sentiment_label="Positive"), "sentiment_label = 'Positive'")
_filtered("filter_sentiment", Spec(sentiment_label="Negative"), "sentiment_label = 'Negative'")
_filtered("filter_complaint", Spec(is_complaint=False), "is_complaint = false")
_filtered("filter_crowd", Spec(crowd_level="Crowded"), "crowd_level = 'Crowded'")
_filtered("filter_staff", Spec(staff_sentiment="Rude"), "staff_sentiment = 'Rude'")
_filtered("filter_price", Spec(price_sensitivity="Rip-off"), "price_sensitivity = 'Rip-off'")
_filtered("filter_family", Spec(family_sentiment="Joyful"), "family_sentiment = 'Joyful'")
_filtered("filter_location", Spec(reviewer_location="nation_3"), "lower(Reviewer_Location) = 'nation_3'")
_filtered("filter_branch", Spec(branch="disneyland_PARIS"), "lower(Branch) = 'disneyland_paris'")
_filtered("filter_year_month", Spec(year_month="1995-3"), "Year_Month = '1995-3'")
_filtered("filter_month", Spec(month=6), f"{MONTH} = 6")
_filtered("filter_topics", Spec(topics=["food", "CROWDS"]), "list_has_any(list_transform(topics, lambda t: lower(t)), ['food', 'crowds'])")
_filtered("filter_combined", Spec(branch="Disneyland_California", month=6, topics=["Rides"], is_complaint=True),
          f"lower(Branch) = 'disneyland_california' AND {MONTH} = 6 AND list_contains(list_transform(topics, lambda t: lower(t)), 'rides') AND is_complaint")
_filtered("filter_nothing_set", Spec(), "false")


@query("filter_laid_out", SEASONED + f""" SELECT {UID}, Branch, Season, CAST(visit_month AS BIGINT) AS visit_month FROM seasoned
WHERE lower(Branch) = 'disneyland_paris' AND visit_month IN (3,4,5) AND lower(Reviewer_Location) = 'nation_3'""")
def filter_laid_out(spark, sf):
    """The same filters on the table with a folder for each park and stored keys."""
    path = f"{use_checkpoints(spark).rstrip('/')}/enriched-{uuid.uuid4().hex}"
    enriched.write_enriched(light_reviews(spark, sf), path)
    wanted = Spec(branch="Disneyland_PARIS", season="spring", reviewer_location="Nation_3")
    found = filters.apply_filters(enriched.read_laid_out(spark, path), wanted)
    return as_bigint(found.select("review_uid", "Branch", "Season", "visit_month"), "visit_month")


@query("filter_equal_map", REVIEWS + f" SELECT {UID} FROM reviews WHERE crowd_level = 'Crowded' AND Branch = 'Disneyland_Paris'")
def filter_equal_map(spark, sf):
    wanted = {"crowd_level": "Crowded", "Branch": "Disneyland_Paris", "no_such_column": 1}
    return filters.equal_to(light_reviews(spark, sf), wanted).select("review_uid")


@query("filter_branch_contains", REVIEWS + f" SELECT {UID}, Branch FROM reviews WHERE contains(lower(Branch), 'disney')")
def filter_branch_contains(spark, sf):
    return light_reviews(spark, sf).filter(filters.branch_contains("disney")).select("review_uid", "Branch")


@query("filter_low_ratings", REVIEWS + f" SELECT {UID}, CAST(Rating AS BIGINT) AS Rating FROM reviews WHERE Rating <= 2")
def filter_low_ratings(spark, sf):
    return as_bigint(light_reviews(spark, sf).filter(filters.low_rating()).select("review_uid", "Rating"), "Rating")


@query("filter_label_present", REVIEWS + f" SELECT {UID}, staff_sentiment FROM reviews WHERE staff_sentiment <> 'None'")
def filter_label_present(spark, sf):
    return light_reviews(spark, sf).filter(filters.label_present("staff_sentiment")).select("review_uid", "staff_sentiment")


@query("filter_work_keys", REVIEWS + f" SELECT {UID}, Branch FROM reviews WHERE review_uid IN (SELECT review_uid FROM reviews WHERE sentiment_score IS NULL)")
def filter_work_keys(spark, sf):
    r = light_reviews(spark, sf)
    todo = r.filter(F.col("sentiment_score").isNull())
    return joins.with_keys(r, todo).select("review_uid", "Branch")


@query("filter_park_month", SEASONED + f" SELECT {UID}, Year_Month FROM seasoned WHERE Branch = 'Disneyland_California' AND visit_month = 6")
def filter_park_month(spark, sf):
    return light_reviews(spark, sf).filter(filters.park_month("Disneyland_California", 6)).select("review_uid", "Year_Month")


@query("volume_gate", CELLS + """
SELECT Branch, Season, theme, CAST(volume AS BIGINT) AS volume, round(CASE WHEN volume >= 30 THEN mean_sentiment END, 6) AS gated_mean,
 volume < 30 AS low_data_flag FROM cells""")
def volume_gate(spark, sf):
    cells = insights.grouped_cells(insights.theme_cells(light_reviews(spark, sf))).groupBy(*insights.CELL).agg(
        F.sum("n").alias("volume"), insights.weighted_mean("sentiment_score", "rows").alias("mean"))
    gated = cells.select(*insights.CELL, "volume", filters.gate(F.col("mean"), F.col("volume")).alias("gated_mean"),
                         filters.low_data(F.col("volume")).alias("low_data_flag"))
    return rounded(gated, "gated_mean")


# --- order and limits ---------------------------------------------------------------------

@query("batch_split", REVIEWS + f"""
, todo AS (SELECT review_uid, row_number() OVER (ORDER BY review_uid) - 1 AS pos, count(*) OVER () AS n FROM reviews WHERE sentiment_score IS NULL),
 sized AS (SELECT *, greatest(1, n // 50) AS k FROM todo), cut AS (SELECT *, n // k AS q, n % k AS r FROM sized)
SELECT {UID}, CAST(CASE WHEN pos < r * (q + 1) THEN pos // (q + 1) ELSE r + (pos - r * (q + 1)) // q END AS BIGINT) AS batch_id FROM cut""")
def batch_split(spark, sf):
    todo = light_reviews(spark, sf).filter(F.col("sentiment_score").isNull()).select("review_uid")
    return ranking.even_batches(todo, "review_uid", 50)


@query("first_batches", REVIEWS + f"""
, todo AS (SELECT review_uid, row_number() OVER (ORDER BY review_uid) - 1 AS pos, count(*) OVER () AS n FROM reviews WHERE sentiment_score IS NULL),
 sized AS (SELECT *, greatest(1, n // 50) AS k FROM todo), cut AS (SELECT *, n // k AS q, n % k AS r FROM sized)
SELECT {UID} FROM cut WHERE CASE WHEN pos < r * (q + 1) THEN pos // (q + 1) ELSE r + (pos - r * (q + 1)) // q END < 3""")
def first_batches(spark, sf):
    from guestlens.plans.enrichment import first_batches as limited

    todo = light_reviews(spark, sf).filter(F.col("sentiment_score").isNull()).select("review_uid")
    return limited(todo, "review_uid", 50, 3)


@query("chunk_plan", REVIEWS + f" SELECT {UID}, CAST((row_number() OVER (ORDER BY review_uid) - 1) // 100 AS BIGINT) AS chunk_id FROM reviews")
def chunk_plan(spark, sf):
    return as_bigint(ranking.chunks(light_reviews(spark, sf).select("review_uid"), "review_uid", 100), "chunk_id")


@query("head_rows", REVIEWS + f" SELECT {UID}, Branch, Year_Month FROM reviews ORDER BY review_uid LIMIT 50")
def head_rows(spark, sf):
    return ranking.head(light_reviews(spark, sf).select("review_uid", "Branch", "Year_Month"), "review_uid", 50)


@query("evidence_sample", REVIEWS + f"""
SELECT {UID}, CAST(Rating AS BIGINT) AS Rating, CASE WHEN length(Review_Text) > 300 THEN concat(substr(Review_Text, 1, 300), '...') ELSE Review_Text END AS quote
FROM reviews WHERE crowd_level = 'Crowded' AND Branch = 'Disneyland_Paris' ORDER BY md5(concat('0|', CAST(review_uid AS VARCHAR))), review_uid LIMIT 3""")
def evidence_sample(spark, sf):
    wanted = filters.equal_to(tables.reviews(spark, sf), {"crowd_level": "Crowded", "Branch": "Disneyland_Paris"})
    sample = ranking.repeatable_sample(wanted, "review_uid", 3)
    quote = text.snippet(F.col("Review_Text"), 300).alias("quote")
    return as_bigint(sample.select("review_uid", "Rating", quote), "Rating")
