"""The register, and the common parts of the check SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from guestlens import fixed_values as fixed
from guestlens.sources import tables

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query over the test tables with the SQL that must give the same rows."""

    def register(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(run, sql)
        return run

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def as_bigint(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def as_text(array: str | Column) -> Column:
    return F.array_join(array, "|")


def light_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.reviews(spark, sf_dir, text=False)


# --- parts of the check SQL -----------------------------------------------------------------

def any_word(text: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def pattern_hit(text: str, patterns: Iterable[str]) -> str:
    """Keyword patterns with the word boundary spelled out: the engines' own boundaries differ on accents."""
    bare = "|".join(p.replace("\\b", "") for p in patterns)
    return f"regexp_matches(lower({text}), '(^|[^\\p{{L}}\\p{{N}}_])({bare})([^\\p{{L}}\\p{{N}}_]|$)')"


def labels_of(field: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for of_field, label, pattern in fixed.LEXICON:
        if of_field == field:
            out.setdefault(label, []).append(pattern)
    return out


def keyword_case(field: str, text: str = "Review_Text") -> str:
    whens = " ".join(f"WHEN {pattern_hit(text, p)} THEN '{label}'" for label, p in labels_of(field).items())
    return f"CASE WHEN {field} IS NOT NULL AND {field} <> 'None' THEN {field} {whens} END"


TOPIC_CASE = "CASE " + " ".join(f"WHEN {any_word('t', w)} THEN '{n}'" for n, w in fixed.THEME_WORDS) + " END"
MONTH = "TRY_CAST(split_part(Year_Month, '-', 2) AS INTEGER)"
MONTH_START = "CAST(TRY_STRPTIME(Year_Month, '%Y-%m') AS DATE)"
SEASON = (
    f"CASE WHEN Branch IS NULL THEN NULL WHEN {MONTH} IN (3,4,5) THEN 'Spring' WHEN {MONTH} IN (6,7,8) THEN 'Summer' "
    f"WHEN {MONTH} IN (9,10,11) THEN 'Autumn' WHEN {MONTH} IN (12,1,2) THEN 'Winter' END"
)
THEMES = f"""list_sort(list_distinct(list_filter(list_concat(
  list_transform(coalesce(topics, []), lambda t: {TOPIC_CASE}),
  [CASE WHEN {any_word('crowd_level', fixed.CROWDED_WORDS)} THEN 'Queue/Crowd' END,
   CASE WHEN {any_word('price_sensitivity', fixed.COSTLY_WORDS)} THEN 'Price' END,
   CASE WHEN lower(staff_sentiment) NOT IN ('', 'none', 'nan') THEN 'Staff' END]), lambda x: x IS NOT NULL)))"""
PARK = "replace(replace(Branch, 'Disneyland_', ''), '_', ' ')"

REVIEWS = f"WITH reviews AS ({tables.REVIEWS_SQL})"
SEASONED = f"{REVIEWS}, seasoned AS (SELECT *, {MONTH} AS visit_month, {SEASON} AS Season FROM reviews)"
THEMED = (
    f"{SEASONED}, themed AS (SELECT *, {THEMES} AS themes FROM seasoned), "
    "exploded AS (SELECT *, unnest(themes) AS theme FROM themed)"
)
CELLS = f"""{THEMED}, cells AS (
  SELECT Branch, Season, theme, count(review_uid) AS volume, median(sentiment_score) AS median_sentiment,
   avg(sentiment_score) AS mean_sentiment, count(*) FILTER (WHERE sentiment_label = 'Negative') AS neg_count
  FROM exploded WHERE Branch IS NOT NULL AND Season IS NOT NULL GROUP BY Branch, Season, theme)"""
ACTION_CASE = "CASE theme " + " ".join(f"WHEN '{t}' THEN '{a}'" for t, a in fixed.ACTIONS.items()) + f" ELSE '{fixed.DEFAULT_ACTION}' END"
FINDING_CASE = "CASE theme " + " ".join(f"WHEN '{t}' THEN '{a}'" for t, a in fixed.FINDING_ACTIONS.items()) + f" ELSE '{fixed.DEFAULT_FINDING_ACTION}' END"
TRENDS = f"""{CELLS}, baseline AS (
  SELECT Branch, theme, avg(sentiment_score) AS baseline_severity FROM exploded WHERE Branch IS NOT NULL GROUP BY Branch, theme),
 trends AS (
  SELECT c.*, round_even(CAST(c.neg_count AS DOUBLE) / c.volume * 100 * 10, 0) / 10 AS pct_negative, b.baseline_severity,
   c.median_sentiment - b.baseline_severity AS delta,
   CASE WHEN c.median_sentiment - b.baseline_severity < -0.2 THEN '{fixed.TREND_WORSE}'
        WHEN c.median_sentiment - b.baseline_severity > 0.2 THEN '{fixed.TREND_BETTER}' ELSE '{fixed.TREND_SAME}' END AS trend
  FROM cells c LEFT JOIN baseline b ON b.Branch = c.Branch AND b.theme = c.theme WHERE c.volume >= 30)"""
ISSUES = f"""{TRENDS}, issues AS (
  SELECT * FROM trends ORDER BY median_sentiment ASC NULLS LAST, volume DESC, Branch, Season, theme LIMIT 15)"""
QUOTES = f"""negatives AS (SELECT Branch, Season, theme, review_uid, Review_Text,
   length(Review_Text) BETWEEN 40 AND 300 AS quotable FROM exploded
   WHERE sentiment_label = 'Negative' AND Branch IS NOT NULL AND Season IS NOT NULL),
 quotes AS (SELECT Branch, Season, theme, coalesce(min_by(Review_Text, review_uid) FILTER (WHERE quotable),
   min_by(substr(Review_Text, 1, 150) || '...', review_uid)) AS quote FROM negatives GROUP BY Branch, Season, theme)"""
PLAYBOOK = f"""{ISSUES}, {QUOTES}, playbook AS (
  SELECT {PARK.replace('Branch', 'i.Branch')} AS park, concat('High ', i.theme, ' friction') AS issue, i.theme,
   i.median_sentiment AS severity, i.baseline_severity, i.delta AS delta_vs_baseline, i.trend,
   concat(CAST(i.pct_negative AS VARCHAR), '% negative') AS evidence_metric, i.Season AS season,
   {ACTION_CASE.replace('CASE theme', 'CASE i.theme')} AS recommended_action, i.volume AS vol, false AS low_data_flag,
   coalesce(q.quote, '{fixed.NO_QUOTE}') AS representative_quote
  FROM issues i LEFT JOIN quotes q ON q.Branch = i.Branch AND q.Season = i.Season AND q.theme = i.theme)"""
