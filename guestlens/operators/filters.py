"""Predicates over reviews.  All are plain columns, so Spark pushes them towards the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from guestlens.fixed_values import SEASON_MONTHS
from guestlens.functions.calendar import Seasons, parks_of, visit_month
from guestlens.functions.lexicon import has_label


@dataclass(frozen=True)
class FilterSpec:
    """What one question asks for; None means no restriction."""

    topics: Sequence[str] | None = None
    sentiment_label: str | None = None
    is_complaint: bool | None = None
    crowd_level: str | None = None
    staff_sentiment: str | None = None
    price_sensitivity: str | None = None
    family_sentiment: str | None = None
    reviewer_location: str | None = None
    branch: str | None = None
    year_month: str | None = None
    month: int | None = None
    season: str | None = None
    unsupported_entity: str | None = None

    def is_empty(self) -> bool:
        return all(getattr(self, f.name) is None for f in fields(self))


def known_months(branch: str | None, season: str | None, seasons: Seasons = SEASON_MONTHS) -> list[int] | None:
    """Months of the season in the first park whose name contains ``branch``."""
    if not branch or not season:
        return None
    park = next((park for park in parks_of(seasons) if branch.lower() in park.lower()), None)
    return next((list(months) for of_park, name, months in seasons if (of_park, name) == (park, season.capitalize())), None)


@dataclass(frozen=True)
class Compared:
    """The columns that filters compare: worked out from the raw ones, or stored (see ``sources.enriched``)."""

    branch: Column
    location: Column
    month: Column


def raw_columns() -> Compared:
    return Compared(F.lower("Branch"), F.lower("Reviewer_Location"), visit_month(F.col("Year_Month")))


def stored_columns() -> Compared:
    """A filter on these is a partition filter or is pushed to the scan."""
    return Compared(F.col("branch_key"), F.col("location_key"), F.col("visit_month"))


def compared_columns(reviews: DataFrame) -> Compared:
    return stored_columns() if {"branch_key", "location_key", "visit_month"} <= set(reviews.columns) else raw_columns()


def in_season(
    branch: str | None, season: str | None, seasons: Seasons = SEASON_MONTHS, month: Column | None = None,
) -> Column | None:
    """Month within the season of the park; no restriction when park or season is unknown."""
    months = known_months(branch, season, seasons)
    return (visit_month(F.col("Year_Month")) if month is None else month).isin(months) if months else None


def same_text(column: str, wanted: str) -> Column:
    """Equal, ignoring case."""
    return F.lower(F.col(column)) == wanted.lower()


def in_month(month: int) -> Column:
    return visit_month(F.col("Year_Month")) == month


def has_topic(topics: Sequence[str]) -> Column:
    """One of the topics equals one of the row's topics, ignoring case."""
    wanted = F.array(*[F.lit(t.lower()) for t in topics])
    row = F.transform(F.col("topics"), F.lower)
    return F.coalesce(F.arrays_overlap(row, wanted), F.lit(False))


def predicates(spec: FilterSpec, columns: Compared | None = None) -> list[Column]:
    """The conditions of a specification; empty texts, lists and month 0 restrict nothing."""
    columns = columns or raw_columns()
    found: list[Column | None] = [in_season(spec.branch, spec.season, month=columns.month)]
    for name in ("sentiment_label", "crowd_level", "staff_sentiment", "price_sensitivity", "family_sentiment"):
        wanted = getattr(spec, name)
        found.append(F.col(name) == wanted if wanted else None)
    found.append(F.col("is_complaint") == spec.is_complaint if spec.is_complaint is not None else None)
    found.append(columns.location == spec.reviewer_location.lower() if spec.reviewer_location else None)
    found.append(columns.branch == spec.branch.lower() if spec.branch else None)
    found.append(F.col("Year_Month") == spec.year_month if spec.year_month else None)
    found.append(columns.month == spec.month if spec.month else None)
    found.append(has_topic(spec.topics) if spec.topics else None)
    return [p for p in found if p is not None]


def apply_filters(reviews: DataFrame, spec: FilterSpec) -> DataFrame:
    """Rows that meet all conditions.  A specification that sets nothing retrieves nothing.

    On the table of ``sources.enriched`` the stored columns are compared, else the raw ones.
    """
    if spec.is_empty():
        return reviews.filter(F.lit(False))
    found = predicates(spec, compared_columns(reviews))
    return reviews.filter(reduce(and_, found)) if found else reviews


def equal_to(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows equal to all the values; names that are no columns are ignored."""
    for name, value in wanted.items():
        if name in df.columns:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def branch_contains(part: str) -> Column:
    return F.coalesce(F.lower(F.col("Branch")).contains(part.lower()), F.lit(False))


def low_rating(highest: int = 2) -> Column:
    return F.col("Rating") <= highest


def label_present(name: str) -> Column:
    return F.coalesce(has_label(F.col(name)), F.lit(False))


def park_month(branch: str, month: int) -> Column:
    return (F.col("Branch") == branch) & (in_month(month))


def gate(value: Column, volume: Column, least: int = 30) -> Column:
    """The value where the volume is enough, else null."""
    return F.when(volume >= least, value)


def low_data(volume: Column, least: int = 30) -> Column:
    return volume < least
