"""Month and season of a review.  ``Year_Month`` is text such as ``2019-4`` and may be junk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from guestlens.fixed_values import SEASON_MONTHS

# Park, season, months: any number of seasons of any length, broken spans too.
Seasons = Sequence[tuple[str, str, Sequence[int]]]


def visit_month(year_month: Column) -> Column:
    """The number after the first dash; null when there is none.  No range check: 13 stays 13."""
    return F.try_element_at(F.split(year_month, "-"), F.lit(2)).try_cast("int")


def visit_month_or_zero(year_month: Column) -> Column:
    return F.coalesce(visit_month(year_month), F.lit(0))


def month_start(year_month: Column) -> Column:
    """First day of the month as a date; null when the text is not a month."""
    return F.try_to_date(year_month, "yyyy-M")


def parks_of(seasons: Seasons) -> list[str]:
    """The parks of a season table, in its order."""
    return list(dict.fromkeys(park for park, _, _ in seasons))


def _of_park(branch: Column, seasons: Seasons, value) -> Column:
    """``value(seasons of the park)`` for the first park whose name contains ``branch``, ignoring case.

    The cases stand in the order of the table; neighbouring parks with equal seasons share one.
    """
    wanted = F.lower(branch)
    cases: list[tuple[Column, list[tuple[str, Sequence[int]]]]] = []
    for park in parks_of(seasons):
        own = [(name, months) for of_park, name, months in seasons if of_park == park]
        named = F.lit(park.lower()).contains(wanted)
        if cases and cases[-1][1] == own:
            cases[-1] = (cases[-1][0] | named, own)
        else:
            cases.append((named, own))
    out = F.when(F.lit(False), value(cases[0][1])) if cases else F.lit(None)
    for named, own in cases:
        out = out.when(named, value(own))
    return out


def season(branch: Column, year_month: Column, seasons: Seasons = SEASON_MONTHS) -> Column:
    """Season of a visit, from the park's own calendar; null for an unknown park or month."""
    month = visit_month(year_month)

    def name_of(own: Sequence[tuple[str, Sequence[int]]]) -> Column:
        by_month = {month: name for name, months in reversed(own) for month in months}
        last = max(by_month, default=0)
        return F.get(F.array(*[F.lit(by_month.get(m)).cast("string") for m in range(1, last + 1)]), month - 1)

    return _of_park(branch, seasons, name_of)


def months_of_season(branch: Column, season_name: Column, seasons: Seasons = SEASON_MONTHS) -> Column:
    """Months of a season in a park; null when either is empty or unknown."""
    wanted = F.initcap(F.lower(season_name))

    def months_of(own: Sequence[tuple[str, Sequence[int]]]) -> Column:
        out = F.when(F.lit(False), F.array(F.lit(0)))
        for name, months in own:
            out = out.when(wanted == name, F.lit(list(months)))
        return out

    return F.when(F.length(branch) > 0, _of_park(branch, seasons, months_of))
