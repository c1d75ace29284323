"""All insight tables of a report in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame

from guestlens.operators import insights
from guestlens.plans import playbook
from guestlens.session import use_checkpoints


def report_tables(reviews: DataFrame) -> dict[str, DataFrame]:
    """Insights, playbook, narrative and findings by name.

    The theme cells serve five of the tables; they are small and are written to the checkpoint folder
    once, so the reviews are read once for all five.
    """
    use_checkpoints(reviews.sparkSession)
    cells = insights.theme_cells(reviews).checkpoint()
    heatmap = insights.heatmap_from_cells(cells)
    issues = playbook.cx_playbook(reviews, cells=cells).checkpoint()
    return {
        "theme_season_heatmap": heatmap,
        "sentiment_pivot": insights.season_pivot(heatmap, "median_sentiment"),
        "volume_pivot": insights.season_pivot(heatmap, "volume"),
        "low_rating_drivers": insights.low_rating_drivers(reviews),
        "seasonality": insights.monthly_seasonality(reviews),
        "country_sentiment": insights.country_sentiment(reviews),
        "staff_impact": insights.staff_impact(reviews),
        "crowd_impact": insights.crowd_impact(reviews),
        "playbook": issues,
        "narrative": playbook.narrative(issues),
        "findings": playbook.findings_from_cells(cells),
    }
