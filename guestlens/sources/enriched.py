"""The enriched table laid out for its filters: a folder for each park, stored keys for what filters compare.

Filters ignore case and look into the month text; on the raw columns that cannot reach the scan.  Here a park's rows
lie in a folder of their own under its lower-case name, in the order of their month, so that a filter on the park reads
one folder and one on the month skips row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from guestlens.functions.calendar import visit_month
from guestlens.operators.insights import with_season
from guestlens.sources.files import write_stage

BRANCH_KEY, LOCATION_KEY, MONTH_KEY = "branch_key", "location_key", "visit_month"


def with_filter_keys(reviews: DataFrame) -> DataFrame:
    """Season and the stored keys: lower-case park and country, month as a number."""
    return with_season(reviews).withColumns({
        BRANCH_KEY: F.lower("Branch"), LOCATION_KEY: F.lower("Reviewer_Location"), MONTH_KEY: visit_month(F.col("Year_Month")),
    })


def has_filter_keys(reviews: DataFrame) -> bool:
    return {BRANCH_KEY, LOCATION_KEY, MONTH_KEY} <= set(reviews.columns)


def write_enriched(reviews: DataFrame, path: str) -> None:
    """Replace the table.  Rows are rebalanced by park: Spark cuts a large park into many files and joins small ones."""
    keyed = with_filter_keys(reviews).hint("rebalance", BRANCH_KEY)
    write_stage(keyed.sortWithinPartitions(BRANCH_KEY, MONTH_KEY), path, [BRANCH_KEY])


def read_laid_out(spark: SparkSession, path: str) -> DataFrame:
    """The table with its park folders as text, whatever they look like."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name == BRANCH_KEY else f for f in found.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)
