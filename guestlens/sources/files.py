"""Review files: CSV in, Parquet in and out."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from guestlens.schema import RAW_REVIEW

log = logging.getLogger(__name__)

CURRENT_VERSION = "v4"
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def read_review_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_REVIEW,
                    encoding: str = "ISO-8859-1", multi_line: bool = True) -> DataFrame:
    """Review CSV with a header and quoted texts.

    Texts with line breaks need ``multi_line``, where Spark reads each file in one task, whatever its size: have large
    deliveries come as many files.
    """
    return (
        spark.read.schema(schema).options(**CSV_OPTIONS)
        .option("encoding", encoding).option("multiLine", multi_line).csv(path)
    )


def normalise_id(df: DataFrame, raw: str = "Review_ID", uid: str = "review_uid") -> DataFrame:
    """The identifier as text under its canonical name; frames without one stay as they are."""
    renamed = df.withColumnRenamed(raw, uid)
    return renamed.withColumn(uid, F.col(uid).cast("string")) if uid in renamed.columns else renamed


def surrogate_key(*columns: str) -> Column:
    """A key from the content, the same on every run.  Null differs from empty text.

    Rows with equal content get equal keys; add the file name and row number to tell copies apart.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def stage_path(root: str, stage: str, version: str = CURRENT_VERSION) -> str:
    return f"{root.rstrip('/')}/reviews_{stage}_{version}.parquet"


def enriched_path(root: str, version: str = CURRENT_VERSION) -> str:
    return stage_path(root, "enriched", version)


def read_if_present(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The Parquet table, or None with a logged error when the path does not exist."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except AnalysisException as failed:
        if failed.getCondition() != "PATH_NOT_FOUND":
            raise
        log.error("no table at %s", path)
        return None


def read_enriched(spark: SparkSession, root: str, version: str = CURRENT_VERSION) -> DataFrame | None:
    return read_if_present(spark, enriched_path(root, version))


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a stage table.  ``path`` must not be one the frame is read from."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
