"""Parts that several operators use: tables, stored intermediate results, Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from guestlens.session import use_checkpoints

#: Rows that go to Python at a time.  Spark's default of 10,000 texts can be gigabytes where texts are long.
ROWS_PER_BATCH = "1000"
#: Rows of an Arrow batch that a Python operator works on at a time; bounds what it holds besides the batch itself.
ROWS_PER_SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back: lineage is cut, columns stay prunable.

    The folder of the run is ``<checkpoint folder>/tables``; whoever owns the application may delete it when the
    results that were made from it are written.
    """
    spark = df.sparkSession
    path = f"{use_checkpoints(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def to_python(df: DataFrame, work: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of few rows; the setting is the session's and stays for its later queries."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return df.mapInArrow(work, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_SLICE) -> Iterator[pa.RecordBatch]:
    """Short pieces of Arrow batches, without copying."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Pieces of Arrow batches with at most ``most`` bytes of text in ``column``; a longer text is a piece of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
