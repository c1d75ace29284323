"""A store of results by key, in buckets: upserts and joins read it where it lies.

Rows go to one of a fixed number of buckets by a hash of the key, and files are sorted by key, so Spark groups and
joins the store by key without shuffling it.  Appending writes only the new rows.  Compaction keeps the last row of each
key and writes the next version beside the present one; readers turn to it when it is complete.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from guestlens.operators.joins import last_per_key

BUCKETS = 64
DONE = "_SUCCESS"
# Keys that are put into a plan as literals, so that Spark can leave out buckets.
LISTED_KEYS = 10_000


class BucketedStore:
    """The store under ``root``, which all executors share; the newest complete version counts.

    ``order`` names the columns whose greatest values mark the last row of a key; of rows equal in them the greatest
    row counts.  A key is never null.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, order: Sequence[str], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.schema, self.key, self.order, self.buckets = spark, root.rstrip("/"), schema, key, tuple(order), buckets

    def _folder(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest complete version; 0 before the first row."""
        at, files = self._folder(self.root)
        if not files.exists(at):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(at)]
        numbers = sorted((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), reverse=True)
        return next((n for n in numbers if files.exists(self._folder(f"{self.root}/v{n}/{DONE}")[0])), 0)

    def _table(self, version: int) -> str:
        """A session table over the files of a version: the catalog tells Spark of the buckets."""
        name = f"store_{table_name(self.root)}_v{version}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.root}/v{version}'"
            )
        return name

    def _write(self, rows: DataFrame, version: int) -> None:
        spread = rows.filter(F.col(self.key).isNotNull()).select(*self.schema.fieldNames()).repartition(self.buckets, self.key)
        spread.write.insertInto(self._table(version))

    def append(self, rows: DataFrame) -> None:
        """Add rows to the present version.  ``rows`` may be read from the store."""
        self._write(rows, max(1, self.version()))

    def read(self) -> DataFrame:
        """All rows, repeated keys too.  Another session, as a stream's batches have one, may have written meanwhile."""
        name = self._table(max(1, self.version()))
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def of_keys(self, keys: DataFrame, most: int = LISTED_KEYS) -> DataFrame:
        """The rows of the keys in ``keys``.  Of up to ``most`` keys only the buckets that hold them are read."""
        listed = keys.select(self.key).distinct().limit(most + 1).collect()
        if len(listed) > most:
            return self.read().join(keys.select(self.key), self.key, "left_semi")
        return self.read().filter(F.col(self.key).isin([r[0] for r in listed if r[0] is not None]))

    def latest(self) -> DataFrame:
        """The last row of each key.  The store is grouped in its buckets, without a shuffle."""
        names = [n for n in self.schema.fieldNames() if n != self.key]
        return last_per_key(self.read(), self.key, self._last(), names).select(*self.schema.fieldNames())

    def _last(self) -> Column:
        return F.struct(*self.order, *[n for n in self.schema.fieldNames() if n not in (self.key, *self.order)])

    def compact(self) -> int:
        """Write the last row of each key as the next version, and return its number.

        A version that is broken off has no mark of completeness and is never read; the next attempt replaces its files.
        """
        now = self.version()
        if not now:
            return 0
        rows, after = self.latest(), now + 1
        at, files = self._folder(f"{self.root}/v{after}")
        files.delete(at, True)
        self._write(rows, after)
        return after


def table_name(root: str) -> str:
    """A table name for a path."""
    return md5(root.encode()).hexdigest()[:16]
