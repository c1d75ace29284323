"""Vector similarity in the JVM, summed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NO_NORM = 1e-9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def guarded_norm(a: Column) -> Column:
    length = norm(a)
    return F.when(length == 0, F.lit(NO_NORM)).otherwise(length)


def with_norm(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with the guarded length of a vector, worked out once before the vector is paired."""
    return rows.withColumn(f"{vector}_norm", guarded_norm(F.col(vector)))


def cosine_of_normed(a: str, b: str) -> Column:
    """Cosine of two vector columns whose lengths are there already."""
    return dot(F.col(a), F.col(b)) / (F.col(f"{a}_norm") * F.col(f"{b}_norm"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a vector of zeros has similarity 0.  Null if either vector is missing."""
    return dot(a, b) / (guarded_norm(a) * guarded_norm(b))
