"""Vector expressions on array<float> columns, evaluated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def sum_of(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def sum_of_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(sum_of_squares(v))


def with_unit_vector(df, col: str, out: str):
    """Add ``out`` = v / |v|; a zero vector stays as it is. The norm is its own step and computed once."""
    scale = F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(1.0)
    return (
        df.withColumn("_norm", norm(F.col(col)))
        .withColumn("_scale", scale)
        .withColumn(out, F.transform(F.col(col), lambda x: x.cast("double") / F.col("_scale")))
        .drop("_norm", "_scale")
    )
