"""Vector arithmetic on array columns, summed in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    apart = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)


def min_max(value: Column) -> Column:
    """Scaled to 0..1 over all rows; all equal: 1. For tables of clusters, which are small."""
    whole = Window.partitionBy()
    low, high = F.min(value).over(whole), F.max(value).over(whole)
    return F.when(high == low, F.lit(1.0)).otherwise((value - low) / (high - low))


def scaled(rows: DataFrame, value: str, name: str) -> DataFrame:
    """`rows` with `name`: as min_max, for tables of any size; the bounds are one row that every task gets."""
    bounds = rows.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    share = F.when(F.col("_high") == F.col("_low"), F.lit(1.0)).otherwise((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return rows.crossJoin(F.broadcast(bounds)).withColumn(name, share).drop("_low", "_high")
