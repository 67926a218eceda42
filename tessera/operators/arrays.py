"""Aggregates over array values: a partial sum and count per partition, then the final one, as Spark plans them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_count(df: DataFrame, column: str = "values") -> DataFrame:
    c = F.col(f"`{column}`")
    return df.agg(F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias("sum"), F.count(c).alias("count"))


def flatten(df: DataFrame, key: str, array: str, width: int) -> DataFrame:
    """Rows of arrays of one width, in order of a dense key from 0, as (pos, values)."""
    at = df.select(F.col(key).alias("_key"), F.posexplode(array).alias("_at", "values"))
    return at.select((F.col("_key") * width + F.col("_at")).cast("long").alias("pos"), "values")
