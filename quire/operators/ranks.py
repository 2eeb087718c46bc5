"""Values at given ranks of groups of any size, by counting distinct values instead of gathering them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_ranks(rows: DataFrame, keys: list[str], value: str, **places: Callable[[Column], Column]) -> DataFrame:
    """(keys, n, one column for each of places): how many values a group has, and those at places(n) of their sorted row,
    from 0. Nulls are left out; groups without values have no row."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counted.withColumn("_upto", F.sum("_k").over(w)).withColumn("n", F.sum("_k").over(Window.partitionBy(*keys)))
    return summed.groupBy(*keys, "n").agg(*(F.min(F.when(F.col("_upto") > place(F.col("n")), F.col(value))).alias(name) for name, place in places.items()))
