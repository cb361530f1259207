"""Substrings of a given total mass: pairs of running sums that differ by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mass_search(items: DataFrame, key: str, order: str, mass: str, target) -> DataFrame:
    """Rows (key, first, last): runs of items, by `order` inside each key, whose mass adds up to `target`.

    A run's mass is the difference of two running sums, so an equi-join finds all runs; items weigh more than 0.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = items.select(key, order, F.col(mass).alias("__m"), F.sum(mass).over(w).alias("__upto"))
    begins = sums.select(key, F.col(order).alias("first"), (F.col("__upto") - F.col("__m") + F.lit(target)).alias("__sum"))
    return begins.join(sums.select(key, F.col(order).alias("last"), F.col("__upto").alias("__sum")), [key, "__sum"]).select(key, "first", "last")
