"""Aggregates of metric cells, and the local outlier cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_int(x: Column) -> Column:
    """Mean of whole numbers or seconds, cut toward zero; null for an empty cell."""
    return (F.sum(x) / F.count(x)).cast("bigint")


def share(predicate: Column) -> Column:
    """Share of samples (non-null) that pass; 0 for an empty cell."""
    return F.coalesce(F.round(F.avg(F.when(predicate, 1.0).when(predicate.isNotNull(), 0.0)), 9), F.lit(0.0))


def strict_greatest(a: Column, b: Column) -> Column:
    """The greater of both, null if either is (``greatest`` skips nulls)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def confidence_score(value: Column, low: Column, high: Column) -> Column:
    """100 less the width of the interval in percent of the value, not below 0; 100 if all are zero, 0 if the value is."""
    return F.when((value == 0) & (low == 0) & (high == 0), 100).when(value == 0, 0).otherwise(100 - F.least(100 * (high - low) / value, F.lit(100)).cast("int"))


def cut_outliers(facts: DataFrame, groups: list[str], time: str, sample: str, low: float, high: float, stride_days: int = 60) -> DataFrame:
    """Drop samples outside the nearest-rank quantiles of their group and cell; cells of ``stride_days`` start at Monday 2000-01-03."""
    cell = F.floor((F.col(time) - 946857600) / (stride_days * 86400))
    own = [*groups, "tw_cell"]
    n = F.count("*").over(Window.partitionBy(*own))
    row = F.row_number().over(Window.partitionBy(*own).orderBy(sample)) - 1
    ranked = facts.where(F.col(sample).isNotNull() & F.col(time).isNotNull()).withColumn("tw_cell", cell).withColumn("tw_n", n).withColumn("tw_row", row)
    bound = lambda q: F.max(F.when(F.col("tw_row") == F.rint((F.col("tw_n") - 1) * q).cast("bigint"), F.col(sample))).over(Window.partitionBy(*own))
    return ranked.withColumn("tw_lo", bound(low)).withColumn("tw_hi", bound(high)).where(f"{sample} >= tw_lo and {sample} <= tw_hi").drop("tw_cell", "tw_n", "tw_row", "tw_lo", "tw_hi")
