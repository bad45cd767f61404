"""Time intervals and the binning of facts."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def split(granularity: str, first: dt.date, last: dt.date) -> list[dt.date]:
    """Boundaries of ``all`` or ``[N ][aligned ]day|week|month|year`` from first to last; the closing one is the day after last."""
    end = last + dt.timedelta(days=1)
    if granularity == "all":
        return [first, end]
    n, aligned, unit = re.fullmatch(r"(?:(\d+) )?(aligned )?(day|week|month|year)", granularity).groups()
    step = int(n or 1)

    def move(d: dt.date, k: int) -> dt.date:
        if unit in ("day", "week"):
            return d + dt.timedelta(days=k * (7 if unit == "week" else 1))
        months = d.year * 12 + d.month - 1 + k * (12 if unit == "year" else 1)
        year, month = divmod(months, 12)
        days = ((dt.date(year + month // 11, (month + 1) % 12 + 1, 1)) - dt.timedelta(days=1)).day
        return dt.date(year, month + 1, min(d.day, days))

    start = first
    if aligned:
        start = first - dt.timedelta(days=first.weekday()) if unit == "week" else first.replace(day=1) if unit == "month" else first.replace(month=1, day=1) if unit == "year" else first
    out, k = [first], 1
    while (d := move(start, k * step)) < end:
        if d > first:
            out.append(d)
        k += 1
    return [*out, end]


def seconds(d: dt.date) -> int:
    return int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.UTC).timestamp())


def interval_rows(bounds: list[dt.date]) -> list[tuple[int, int, int]]:
    return [(k, seconds(a), seconds(b)) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


def intervals(spark: SparkSession, bounds: list[dt.date]) -> DataFrame:
    """(idx, ts_from, ts_to): as many rows as the caller asked for, so it may be broadcast."""
    return spark.createDataFrame(interval_rows(bounds), "idx int, ts_from long, ts_to long")


def bucket(time: Column, marks: list[int]) -> Column:
    """Place of the interval [marks[i], marks[i + 1]) that holds ``time``, by a tree of comparisons; null outside."""

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(time < marks[mid], tree(lo, mid)).otherwise(tree(mid, hi))

    return F.when((time >= marks[0]) & (time < marks[-1]), tree(0, len(marks) - 1))


def binned(facts: DataFrame, bounds: list[dt.date], time: str) -> DataFrame:
    """Facts with ``idx``, ``ts_from`` and ``ts_to`` of the interval that holds their event time; facts without one go. No join."""
    marks = [seconds(d) for d in bounds]
    at = F.array(*[F.lit(m) for m in marks])
    # The time is a column of its own, as the tree names it at every comparison, and the filter is on it, not on the tree.
    rows = facts.withColumn("tw_at", F.expr(time).cast("bigint")).where((F.col("tw_at") >= marks[0]) & (F.col("tw_at") < marks[-1])).withColumn("idx", bucket(F.col("tw_at"), marks)).drop("tw_at")
    return rows.withColumn("ts_from", F.element_at(at, F.col("idx") + 1)).withColumn("ts_to", F.element_at(at, F.col("idx") + 2))


def _span(facts: DataFrame, bounds: list[dt.date], begin: str, end: str) -> DataFrame:
    """``facts`` with the first and last interval, ``lo`` and ``hi``, of those from ``begin`` to ``end`` (null: still open); ``hi`` may lie before ``lo``."""
    marks = [seconds(d) for d in bounds]
    rows = facts.withColumn("tw_from", F.expr(begin).cast("bigint")).withColumn("tw_to", F.expr(end).cast("bigint"))
    a, b = F.greatest(F.col("tw_from"), F.lit(marks[0])), F.coalesce(F.least(F.col("tw_to"), F.lit(marks[-1] - 1)), F.lit(marks[-1] - 1))
    rows = rows.where((F.col("tw_from") < marks[-1]) & (F.col("tw_to").isNull() | (F.col("tw_to") >= marks[0])))
    known = F.array(*[F.lit(m) for m in marks])
    # A few steps a row, as two trees of comparisons are too much code for one stage; the time is worked out once, as the element of an array.
    place = lambda t: F.element_at(F.transform(F.array(t), lambda x: F.size(F.filter(known, lambda m: m <= x)) - 1), 1)
    return rows.withColumn("lo", place(a)).withColumn("hi", place(b)).drop("tw_from", "tw_to")


def spread(facts: DataFrame, bounds: list[dt.date], begin: str, end: str) -> DataFrame:
    """A row of ``facts`` for each interval from the one that holds ``begin`` to the one that holds ``end`` (null: still open), with ``idx``."""
    rows = _span(facts, bounds, begin, end)
    return rows.withColumn("idx", F.explode(F.when(F.col("lo") <= F.col("hi"), F.sequence("lo", "hi")))).drop("lo", "hi")


def alive_sums(facts: DataFrame, bounds: list[dt.date], begin: str, end: str, groups: list[str], measures: dict[str, Column]) -> DataFrame:
    """(groups, idx, measures): sums of the measures over the facts whose life overlaps an interval; only cells with such a fact.

    A fact adds its measures in its first interval and takes them back after its
    last, and a running sum over a group's intervals does the rest: two rows a fact
    in one grouping, however long it lives. Measures are whole numbers, null as 0.
    """
    told = {"tw_n": F.lit(1), **measures}
    rows = _span(facts, bounds, begin, end).select(*groups, "lo", "hi", *[F.coalesce(c.cast("bigint"), F.lit(0)).alias(n) for n, c in told.items()]).where("lo <= hi")
    ends = rows.select(*groups, *told, F.explode(F.array(F.struct(F.col("lo").alias("idx"), F.lit(1).alias("sign")), F.struct((F.col("hi") + 1).alias("idx"), F.lit(-1).alias("sign")))).alias("e"))
    steps = ends.groupBy(*groups, F.col("e.idx").alias("idx")).agg(*[F.sum(F.col(n) * F.col("e.sign")).alias(n) for n in told])
    laid = dense(steps, len(bounds) - 1, tuple(groups), list(told))
    upto = Window.partitionBy(*groups).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return laid.select(*groups, "idx", *[F.sum(n).over(upto).alias(n) for n in told]).where("tw_n > 0").withColumnRenamed("tw_n", "alive")


def dense(cells: DataFrame, n: int, groups: tuple[str, ...], zero: list[str]) -> DataFrame:
    """A row for every group and interval; the columns ``zero`` are 0 in empty cells, the others null.

    A group's cells, one an interval at most, are gathered in a map and laid out
    again, so what they come from is computed once.
    """
    told = [c for c in cells.columns if c not in (*groups, "idx")]
    held = cells.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("idx", F.struct(*told).alias("cell")))).alias("cells"))
    laid = held.select(*groups, "cells", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx")).withColumn("cell", F.col("cells")[F.col("idx")])
    return laid.select(*groups, "idx", *[F.coalesce(F.col(f"cell.{c}"), F.lit(0)).alias(c) if c in zero else F.col(f"cell.{c}") for c in told])
