"""Statistics and timelines of check types, over all runs and over those of requests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import facts, query
from ..functions.intervals import bucket, interval_rows, seconds, split

TYPE = ["grp", "name", "side"]


def _counted(runs: DataFrame, bounds: list[dt.date]) -> DataFrame:
    """(grp, name, side, idx, took, n, successes, skips, critical): runs counted by type, side, interval and duration.

    Everything but flaky commits and suite sizes follows from these counts, so
    the runs are grouped once, whatever a type's share of them.
    """
    ends = runs.groupBy("suite").agg(F.max("completed").alias("suite_end"))
    side = F.array_compact(F.array(F.lit("total"), F.when(F.col("pr").isNotNull(), F.lit("prs"))))
    rows = runs.join(ends, "suite").select("grp", "name", F.explode(side).alias("side"), bucket(F.col("started"), [seconds(d) for d in bounds]).alias("idx"), F.expr("completed - started").alias("took"), "conclusion", F.expr("completed = suite_end").alias("last")).where("idx is not null")
    skipped = F.coalesce(F.col("conclusion") == "SKIPPED", F.lit(False))
    return rows.groupBy(*TYPE, "idx", "took").agg(F.count_if(~skipped).alias("n"), F.count_if(F.col("conclusion").isin("SUCCESS", "NEUTRAL")).alias("successes"), F.count_if(skipped).alias("skips"), F.coalesce(F.bool_or(F.col("last") & ~skipped), F.lit(False)).alias("critical"))


def _bounded(counted: DataFrame, low: float, high: float) -> DataFrame:
    """``counted`` with ``kept``: whether the duration lies within the nearest-rank quantiles of its type and side; the window sees distinct durations."""
    known = counted.where("took is not null and n > 0").groupBy(*TYPE, "took").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*TYPE).orderBy("took"))
    ranked = known.withColumn("upto", upto).withColumn("every", F.sum("n").over(Window.partitionBy(*TYPE)))
    at = lambda q: F.min(F.when(F.col("upto") > F.rint((F.col("every") - 1) * q), F.col("took")))
    edges = ranked.groupBy(*TYPE).agg(at(low).alias("tw_lo"), at(high).alias("tw_hi"))
    return counted.join(edges, TYPE, "left").withColumn("kept", F.coalesce(F.col("took").between(F.col("tw_lo"), F.col("tw_hi")), F.lit(False))).drop("tw_lo", "tw_hi")


def _mean() -> Column:
    n = F.sum(F.when(F.col("kept"), F.col("n")))
    return F.sum(F.when(F.col("kept"), F.col("took") * F.col("n"))) / F.nullif(n, F.lit(0))


def check_type_stats(runs: DataFrame, bounds: list[dt.date], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(grp, name, side, last_run, sizes, runs, successes, skips, critical, flaky, mean_time, spread, median_time) of each check type and side.

    runs: (grp, name, suite, commit, pr, started, completed, conclusion). Sides
    are ``total`` and ``prs`` (runs of requests); ``last_run`` is over all runs of
    the type, the rest over runs that start within the bounds. Skipped runs are
    counted as skips alone. critical: a run ended its suite; flaky: commits where
    the check both succeeded and failed; sizes: those of its suites, ascending.
    Mean and population deviation are over durations within the quantiles, the
    median over all known ones. A side without runs within the bounds has no row.
    """
    counted = _bounded(_counted(runs, bounds), low, high)
    square = F.sum(F.when(F.col("kept"), F.col("took") * F.col("took") * F.col("n"))) / F.nullif(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0))
    told = counted.groupBy(*TYPE).agg(
        F.sum("n").alias("runs"), F.sum("successes").alias("successes"), F.sum("skips").alias("skips"), F.bool_or("critical").alias("critical"), _mean().alias("mean_time"),
        square.alias("square"), F.expr("percentile(CASE WHEN n > 0 THEN took END, 0.5, greatest(n, 1))").alias("median_time"),
    )
    told = told.withColumn("spread", F.sqrt(F.greatest(F.col("square") - F.col("mean_time") * F.col("mean_time"), F.lit(0.0)))).drop("square")
    last = runs.groupBy("grp", "name").agg(F.max("started").alias("last_run"))
    inside = runs.where(bucket(F.col("started"), [seconds(bounds[0]), seconds(bounds[-1])]).isNotNull())
    side = F.array_compact(F.array(F.lit("total"), F.when(F.col("pr").isNotNull(), F.lit("prs"))))
    commits = inside.select("grp", "name", F.explode(side).alias("side"), "commit", "conclusion").groupBy(*TYPE, "commit").agg(F.bool_or(F.col("conclusion").isin("SUCCESS", "NEUTRAL")).alias("good"), F.bool_or(F.col("conclusion") == "FAILURE").alias("bad"))
    flaky = commits.where("good and bad and commit is not null").groupBy(*TYPE).agg(F.count("*").alias("flaky"))
    size = runs.groupBy("suite").agg(F.count("*").alias("size"))
    sizes = inside.where("conclusion is null or conclusion <> 'SKIPPED'").select("grp", "name", "suite").distinct().join(size, "suite").groupBy("grp", "name").agg(F.array_sort(F.collect_set("size")).alias("sizes"))
    found = told.join(last, ["grp", "name"]).join(sizes, ["grp", "name"], "left").join(flaky, TYPE, "left")
    return found.select(*TYPE, "last_run", "sizes", "runs", "successes", "skips", "critical", F.coalesce("flaky", F.lit(0)).cast("long").alias("flaky"), F.round("mean_time", 6).alias("mean_time"), F.round("spread", 5).alias("spread"), F.col("median_time").cast("double").alias("median_time"))


def check_type_timelines(runs: DataFrame, bounds: list[dt.date], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(grp, name, side, idx, runs, successes, mean_time, median_time) of the intervals in which a type ran unskipped; the cut is that of the whole range."""
    counted = _bounded(_counted(runs, bounds), low, high).where("n > 0")
    return counted.groupBy(*TYPE, "idx").agg(F.sum("n").alias("runs"), F.sum("successes").alias("successes"), F.round(_mean(), 6).alias("mean_time"), F.expr("percentile(took, 0.5, n)").cast("double").alias("median_time"))


_WEEKS = split("week", dt.date(2024, 1, 3), dt.date(2024, 1, 27))
_SIDES = f"""spans(idx, ts_from, ts_to) AS (VALUES {", ".join(f"({i}, {a}, {b})" for i, a, b in interval_rows(_WEEKS))}), suite_facts AS (SELECT suite, count(*) AS size, max(completed) AS e FROM checks GROUP BY 1),
sided AS (SELECT c.*, side, idx, size, completed - started AS took, completed = e AS last, conclusion = 'SKIPPED' AS skipped FROM checks c JOIN suite_facts USING (suite) JOIN spans ON started >= ts_from AND started < ts_to JOIN (VALUES ('total'), ('prs')) v(side) ON side = 'total' OR pr IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp, name, side ORDER BY took) - 1 AS r, count(*) OVER (PARTITION BY grp, name, side) AS every FROM sided WHERE NOT skipped),
cut AS (SELECT grp, name, side, max(CASE WHEN r = CAST(round_even((every - 1) * 0.05, 0) AS BIGINT) THEN took END) AS lo, max(CASE WHEN r = CAST(round_even((every - 1) * 0.95, 0) AS BIGINT) THEN took END) AS hi FROM ranked GROUP BY ALL)"""


@query("checks", "SELECT grp, name, side, any_value(last_run) AS last_run, any_value(sizes) AS sizes, count(CASE WHEN NOT skipped THEN 1 END) AS runs, count(CASE WHEN conclusion IN ('SUCCESS', 'NEUTRAL') THEN 1 END) AS successes, count(CASE WHEN skipped THEN 1 END) AS skips, bool_or(last AND NOT skipped) AS critical, coalesce(any_value(flaky), 0) AS flaky, round(avg(took) FILTER (NOT skipped AND took BETWEEN lo AND hi), 6) AS mean_time, round(stddev_pop(took) FILTER (NOT skipped AND took BETWEEN lo AND hi), 5) AS spread, CAST(median(took) FILTER (NOT skipped) AS DOUBLE) AS median_time FROM sided JOIN cut USING (grp, name, side) JOIN (SELECT grp, name, max(started) AS last_run FROM checks GROUP BY ALL) USING (grp, name) JOIN (SELECT grp, name, string_agg(CAST(size AS VARCHAR), ' ' ORDER BY size) AS sizes FROM (SELECT DISTINCT grp, name, size FROM sided WHERE NOT skipped) GROUP BY ALL) USING (grp, name) LEFT JOIN (SELECT grp, name, side, count(*) AS flaky FROM (SELECT grp, name, side, commit FROM sided GROUP BY ALL HAVING bool_or(conclusion IN ('SUCCESS', 'NEUTRAL')) AND bool_or(conclusion = 'FAILURE')) GROUP BY ALL) USING (grp, name, side) GROUP BY ALL", _SIDES)
def c18_check_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check types of four weeks of January 2024 with durations cut to the middle 90 percent."""
    return check_type_stats(facts(spark, sf_dir, "checks"), _WEEKS, 0.05, 0.95).withColumn("sizes", F.array_join("sizes", " "))


@query("checks", "SELECT grp, name, side, idx, count(*) AS runs, count(CASE WHEN conclusion IN ('SUCCESS', 'NEUTRAL') THEN 1 END) AS successes, round(avg(took) FILTER (took BETWEEN lo AND hi), 6) AS mean_time, CAST(median(took) AS DOUBLE) AS median_time FROM sided JOIN cut USING (grp, name, side) WHERE NOT skipped GROUP BY ALL", _SIDES)
def c18_check_type_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by week."""
    return check_type_timelines(facts(spark, sf_dir, "checks"), _WEEKS, 0.05, 0.95)
