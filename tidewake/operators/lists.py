"""Lists, rollups and orderings over the fact tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import facts, query, steps
from ..functions.intervals import alive_sums, binned, interval_rows, split
from .metrics import METRICS, SAMPLES, compute

_STAGES = ("p01_pr_wip_time", "p04_pr_review_time", "p07_pr_merging_time", "p10_pr_release_time")
_MEANS = " UNION ALL ".join(f"SELECT grp, idx, {METRICS[r]['value'].sql()} AS v FROM prs JOIN steps ON ({METRICS[r]['value'].time}) >= ts_from AND ({METRICS[r]['value'].time}) < ts_to GROUP BY ALL" for r in _STAGES)


@query("prs", f"SELECT grp, idx, CAST(sum(v) AS BIGINT) AS value FROM ({_MEANS}) GROUP BY ALL HAVING sum(v) IS NOT NULL")
def p18_pr_live_cycle_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the four stage means of a cell, of those that exist."""
    cells = compute(facts(spark, sf_dir, "prs"), steps("prs"), {r[:3]: METRICS[r]["value"] for r in _STAGES})
    parts = [F.col(r[:3]) for r in _STAGES]
    return cells.where(F.coalesce(*parts).isNotNull()).select("grp", "idx", sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)).cast("bigint").alias("value"))


@query("actions", "SELECT topic, started // 86400 AS day, count(*) AS events, CAST(sum(lines) AS BIGINT) AS lines FROM actions GROUP BY ROLLUP (topic, day)")
def q10_day_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive measures per topic and day, per topic, and over all, in one pass."""
    rows = facts(spark, sf_dir, "actions").withColumn("day", F.expr("started div 86400"))
    return rows.rollup("topic", "day").agg(F.count("*").alias("events"), F.sum("lines").alias("lines"))


@query("prs", """SELECT DISTINCT day FROM (SELECT created // 86400 AS day, sum(count(*)) OVER (ORDER BY created // 86400 DESC) AS upto, count(*) AS n, min(created // 86400) OVER () AS oldest FROM prs GROUP BY 1) WHERE (upto - 1) // 500 > (upto - n - 1) // 500 OR upto = n OR day = oldest""")
def q18_pagination_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days at which a page of 500 requests, newest first, begins, and the oldest day. Rows are counted by day first, so the ordered window sees days alone."""
    days = facts(spark, sf_dir, "prs").groupBy(F.expr("created div 86400").alias("day")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("day")))
    ranked = days.withColumn("upto", upto).withColumn("oldest", F.min("day").over(Window.partitionBy()))
    return ranked.where("floor((upto - 1) / 500) > floor((upto - n - 1) / 500) or upto = n or day = oldest").select("day").distinct()


@query("prs", """SELECT 'merged' AS name, count(merged) AS value FROM prs UNION ALL SELECT 'unreleased', count(*) FROM prs WHERE merged IS NOT NULL AND released IS NULL UNION ALL SELECT 'without_commits', count(*) FROM prs WHERE n_commits = 0
UNION ALL SELECT 'rejected', count(*) FROM prs WHERE closed IS NOT NULL AND merged IS NULL UNION ALL SELECT 'empty', count(*) FROM prs WHERE size = 0""")
def q26_data_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of anomalies as (name, value), all from one scan."""
    checks = {"merged": "merged is not null", "unreleased": "merged is not null and released is null", "without_commits": "n_commits = 0", "rejected": "closed is not null and merged is null", "empty": "size = 0"}
    one = facts(spark, sf_dir, "prs").agg(*[F.count(F.when(F.expr(c), 1)).alias(n) for n, c in checks.items()])
    return one.selectExpr(f"stack({len(checks)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in checks)}) as (name, value)")


@query("checks", "SELECT pr, count(DISTINCT name) AS failed_checks FROM (SELECT pr, name, arg_max(ok, started * 10000000 + event_id) AS ok FROM checks WHERE pr IS NOT NULL GROUP BY ALL) WHERE NOT ok GROUP BY 1")
def c10_chk_latest_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests where the latest run of some check failed, with the number of such checks."""
    last = facts(spark, sf_dir, "checks").where("pr is not null").groupBy("pr", "name").agg(F.max_by("ok", F.struct("started", "event_id")).alias("ok"))
    return last.where(~F.col("ok")).groupBy("pr").agg(F.count("*").alias("failed_checks"))


#: Weeks that the stand-in's checks lie in.
_WEEKS = split("week", dt.date(2024, 1, 1), dt.date(2024, 2, 4))
_WEEK_ROWS = "weeks(idx, ts_from, ts_to) AS (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, a, b in interval_rows(_WEEKS)) + ")"


def merged_with_failed_checks(runs: DataFrame, requests: DataFrame, bounds: list[dt.date]) -> DataFrame:
    """(grp, idx, merged_with_failed, merged_with_checks, failed_ratio): merged requests with checks whose life [created, closed] overlaps the interval.

    runs: (pr, name, started, event_id, conclusion), null pr ignored; requests:
    (node_id, grp, created, closed, merged), closed ones. A request failed if the
    latest run of any of its checks did. Runs are reduced to a row a request before
    they meet the requests, so a request of very many runs moves none of them.
    """
    last = runs.where("pr is not null").groupBy("pr", "name").agg(F.max_by("conclusion", F.struct("started", "event_id")).alias("conclusion"))
    told = last.groupBy(F.col("pr").alias("node_id")).agg(F.coalesce(F.bool_or(F.col("conclusion") == "FAILURE"), F.lit(False)).alias("failed"))
    checked = requests.where("merged is not null").join(told, "node_id")
    cells = alive_sums(checked, bounds, "created", "closed", ["grp"], {"merged_with_failed": F.col("failed").cast("int")})
    return cells.select("grp", "idx", "merged_with_failed", F.col("alive").alias("merged_with_checks"), F.round(F.col("merged_with_failed") / F.col("alive"), 9).alias("failed_ratio"))


def stand_in_requests(runs: DataFrame) -> DataFrame:
    """Requests of the check runs: created a day before their first run, closed at their last end, merged if their id isn't divisible by 5."""
    own = runs.where("pr is not null").groupBy(F.col("pr").alias("node_id")).agg(F.min("grp").alias("grp"), (F.min("started") - 86400).alias("created"), F.max("completed").alias("closed"))
    return own.withColumn("merged", F.when(F.col("node_id") % 5 != 0, F.col("closed")))


@query("checks", "SELECT grp, idx, count(CASE WHEN node_id IN (SELECT pr FROM failing) THEN 1 END) AS merged_with_failed, count(*) AS merged_with_checks, round(count(CASE WHEN node_id IN (SELECT pr FROM failing) THEN 1 END) / count(*), 9) AS failed_ratio FROM requests JOIN weeks ON created < ts_to AND closed >= ts_from WHERE node_id % 5 <> 0 GROUP BY ALL", _WEEK_ROWS + ", requests AS (SELECT pr AS node_id, min(grp) AS grp, min(started) - 86400 AS created, max(completed) AS closed FROM checks WHERE pr IS NOT NULL GROUP BY 1), failing AS (SELECT DISTINCT pr FROM (SELECT pr, conclusion, row_number() OVER (PARTITION BY pr, name ORDER BY started DESC, event_id DESC) AS r FROM checks WHERE pr IS NOT NULL) WHERE r = 1 AND conclusion = 'FAILURE')")
def c10_merged_with_failed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests merged although the latest run of a check failed, and their share of the merged requests with checks, by week."""
    runs = facts(spark, sf_dir, "checks")
    return merged_with_failed_checks(runs, stand_in_requests(runs), _WEEKS)


@query("checks", "SELECT grp, round(avg(e - second), 6) AS imbalance FROM (SELECT grp, suite, max(completed) AS e, max(completed) FILTER (r = 2) AS second FROM (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY completed DESC, event_id) AS r FROM checks) GROUP BY ALL) WHERE second IS NOT NULL GROUP BY 1")
def c16_chk_suite_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of a suite's end from its second latest run's end."""
    w = Window.partitionBy("suite").orderBy(F.desc("completed"), "event_id")
    ends = facts(spark, sf_dir, "checks").withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("grp", "suite").agg(F.max("completed").alias("e"), F.max(F.when(F.col("r") == 2, F.col("completed"))).alias("second"))
    return ends.where("second is not null").groupBy("grp").agg(F.round(F.avg(F.expr("e - second")), 6).alias("imbalance"))


@query("checks", "SELECT grp, name, count(*) AS runs, max(started) AS last_run, count(CASE WHEN ok THEN 1 END) AS successes, count(DISTINCT suite) AS suites, round(avg(completed - started), 6) AS mean_time, round(stddev_pop(completed - started), 6) AS spread FROM checks GROUP BY ALL")
def c18_check_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check types per repository with their statistics."""
    took = F.col("completed") - F.col("started")
    return facts(spark, sf_dir, "checks").groupBy("grp", "name").agg(F.count("*").alias("runs"), F.max("started").alias("last_run"), F.count(F.when(F.col("ok"), 1)).alias("successes"), F.countDistinct("suite").alias("suites"), F.round(F.avg(took), 6).alias("mean_time"), F.round(F.stddev_pop(took), 6).alias("spread"))


@query("prs", "SELECT node_id, CASE WHEN closed < 820454400 THEN closed END AS closed, CASE WHEN merged < 820454400 THEN merged END AS merged, CASE WHEN released < 820454400 THEN released END AS released, coalesce(released < 820454400, FALSE) OR (coalesce(closed < 820454400, FALSE) AND merged IS NULL) AS done FROM prs WHERE created < 820454400")
def f06_facts_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as they stood on 1996-01-01: later times are null and done is taken anew."""
    cut = lambda c: F.when(F.col(c) < 820454400, F.col(c))
    rows = facts(spark, sf_dir, "prs").where("created < 820454400")
    return rows.select("node_id", cut("closed").alias("closed"), cut("merged").alias("merged"), cut("released").alias("released"), (cut("released").isNotNull() | (cut("closed").isNotNull() & F.col("merged").isNull())).alias("done"))


@query("prs", "SELECT node_id, closed - created AS open_time FROM prs WHERE closed - created > 86400 * 365")
def q15_filter_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose open time exceeds a year."""
    return facts(spark, sf_dir, "prs").select("node_id", (F.col("closed") - F.col("created")).alias("open_time")).where(F.col("open_time") > 86400 * 365)
