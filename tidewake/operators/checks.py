"""Check-run preparation and the metrics that rest on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import QUERIES, facts, query, steps
from ..functions.intervals import binned

_FIRST = "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY started, event_id) AS r, count(*) OVER (PARTITION BY suite) AS runs, max(completed) OVER (PARTITION BY suite) AS suite_end FROM checks WHERE conclusion <> 'SKIPPED') WHERE r = 1)"


def suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a suite: its first run that isn't skipped speaks for it; by aggregation, so a suite of any size needs no sort."""
    rows = facts(spark, sf_dir, "checks").where("conclusion <> 'SKIPPED'")
    first = F.min(F.struct("started", "event_id", "conclusion", "pr", "grp", "pusher")).alias("first")
    return rows.groupBy("suite").agg(first, F.count("*").alias("runs"), F.max("completed").alias("suite_end")).select("suite", "first.*", "runs", "suite_end")


@query("checks", "SELECT grp, idx, count(CASE WHEN conclusion IN ('SUCCESS', 'NEUTRAL') THEN 1 END) AS successful, count(CASE WHEN conclusion = 'FAILURE' THEN 1 END) AS failed, count(CASE WHEN conclusion = 'CANCELLED' THEN 1 END) AS cancelled FROM firsts JOIN steps ON started >= ts_from AND started < ts_to GROUP BY ALL", _FIRST)
def c03_suites_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda *c: F.count(F.when(F.col("conclusion").isin(*c), 1))
    return binned(suites(spark, sf_dir), steps("checks"), "started").groupBy("grp", "idx").agg(count("SUCCESS", "NEUTRAL").alias("successful"), count("FAILURE").alias("failed"), count("CANCELLED").alias("cancelled"))


@query("checks", "SELECT grp, idx, round(avg(n), 6) AS suites_per_pr, count(*) AS prs, CAST(trunc(sum(s) / sum(n)) AS BIGINT) AS suite_time FROM (SELECT grp, idx, pr, count(*) AS n, sum(suite_end - started) AS s FROM firsts JOIN steps ON started >= ts_from AND started < ts_to WHERE pr IS NOT NULL GROUP BY ALL) GROUP BY ALL", _FIRST)
def c07_c08_suites_per_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean suites a request, requests with checks, and the mean time of suites that belong to a request."""
    rows = binned(suites(spark, sf_dir).where("pr is not null"), steps("checks"), "started").groupBy("grp", "idx", "pr").agg(F.count("*").alias("n"), F.sum(F.expr("suite_end - started")).alias("s"))
    return rows.groupBy("grp", "idx").agg(F.round(F.avg("n"), 6).alias("suites_per_pr"), F.count("*").alias("prs"), (F.sum("s") / F.sum("n")).cast("bigint").alias("suite_time"))


_OPEN = """runs AS (SELECT event_id, grp, name, started AS a, greatest(completed, started + 1) AS e FROM checks), open AS (SELECT x.event_id, x.grp, x.a, x.e, sum(least(x.e, y.e) - greatest(x.a, y.a)) / (x.e - x.a) AS c FROM runs x JOIN runs y ON x.grp = y.grp AND x.name = y.name AND y.a < x.e AND y.e > x.a GROUP BY x.event_id, x.grp, x.a, x.e)"""


def _concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = facts(spark, sf_dir, "checks").select("event_id", "grp", F.col("started").alias("a"), F.greatest("completed", F.col("started") + 1).alias("e"))
    return runs.join(QUERIES["c11_chk_concurrency"](spark, sf_dir), "event_id")


@query("checks", "SELECT grp, idx, round(avg(c), 5) AS mean_open, round(max(c), 5) AS most_open FROM open JOIN steps ON a >= ts_from AND a < ts_to GROUP BY ALL", _OPEN)
def c12_chk_concurrency_mean_and_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest concurrency of the runs that start in the interval."""
    return binned(_concurrency(spark, sf_dir), steps("checks"), "a").groupBy("grp", "idx").agg(F.round(F.avg("concurrency"), 5).alias("mean_open"), F.round(F.max("concurrency"), 5).alias("most_open"))


@query("checks", "SELECT grp, CAST(floor(round(c, 6)) AS BIGINT) AS level, CAST(sum(e - a) AS BIGINT) AS elapsed FROM open GROUP BY ALL", _OPEN)
def c13_elapsed_per_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram whose bars are summed durations for each whole level of concurrency."""
    return _concurrency(spark, sf_dir).groupBy("grp", F.floor("concurrency").alias("level")).agg(F.sum(F.expr("e - a")).alias("elapsed"))


@query("checks", "SELECT grp, round(avg(busy / (n * (e - s))), 6) AS occupancy FROM (SELECT grp, suite, min(started) AS s, max(completed) AS e, count(*) AS n, sum(completed - started) AS busy FROM checks WHERE (grp, name) IN (SELECT grp, name FROM (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY completed DESC, event_id) AS r FROM checks) WHERE r = 1) GROUP BY ALL) WHERE n > 1 AND e > s GROUP BY 1")
def c15_critical_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy over runs whose check ever finished last in a suite."""
    rows = facts(spark, sf_dir, "checks")
    last = rows.groupBy("suite").agg(F.min(F.struct((-F.col("completed")).alias("o"), "event_id", "grp", "name")).alias("x")).select("x.grp", "x.name").distinct()
    cells = rows.join(F.broadcast(last), ["grp", "name"], "left_semi").groupBy("grp", "suite").agg(F.min("started").alias("s"), F.max("completed").alias("e"), F.count("*").alias("n"), F.sum(F.expr("completed - started")).alias("busy"))
    return cells.where("n > 1 and e > s").groupBy("grp").agg(F.round(F.avg(F.expr("busy / (n * (e - s))")), 6).alias("occupancy"))


@query("checks", "SELECT CASE WHEN runs <= 1 THEN 'one' WHEN runs <= 3 THEN 'few' ELSE 'many' END AS size_group, pusher % 4 AS pushers, count(*) AS suites FROM firsts GROUP BY ALL", _FIRST)
def c17_group_by_pushers_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("runs") <= 1, "one").when(F.col("runs") <= 3, "few").otherwise("many")
    return suites(spark, sf_dir).groupBy(size.alias("size_group"), (F.col("pusher") % 4).alias("pushers")).agg(F.count("*").alias("suites"))


@query("checks", "SELECT suite, count(CASE WHEN conclusion IN ('SUCCESS', 'NEUTRAL') THEN 1 END) AS success, count(CASE WHEN conclusion = 'FAILURE' THEN 1 END) AS failure, count(CASE WHEN conclusion = 'SKIPPED' THEN 1 END) AS skipped FROM checks GROUP BY 1")
def c20_outcome_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each run, added up by suite."""
    c = F.col("conclusion")
    flags = facts(spark, sf_dir, "checks").select("suite", c.isin("SUCCESS", "NEUTRAL").alias("s"), (c == "FAILURE").alias("f"), (c == "SKIPPED").alias("k"))
    return flags.groupBy("suite").agg(F.count_if("s").alias("success"), F.count_if("f").alias("failure"), F.count_if("k").alias("skipped"))


@query("checks", "SELECT s.suite, CASE WHEN k.typical <= 20 THEN NULL ELSE s.e END AS suite_end FROM ends s JOIN kinds k USING (kind)", "ends AS (SELECT suite, list_sort(list(DISTINCT name)) AS kind, max(greatest(started, CASE WHEN conclusion <> 'NEUTRAL' THEN completed END)) AS e, min(started) AS a FROM checks GROUP BY 1), kinds AS (SELECT kind, median(e - a) AS typical FROM ends GROUP BY 1)")
def c24_suite_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suite ends, with neutral runs' ends left out; kinds of suites (same set of names) with a median of 20 seconds or less lose theirs."""
    end = F.when(F.col("conclusion") != "NEUTRAL", F.col("completed"))
    ends = facts(spark, sf_dir, "checks").groupBy("suite").agg(F.array_sort(F.collect_set("name")).alias("kind"), F.max(F.greatest("started", end)).alias("e"), F.min("started").alias("a"))
    kinds = ends.groupBy("kind").agg(F.median(F.expr("e - a")).alias("typical"))
    return ends.join(F.broadcast(kinds), "kind").select("suite", F.when(F.col("typical") > 20, F.col("e")).alias("suite_end"))
