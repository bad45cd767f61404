"""First releases and first deployments that are far too old: found, and what they hold hidden."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query
from .history import _DEP, _MINED, deployed, mined_releases, ownership, past, released_pulls, rollouts

#: How many times the usual distance a first one must be away.
FACTOR = 100.0


def first_outlier_releases(mined: DataFrame, factor: float = FACTOR) -> DataFrame:
    """(repo, release): the oldest release of a repository whose age is at least ``factor`` times the median of the others' ages, of which there are at least two.

    mined: (repo, release, published, age); among equally old ones the least
    release is the first. Null ages don't count; a first one of null age is none.
    """
    first = mined.groupBy("repo").agg(F.min(F.struct("published", "release", "age")).alias("first"))
    rest = mined.join(first, "repo").where(F.col("release") != F.col("first.release")).groupBy("repo").agg(F.count("age").alias("n"), F.median("age").alias("usual"), F.first("first").alias("first"))
    return rest.where((F.col("n") >= 2) & (F.col("first.age") >= F.col("usual") * factor)).select("repo", F.col("first.release").alias("release"))


def ignoring_releases(requests: DataFrame, outliers: DataFrame) -> DataFrame:
    """``requests`` (release, released, ...) with ``release_ignored``; those of an outlier lose ``release`` and ``released``."""
    told = requests.join(outliers.select("release", F.lit(True).alias("tw_out")), "release", "left").withColumn("release_ignored", F.col("tw_out").isNotNull()).drop("tw_out")
    keep = lambda c: F.when(~F.col("release_ignored"), F.col(c))
    return told.withColumns({"released": keep("released"), "release": keep("release")})


def first_outlier_deployments(rollouts: DataFrame, born: DataFrame, factor: float = FACTOR) -> DataFrame:
    """(repo, deployment), distinct: the first deployment in an environment, of any conclusion, whose distance from its repository's creation is over ``factor`` times the median distance of successes.

    rollouts: (repo, env, deployment, started, conclusion); born: (repo, created),
    a repository without it has no outlier. Fewer than two successes tell nothing;
    a median of 0 counts as a second.
    """
    own = ["repo", "env"]
    before = F.lag("started").over(Window.partitionBy(*own).orderBy("started"))
    usual = rollouts.where("conclusion = 'SUCCESS'").withColumn("gap", F.col("started") - before).groupBy(*own).agg(F.median("gap").alias("gap")).where("gap is not null")
    first = rollouts.groupBy(*own).agg(F.min(F.struct("started", "deployment")).alias("first"))
    far = first.join(usual, own).join(born.select("repo", "created"), "repo").where((F.col("first.started") - F.col("created")) / F.when(F.col("gap") == 0, 1).otherwise(F.col("gap")) > factor)
    return far.select("repo", F.col("first.deployment").alias("deployment")).distinct()


def hidden_contents(held: DataFrame, outliers: DataFrame) -> DataFrame:
    """``held`` (repo, deployment, ...) without what outliers of the repository hold."""
    return held.join(outliers, ["repo", "deployment"], "left_anti")


_OUT = "firsts AS (SELECT repo, release FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY published, release) AS r FROM mined) WHERE r = 1), outliers AS (SELECT f.release FROM firsts f JOIN mined m ON m.repo = f.repo JOIN mined o ON o.release = f.release WHERE m.release <> f.release GROUP BY f.release HAVING count(*) >= 2 AND max(o.age) >= 2 * median(m.age))"


@query("commits", "SELECT c.sha AS pr, CASE WHEN x.release IS NULL THEN o.owner END AS release, CASE WHEN x.release IS NULL THEN greatest(t.published, c.started) END AS released, x.release IS NOT NULL AS release_ignored FROM commits c JOIN own o ON o.sha = c.sha JOIN tags t ON t.sha = o.owner LEFT JOIN outliers x ON x.release = o.owner WHERE c.is_merge AND c.chain = 0", f"{_MINED}, {_OUT}")
def r19_requests_without_outlier_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their releases, those of outlier first releases ignored (twice the median here, as the stand-in's ages vary little)."""
    h = past(spark, sf_dir)
    own = ownership(h)
    requests = released_pulls(h, own).select("pr", "release", "released")
    return ignoring_releases(requests, first_outlier_releases(mined_releases(h, own), 2.0)).select("pr", "release", "released", "release_ignored")


_FAR = "gaps AS (SELECT repo, env, median(gap) AS gap FROM (SELECT repo, env, published - lag(published) OVER (PARTITION BY repo, env ORDER BY published) AS gap FROM rolls WHERE conclusion = 'SUCCESS') WHERE gap IS NOT NULL GROUP BY ALL), begun AS (SELECT repo, env, min(published) AS first_at, arg_min(sha, published * 10000000 + sha) AS deployment FROM rolls GROUP BY ALL), born AS (SELECT repo, min(started) AS created FROM commits GROUP BY 1), far AS (SELECT DISTINCT repo, deployment FROM begun JOIN gaps USING (repo, env) JOIN born USING (repo) WHERE (first_at - created) / CASE WHEN gap = 0 THEN 1 ELSE gap END > 2)"


@query("commits", "SELECT d.env, d.deployment, count(*) AS commits FROM down d JOIN rolls r ON r.sha = d.deployment WHERE NOT EXISTS (SELECT 1 FROM far f WHERE f.repo = r.repo AND f.deployment = d.deployment) GROUP BY ALL", f"{_DEP}, {_FAR}")
def d16_commits_without_outlier_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of each successful deployment, those of outlier first deployments hidden (twice the median here)."""
    h = past(spark, sf_dir)
    rolls = rollouts(h.rows).select("repo", "env", F.col("sha").alias("deployment"), F.col("published").alias("started"), "conclusion")
    outliers = first_outlier_deployments(rolls, h.rows.groupBy("repo").agg(F.min("started").alias("created")), 2.0)
    return hidden_contents(deployed(h).join(rolls.select("deployment", "repo"), "deployment"), outliers).groupBy("env", "deployment").agg(F.count("*").alias("commits"))
