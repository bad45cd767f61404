"""Requests whose merge commits were rewritten, found again by the messages of later commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import facts, query
from .history import _DEP, deployed, past, rollouts

#: Seconds by which a rewritten commit may be older than the merge.
SLACK = 10
#: The first line of a merge made on the site, and an issue's key.
MERGE_LINE = r"^Merge pull request #\d+ from "
ISSUE_KEY = r"[A-Z][A-Z0-9]+-[1-9][0-9]*"


def _line(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)


def revived(commits: DataFrame, requests: DataFrame) -> DataFrame:
    """(pr, sha, committed): the commits that stand for a rewritten merge. commits: (sha, repo, committed, message); requests: (pr, number, repo, merged, merge_sha, message of the merge commit).

    A request whose line names its number or an issue is looked for by that line,
    any other by the line that the site writes for its merge. A commit is known by
    its first line, and by that opening where it has one; both sides meet by
    repository and the hash of the key, and the key itself is compared after. A
    commit no older than the merge, but ten seconds, and other than the merge counts.
    """
    line = _line(F.col("message"))
    opening = F.regexp_extract(line, MERGE_LINE, 0)
    keyed = commits.select("sha", "repo", "committed", F.explode(F.array_distinct(F.array_compact(F.array(line, F.when(opening != "", opening))))).alias("key"))
    named = line.contains(F.concat(F.lit("#"), F.col("number").cast("string"))) | line.rlike(ISSUE_KEY)
    asked = requests.select("pr", "repo", "merged", "merge_sha", F.when(named, line).otherwise(F.concat(F.lit("Merge pull request #"), F.col("number").cast("string"), F.lit(" from "))).alias("wanted"))
    both = keyed.withColumn("h", F.xxhash64("repo", "key")).join(asked.withColumn("h", F.xxhash64("repo", "wanted")).drop("repo"), "h")
    return both.where("key = wanted and (merge_sha is null or sha <> merge_sha)").where(F.col("committed") > F.col("merged") - SLACK).select("pr", "sha", "committed").distinct()


def best_revived(found: DataFrame) -> DataFrame:
    """(pr, sha): the earliest commit of each request; of requests that want one commit, the least id takes it."""
    first = found.groupBy("pr").agg(F.min(F.struct("committed", "sha")).alias("x"))
    return first.groupBy(F.col("x.sha").alias("sha")).agg(F.min("pr").alias("pr")).select("pr", "sha")


_TOLD = """told AS (SELECT sha, repo, started AS committed, chain, is_merge, k, CASE WHEN k % 5 = 0 THEN 'Merge pull request #' || (k % 37) || ' from side' WHEN k % 5 = 1 THEN 'Mend it (#' || (k % 37) || ')' || chr(10) || 'More' WHEN k % 5 = 2 THEN 'ABC-' || (1 + k % 19) || ' mend' ELSE 'Mend' END AS message FROM commits),
lines AS (SELECT *, split_part(message, chr(10), 1) AS line FROM told),
asked AS (SELECT sha AS pr, repo, committed AS merged, CASE WHEN contains(line, '#' || (k % 37)) OR regexp_matches(line, '[A-Z][A-Z0-9]+-[1-9][0-9]*') THEN line ELSE 'Merge pull request #' || (k % 37) || ' from ' END AS wanted FROM lines WHERE is_merge AND chain = 0),
keyed AS (SELECT sha, repo, committed, line AS key FROM lines UNION SELECT sha, repo, committed, regexp_extract(line, '^Merge pull request #\\d+ from ') FROM lines WHERE line LIKE 'Merge pull request #% from %'),
met AS (SELECT DISTINCT pr, sha, committed FROM asked JOIN keyed USING (repo) WHERE key = wanted AND sha <> pr AND committed > merged - 10)"""


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = "cast(k % 37 as string)"
    message = F.expr(f"case k % 5 when 0 then 'Merge pull request #' || {number} || ' from side' when 1 then 'Mend it (#' || {number} || ')\\nMore' when 2 then 'ABC-' || cast(1 + k % 19 as string) || ' mend' else 'Mend' end")
    return facts(spark, sf_dir, "commits").select("sha", "repo", F.col("started").alias("committed"), "branch", "is_merge", (F.col("k") % 37).alias("number"), message.alias("message"))


@query("commits", "SELECT min(pr) AS pr, sha FROM (SELECT pr, arg_min(sha, committed * 10000000 + sha) AS sha FROM met GROUP BY pr) GROUP BY sha", _TOLD)
def f14_revived_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged requests and the later commit that repeats their merge's message."""
    rows = _told(spark, sf_dir)
    asked = rows.where("is_merge and branch = 0").select(F.col("sha").alias("pr"), "number", "repo", F.col("committed").alias("merged"), F.col("sha").alias("merge_sha"), "message")
    return best_revived(revived(rows, asked))


@query("commits", "SELECT d.env, pr, arg_min(deployment, published * 10000000 + deployment) AS deployment FROM (SELECT pr, pr AS sha FROM asked UNION SELECT pr, sha FROM (SELECT min(pr) AS pr, sha FROM (SELECT pr, arg_min(sha, committed * 10000000 + sha) AS sha FROM met GROUP BY pr) GROUP BY sha)) m JOIN down d USING (sha) JOIN rolls r ON r.sha = d.deployment GROUP BY ALL", _TOLD + ", " + _DEP)
def d12_requests_of_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deployment that first brought each request to an environment, by its merge or by the commit that stands for it; a rewritten request that was deployed before is not counted again."""
    asked = _told(spark, sf_dir).where("is_merge and branch = 0").select(F.col("sha").alias("pr"))
    also = f14_revived_requests(spark, sf_dir)
    h = past(spark, sf_dir)
    when = rollouts(h.rows).select(F.col("sha").alias("deployment"), "published")
    held = asked.select("pr", F.col("pr").alias("sha")).unionByName(also).join(deployed(h), "sha").join(when, "deployment")
    return held.groupBy("env", "pr").agg(F.min_by("deployment", F.struct("published", "deployment")).alias("deployment"))
