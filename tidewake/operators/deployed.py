"""What deployments hold by request: one owner each, filters over it, groups of people, and what must be worked out again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from . import dag
from .history import _DEP, deployed, past, rollouts

PEOPLE = ["pr_authors", "commit_authors"]


def requests_of_deployments(owned: DataFrame, merges: DataFrame, finished: DataFrame) -> DataFrame:
    """(env, pr, deployment): each request in the oldest deployment of an environment that owns any of its merge commits.

    owned: (env, sha, deployment); merges: (pr, sha), a row a merge commit, so a
    request that was merged anew by a rebase has several; finished: (deployment,
    finished), ties to the least deployment.
    """
    held = owned.join(merges, "sha").select("env", "pr", "deployment").distinct().join(finished, "deployment")
    return held.groupBy("env", "pr").agg(F.min_by("deployment", F.struct("finished", "deployment")).alias("deployment"))


def filtered_deployments(held: DataFrame, include: list[str] = (), exclude: list[str] = (), issues: bool = False) -> DataFrame:
    """(deployment) of those that pass. held: (deployment, pr, labels: array, has_issue), a row a request.

    A request passes if it has a label of ``include`` (where there are any), none
    of ``exclude``, and an issue where ``issues`` are wanted. A filter that includes
    needs one request to pass, one that only excludes all of them; a deployment
    without requests doesn't pass. Labels compare in lower case; null labels are none.
    """
    low = F.transform(F.coalesce("labels", F.array().cast("array<string>")), F.lower)
    among = lambda names: F.coalesce(F.arrays_overlap(low, F.array(*[F.lit(n.lower()) for n in names])), F.lit(False)) if names else F.lit(False)
    passes = ~among(exclude)
    if include:
        passes = passes & among(include)
    if issues:
        passes = passes & F.coalesce("has_issue", F.lit(False))
    every = (F.bool_or if include or issues else F.bool_and)("tw_passes")
    return held.where("pr is not null").withColumn("tw_passes", passes).groupBy("deployment").agg(every.alias("tw_kept")).where("tw_kept").select("deployment")


def by_participants(people: DataFrame, groups: dict[str, dict[str, list[int]]]) -> DataFrame:
    """(deployment, people_group): groups that a deployment is in, by anyone of a group in the role asked for. people: (deployment, pr_authors, commit_authors); groups: name -> role -> ids."""
    anyone = lambda roles: F.greatest(F.lit(False), F.lit(False), *[F.coalesce(F.arrays_overlap(F.col(r), F.array(*[F.lit(i).cast("bigint") for i in ids])), F.lit(False)) for r, ids in roles.items() if ids])
    return people.select("deployment", F.explode(F.array_compact(F.array(*[F.when(anyone(roles), F.lit(n)) for n, roles in groups.items()]))).alias("people_group"))


def deployments_to_redo(stored: DataFrame, known: DataFrame) -> DataFrame:
    """(deployment), distinct: stored owners of what another deployment of the same environment and repository is stored to own too, and those not known any more.

    stored: (env, repo, sha, deployment); known: (deployment).
    """
    twice = stored.groupBy("env", "repo", "sha").agg(F.collect_set("deployment").alias("all")).where(F.size("all") > 1).select(F.explode("all").alias("deployment"))
    gone = stored.select("deployment").distinct().join(known, "deployment", "left_anti")
    return twice.unionByName(gone).distinct()


def _merges(rows: DataFrame) -> DataFrame:
    """Merge commits of the main branch with their request, which several share, as after a rebase."""
    return rows.where("is_merge and branch = 0").select("sha", F.expr("repo * 1000 + k % 20").alias("pr"))


def _held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = past(spark, sf_dir)
    owned = deployed(h)
    finished = rollouts(h.rows).select(F.col("sha").alias("deployment"), F.col("published").alias("finished"))
    return owned.join(h.rows.select("sha", "k"), "sha"), requests_of_deployments(owned, _merges(h.rows), finished)


_PRS = f"{_DEP}, held AS (SELECT d.env, c.repo * 1000 + c.k % 20 AS pr, arg_min(d.deployment, r.published * 10000000 + r.sha) AS deployment FROM down d JOIN commits c USING (sha) JOIN rolls r ON r.sha = d.deployment WHERE c.is_merge AND c.chain = 0 GROUP BY ALL)"


@query("commits", "SELECT env, pr, deployment FROM held", _PRS)
def d12_requests_of_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each environment with the one deployment that counts them."""
    return _held(spark, sf_dir)[1]


@query("commits", "SELECT DISTINCT deployment, 'including' AS kind FROM held WHERE pr % 20 IN (3, 4, 5, 6) AND pr % 7 <> 0 UNION ALL SELECT deployment, 'excluding' FROM held GROUP BY deployment HAVING bool_and(pr % 20 NOT IN (3, 4)) UNION ALL SELECT DISTINCT deployment, 'with issues' FROM held WHERE pr % 3 = 0 AND pr % 7 <> 0", _PRS)
def d14_deployments_by_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three filters over the requests of deployments: labels wanted and not, labels not wanted alone, and requests with an issue."""
    label = F.when(F.expr("pr % 20 in (3, 4)"), "Bug").when(F.expr("pr % 20 in (5, 6)"), "feature")
    held = _held(spark, sf_dir)[1].select("deployment", "pr", F.array_compact(F.array(label, F.when(F.col("pr") % 7 == 0, "skip"))).alias("labels"), (F.col("pr") % 3 == 0).alias("has_issue"))
    kinds = {"including": filtered_deployments(held, ["bug", "FEATURE"], ["skip"]), "excluding": filtered_deployments(held, exclude=["bug"]), "with issues": filtered_deployments(held, exclude=["skip"], issues=True)}
    first, *rest = [rows.withColumn("kind", F.lit(k)) for k, rows in kinds.items()]
    for rows in rest:
        first = first.unionByName(rows)
    return first


@query("commits", "SELECT people_group, count(*) AS deployments FROM (SELECT DISTINCT 'authors' AS people_group, deployment FROM held WHERE pr % 11 IN (1, 2) UNION ALL SELECT DISTINCT 'anyone', deployment FROM (SELECT deployment FROM held WHERE pr % 11 = 2 UNION ALL SELECT deployment FROM down JOIN commits c USING (sha) WHERE c.k % 17 IN (3, 5))) GROUP BY 1", _PRS)
def d08_deployments_by_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployments of two groups of people that overlap, one by requests' authors, one by those or commits' authors."""
    commits, requests = _held(spark, sf_dir)
    roles = commits.select("deployment", F.lit(None).cast("bigint").alias("p"), (F.col("k") % 17).alias("c")).unionByName(requests.select("deployment", (F.col("pr") % 11).alias("p"), F.lit(None).cast("bigint").alias("c")))
    people = roles.groupBy("deployment").agg(F.collect_set("p").alias("pr_authors"), F.collect_set("c").alias("commit_authors"))
    groups = {"authors": {"pr_authors": [1, 2]}, "anyone": {"pr_authors": [2], "commit_authors": [3, 5]}}
    return by_participants(people, groups).groupBy("people_group").agg(F.count("*").alias("deployments"))


@query("commits", "SELECT DISTINCT deployment FROM (SELECT d.deployment FROM down d JOIN early e ON e.env = d.env AND e.sha = d.sha AND e.deployment <> d.deployment UNION ALL SELECT e.deployment FROM down d JOIN early e ON e.env = d.env AND e.sha = d.sha AND e.deployment <> d.deployment UNION ALL SELECT deployment FROM (SELECT deployment FROM down UNION SELECT deployment FROM early) JOIN rolls r ON r.sha = deployment WHERE r.k % 13 = 0)", f"{_DEP}, early AS (SELECT r.env, a.sha, arg_min(a.head, r.published * 10000000 + r.sha) AS deployment FROM danc a JOIN rolls r ON r.sha = a.head WHERE r.k % 11 <> 0 GROUP BY ALL)")
def d18_deployments_to_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployments to work out again after late ones came in (k divisible by 11) beside what was stored before, and some were deleted (k divisible by 13)."""
    h = past(spark, sf_dir)
    good = rollouts(h.rows).where("conclusion = 'SUCCESS'")
    heads = good.where("k % 11 <> 0").select("env", F.col("sha").alias("head"), "sha", (F.col("published") * 10_000_000 + F.col("sha")).alias("rank"))
    early = dag.owners(h.graph, heads, ["env"]).select("env", "sha", F.col("owner").alias("deployment"))
    stored = early.unionByName(deployed(h)).distinct().join(h.rows.select("sha", "repo"), "sha")
    return deployments_to_redo(stored, good.where("k % 13 <> 0").select(F.col("sha").alias("deployment")))
