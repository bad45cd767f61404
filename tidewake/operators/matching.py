"""Releases by the settings of each repository: by tag, by branch, by pushed notification, or by tag where there are any near."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import facts, query
from ..functions.intervals import seconds
from . import graph
from .history import _BRANCHES, past, releases_by_branch, tags

#: How far around the window a tag counts for a repository whose match is ``tag_or_branch``: four weeks.
AROUND = 28 * 86400


def _in_full(pattern: str) -> str:
    return f"concat('^(?:', {pattern}, ')$')"


def tagged_releases(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """(repo, sha, name, published, author): tags whose name their repository's pattern matches in full. rows: (repo, sha, tag, published, author)."""
    found = rows.join(settings.select("repo", "tag_rule"), "repo").where(F.expr(f"tag rlike {_in_full('tag_rule')}"))
    return found.select("repo", "sha", F.col("tag").alias("name"), "published", "author")


def applied_matches(settings: DataFrame, tagged: DataFrame, since: int, until: int, around: int = AROUND) -> DataFrame:
    """``settings`` with ``applied``: what each repository is matched by in the window.

    ``tag_or_branch`` becomes ``tag`` where a matching tag lies within ``around``
    seconds of the window [since, until), else ``branch``; the others stay.
    """
    near = tagged.where((F.col("published") >= since - around) & (F.col("published") < until + around)).select("repo").distinct()
    told = F.when(F.col("match") != "tag_or_branch", F.col("match")).when(F.col("near"), "tag").otherwise("branch")
    return settings.join(near.withColumn("near", F.lit(True)), "repo", "left").withColumn("applied", told).drop("near")


def pushed_releases(notes: DataFrame, commits: DataFrame, settings: DataFrame, since: int, until: int) -> DataFrame:
    """(repo, sha, name, published, author): notifications that name a commit of their repository by its hash or the first seven signs of it.

    notes: (repo, hash, name, published, author); commits: (repo, sha, hash). The
    name must begin with what the repository's pattern matches; a null name is an
    empty one. A prefix that several commits share gives the least ``sha``; one
    that no commit has gives nothing. The window includes both ends.
    """
    wanted = notes.where(F.col("published").between(since, until)).join(settings.select("repo", "event_rule"), "repo").where(F.expr("coalesce(name, '') rlike concat('^(?:', event_rule, ')')"))
    named = wanted.select("repo", F.col("hash").alias("given"), "name", "published", "author", F.substring("hash", 1, 7).alias("short"), F.monotonically_increasing_id().alias("tw_note"))
    known = commits.select("repo", "sha", "hash", F.substring("hash", 1, 7).alias("short"))
    found = named.join(known, ["repo", "short"]).where("given = hash or given = short")
    return found.groupBy("tw_note", "repo", "name", "published", "author").agg(F.min("sha").alias("sha")).select("repo", "sha", "name", "published", "author")


def releases_by_settings(h: graph.History, tagged: DataFrame, notes: DataFrame, settings: DataFrame, since: int, until: int, around: int = AROUND) -> DataFrame:
    """(repo, sha, matched_by, name, published, author): the releases of the window, each repository's by the match that applies to it.

    settings: (repo, match, tag_rule, branch_rule, event_rule), one row a
    repository. A repository has releases of one kind, so the three kinds are
    unioned without a distinct; branch releases have no name.
    """
    own = tagged_releases(tagged, settings)
    applied = applied_matches(settings, own, since, until, around)
    of = lambda kind: applied.where(F.col("applied") == kind)
    by_tag = own.where((F.col("published") >= since) & (F.col("published") < until)).join(of("tag").select("repo"), "repo", "left_semi")
    by_branch = releases_by_branch(h, of("branch").select("repo", F.col("branch_rule").alias("pattern")), F.lit(since), F.lit(until)).withColumn("name", F.lit(None).cast("string"))
    commits = h.rows.select("repo", "sha", F.md5(F.col("sha").cast("string").cast("binary")).alias("hash"))
    by_event = pushed_releases(notes, commits, of("event"), since, until)
    kinds = (("tag", by_tag), ("branch", by_branch), ("event", by_event))
    parts = [rows.select("repo", "sha", F.lit(kind).alias("matched_by"), "name", "published", "author") for kind, rows in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stand_in_settings(repos: DataFrame) -> DataFrame:
    """Settings by repository: each fourth by event, each fourth by tag, the others by tag or branch; patterns differ."""
    repo = F.col("repo")
    return repos.select(
        "repo", F.when(repo % 4 == 0, "event").when(repo % 4 == 1, "tag").otherwise("tag_or_branch").alias("match"), F.when(repo % 3 == 0, "v[0-4]").otherwise("v9").alias("tag_rule"),
        F.when(repo % 2 == 0, "ma(ster|in)|release-[0-2]").otherwise("trunk|release-.*").alias("branch_rule"), F.when(repo % 3 == 0, "v[0-6]").otherwise(".*[13579]").alias("event_rule"),
    )


def stand_in_notes(actions: DataFrame) -> DataFrame:
    """Error events as notifications of an earlier event of about their id: even ones by the short hash, odd ones by the whole; some without a name."""
    digest = F.md5(F.expr("event_id - event_id % 7").cast("string").cast("binary"))
    given = F.when(F.col("event_id") % 2 == 0, F.substring(digest, 1, 7)).otherwise(digest)
    name = F.when(F.col("lines") % 13 != 0, F.concat(F.lit("v"), F.expr("lines div 10").cast("string")))
    return actions.where("topic = 'error'").select(F.col("user_id").alias("repo"), given.alias("hash"), name.alias("name"), F.col("started").alias("published"), (F.col("lines") % 17).alias("author"))


_SETTINGS = """settings AS (SELECT DISTINCT repo, CASE repo % 4 WHEN 0 THEN 'event' WHEN 1 THEN 'tag' ELSE 'tag_or_branch' END AS match, CASE WHEN repo % 3 = 0 THEN 'v[0-4]' ELSE 'v9' END AS tag_rule, CASE WHEN repo % 2 = 0 THEN 'ma(ster|in)|release-[0-2]' ELSE 'trunk|release-.*' END AS branch_rule, CASE WHEN repo % 3 = 0 THEN 'v[0-6]' ELSE '.*[13579]' END AS event_rule FROM commits),
own_tags AS (SELECT t.* FROM tags t JOIN settings USING (repo) WHERE regexp_full_match(tag, tag_rule))"""


def _applied(since: int, until: int) -> str:
    return f"applied AS (SELECT s.*, CASE WHEN match <> 'tag_or_branch' THEN match WHEN EXISTS (SELECT 1 FROM own_tags t WHERE t.repo = s.repo AND t.published >= {since} AND t.published < {until}) THEN 'tag' ELSE 'branch' END AS applied FROM settings s)"


def _tagged(h: graph.History) -> DataFrame:
    return tags(h.rows).withColumn("author", F.col("k") % 17)


#: Windows of the queries: the stand-in history spans January 2024, so the first lies two weeks after its end.
_LATE = seconds(dt.date(2024, 2, 19)), seconds(dt.date(2024, 2, 26))
_MIDDLE, _NEAR = (seconds(dt.date(2024, 1, 10)), seconds(dt.date(2024, 1, 24))), 2 * 86400


@query("commits", "SELECT repo, applied AS matched_by FROM applied", f"{_SETTINGS}, {_applied(_LATE[0] - AROUND, _LATE[1] + AROUND)}")
def r13_applied_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each repository is matched by in a week of February 2024, with four weeks around it."""
    h = past(spark, sf_dir)
    settings = stand_in_settings(h.rows.select("repo").distinct())
    return applied_matches(settings, tagged_releases(_tagged(h), settings), *_LATE).select("repo", F.col("applied").alias("matched_by"))


_ALL_KINDS = f"""SELECT t.repo, t.sha, 'tag' AS matched_by, t.tag AS name, t.published, t.k % 17 AS author FROM own_tags t JOIN applied a ON a.repo = t.repo AND applied = 'tag' WHERE published >= {_MIDDLE[0]} AND published < {_MIDDLE[1]}
UNION ALL SELECT c.repo, c.sha, 'branch', NULL, c.started, CASE WHEN c.is_merge AND c.k % 4 = 0 THEN c.k % 13 ELSE c.k % 17 END FROM commits c WHERE (c.sha IN (SELECT sha FROM walked) OR (c.is_merge AND EXISTS (SELECT 1 FROM picked p WHERE p.repo = c.repo AND p.chain = c.chain))) AND c.started >= {_MIDDLE[0]} AND c.started < {_MIDDLE[1]}
UNION ALL SELECT n.repo, (SELECT min(c.sha) FROM commits c WHERE c.repo = n.repo AND (md5(CAST(c.sha AS VARCHAR)) = n.given OR substr(md5(CAST(c.sha AS VARCHAR)), 1, 7) = n.given)) AS sha, 'event', n.name, n.published, n.author FROM notes n JOIN applied a ON a.repo = n.repo AND applied = 'event' WHERE published BETWEEN {_MIDDLE[0]} AND {_MIDDLE[1]} AND regexp_matches(coalesce(name, ''), '^(' || event_rule || ')') AND EXISTS (SELECT 1 FROM commits c WHERE c.repo = n.repo AND substr(md5(CAST(c.sha AS VARCHAR)), 1, length(n.given)) = n.given)"""
_NOTES = "notes AS (SELECT user_id AS repo, substr(md5(CAST(event_id - event_id % 7 AS VARCHAR)), 1, CASE WHEN event_id % 2 = 0 THEN 7 ELSE 32 END) AS given, CASE WHEN k % 13 <> 0 THEN 'v' || (k // 10) END AS name, started AS published, k % 17 AS author FROM ev WHERE event_type = 'error')"
_WALKED = f"{_BRANCHES}, picked AS (SELECT h.* FROM heads h JOIN applied a ON a.repo = h.repo AND applied = 'branch' WHERE regexp_full_match(name, branch_rule)), walked(sha) AS (SELECT sha FROM picked UNION SELECT parent FROM walked JOIN edges ON child = walked.sha AND idx = 0)"


@query("commits", _ALL_KINDS, f"{_SETTINGS}, {_applied(_MIDDLE[0] - _NEAR, _MIDDLE[1] + _NEAR)}, {_NOTES}, {_WALKED}")
def r13_releases_by_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases of two weeks of January 2024 by tag, branch and notification; tags count from two days around, as the stand-in spans one month."""
    h = past(spark, sf_dir)
    settings = stand_in_settings(h.rows.select("repo").distinct())
    return releases_by_settings(h, _tagged(h), stand_in_notes(facts(spark, sf_dir, "actions")), settings, *_MIDDLE, around=_NEAR)
