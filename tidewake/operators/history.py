"""Commit graph, releases and deployments over the stand-in history of the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import facts, query
from . import dag, graph

#: Days of the windows below; the stand-in history spans about a month.
SPAN = 10 * 86400


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, "commits")


def past(spark: SparkSession, sf_dir: str) -> graph.History:
    return graph.history_of(spark, sf_dir, commits(spark, sf_dir))


def tags(rows: DataFrame) -> DataFrame:
    """Tagged commits: purchases on the main branch; the tag's name comes from k, so names repeat."""
    return rows.where("kind = 'purchase' and branch = 0").select("sha", "repo", F.col("started").alias("published"), F.concat(F.lit("v"), (F.col("k") / 10).cast("int").cast("string")).alias("tag"), "k")


def pulls(rows: DataFrame) -> DataFrame:
    """Merged pull requests: merges of the side branch into the main one."""
    return rows.where("is_merge and branch = 0").select(F.col("sha").alias("pr"), "repo", F.col("started").alias("merged"), "k")


def heads_of(found: DataFrame) -> DataFrame:
    """Heads ranked by time: (head, sha, rank)."""
    return found.select(F.col("sha").alias("head"), "sha", (F.col("published") * 10_000_000 + F.col("sha")).alias("rank"))


def ownership(h: graph.History) -> DataFrame:
    return dag.owners(h.graph, heads_of(tags(h.rows)))


_ANC = "anc(head, sha) AS (SELECT sha, sha FROM tags UNION SELECT head, parent FROM anc JOIN edges ON child = sha)"
_OWN = f"{_ANC}, own AS (SELECT a.sha, arg_min(a.head, t.published * 10000000 + t.sha) AS owner FROM anc a JOIN tags t ON t.sha = a.head GROUP BY 1)"


@query("commits", "SELECT child, parent, idx AS parent_index FROM edges")
def g00_commit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge table of the commit graph."""
    return graph.edges_of(commits(spark, sf_dir)).select("child", "parent", "parent_index")


@query("commits", "SELECT sha, arg_max(sha, started * 10000000 + sha) OVER w = sha AS newest, count(*) OVER (PARTITION BY repo, chain ORDER BY started, sha ROWS UNBOUNDED PRECEDING) AS pos FROM commits WINDOW w AS (PARTITION BY repo, chain)")
def g00_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each commit's place on the chain computed from edges, and whether it ends it; here chains are the branches that the edges came from."""
    h = past(spark, sf_dir)
    ends = h.graph.commits.groupBy("chain").agg(F.max("pos").alias("top"))
    return h.graph.commits.join(ends, "chain").select("sha", (F.col("pos") == F.col("top")).alias("newest"), "pos")


@query("commits", "SELECT sha FROM anc", "main(sha) AS (SELECT arg_max(sha, started * 10000000 + sha) FROM commits WHERE chain = 0 GROUP BY repo), anc(sha) AS (SELECT sha FROM main UNION SELECT parent FROM anc JOIN edges ON child = sha)")
def g01_reachable_from_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of the head of each repository's main branch."""
    h = past(spark, sf_dir)
    main = h.rows.where("branch = 0").groupBy("repo").agg(F.max_by("sha", "n").alias("sha"))
    return dag.commits_of(h.graph, dag.reach(h.graph, main.select(F.col("sha").alias("head"), "sha"))).select("sha")


@query("commits", "SELECT sha, owner FROM own", _OWN)
def g02_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each commit with the earliest tagged commit that reaches it."""
    return ownership(past(spark, sf_dir)).select("sha", "owner")


@query("commits", "SELECT DISTINCT a.owner AS head, b.owner AS parent FROM edges JOIN own a ON a.sha = child JOIN own b ON b.sha = edges.parent WHERE a.owner <> b.owner AND a.owner NOT IN (SELECT owner FROM own WHERE sha NOT IN (SELECT child FROM edges))", _OWN)
def g03_parents_between_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older heads met first on the way down from each head; heads that own a root have none."""
    h = past(spark, sf_dir)
    return dag.heads_between(h.edges, ownership(h).select("sha", "owner"))


@query("commits", "SELECT m.sha AS pr, m.sha AS sha FROM merges m UNION SELECT s.pr, s.sha FROM side s WHERE NOT EXISTS (SELECT 1 FROM mainline x WHERE x.pr = s.pr AND x.sha = s.sha)", """merges AS (SELECT c.sha, e0.parent AS main, e1.parent AS branch FROM commits c JOIN edges e1 ON e1.child = c.sha AND e1.idx = 1 LEFT JOIN edges e0 ON e0.child = c.sha AND e0.idx = 0 WHERE chain = 0),
side(pr, sha) AS (SELECT sha, branch FROM merges UNION SELECT pr, parent FROM side JOIN edges ON child = side.sha), mainline(pr, sha) AS (SELECT sha, main FROM merges WHERE main IS NOT NULL UNION SELECT pr, parent FROM mainline JOIN edges ON child = mainline.sha)""")
def g04_commits_of_pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged request's commits: ancestors of the side parent that the main parent doesn't reach, and the merge."""
    return pull_commits(past(spark, sf_dir)).select("pr", "sha")


def pull_commits(h: graph.History) -> DataFrame:
    """(pr, sha): a commit belongs to the first commit of the main branch that reaches it, so one pass finds those of all merges."""
    main = h.rows.where("branch = 0").select(F.col("sha").alias("head"), "sha", F.col("n").alias("rank"))
    return dag.owners(h.graph, main).select(F.col("owner").alias("pr"), "sha").join(pulls(h.rows).select("pr"), "pr", "left_semi")


@query("commits", "SELECT sha, depth FROM chain_walk", "top(sha) AS (SELECT arg_max(sha, started * 10000000 + sha) FROM commits GROUP BY repo, chain), chain_walk(sha, depth) AS (SELECT sha, 0 FROM top UNION SELECT parent, depth + 1 FROM chain_walk JOIN edges ON child = sha AND idx = 0)")
def g05_first_parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk down first parents from each branch head, to the end."""
    h = past(spark, sf_dir)
    top = h.rows.groupBy(*graph.REPO_BRANCH).agg(F.max_by("sha", "n").alias("sha"))
    return dag.first_parents(h.graph, h.edges, top.select(F.col("sha").alias("head"), "sha")).select("sha", "depth")


@query("commits", "SELECT head, sha FROM anc WHERE NOT EXISTS (SELECT 1 FROM below b WHERE b.head = anc.head AND b.sha = anc.sha)", f"{_ANC}, stops AS (SELECT sha AS head, lag(sha) OVER (PARTITION BY repo, k % 3 ORDER BY published, sha) AS stop FROM tags), below(head, sha) AS (SELECT head, stop FROM stops WHERE stop IS NOT NULL UNION SELECT head, parent FROM below JOIN edges ON child = below.sha)")
def g06_independent_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tag, its ancestors that the tag before it in its own line (k mod 3) doesn't reach."""
    h = past(spark, sf_dir)
    found = tags(h.rows)
    w = Window.partitionBy("repo", F.col("k") % 3).orderBy("published", "sha")
    stops = found.withColumn("stop", F.lag("sha").over(w)).where("stop is not null").select(F.col("sha").alias("head"), F.col("stop").alias("sha"))
    return dag.commits_of(h.graph, dag.reach(h.graph, found.select(F.col("sha").alias("head"), "sha")), dag.reach(h.graph, stops))


@query("commits", "SELECT parent AS sha, count(*) AS n_children, min(child) AS first_child, max(child) AS last_child FROM edges GROUP BY 1")
def g07_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_of(commits(spark, sf_dir)).groupBy(F.col("parent").alias("sha")).agg(F.count("*").alias("n_children"), F.min("child").alias("first_child"), F.max("child").alias("last_child"))


@query("commits", "SELECT repo, count(*) AS edges, count(CASE WHEN parent NOT IN (SELECT sha FROM present) THEN 1 END) AS dangling, count(DISTINCT CASE WHEN child NOT IN (SELECT sha FROM present) THEN child END) AS unknown_children FROM (SELECT e.*, c.repo FROM edges e JOIN commits c ON c.sha = e.child) GROUP BY 1", "present AS (SELECT sha FROM commits WHERE k % 13 <> 0)")
def g08_integrity_of_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges joined from two loads, against the commits that arrived (here all but k divisible by 13): dangling parents and unknown children."""
    rows = commits(spark, sf_dir)
    all_edges = graph.edges_of(rows)
    known, new = all_edges.where("child % 2 = 0"), all_edges.where("child % 3 = 0 or child % 2 = 1")
    edges = known.unionByName(new).dropDuplicates(["child", "parent", "parent_index"])
    present = rows.where("k % 13 <> 0").select("sha")
    there = lambda c: edges.join(present.withColumnRenamed("sha", c), c, "left_anti")
    counts = edges.groupBy("repo").agg(F.count("*").alias("edges"))
    dangling = there("parent").groupBy("repo").agg(F.count("*").alias("dangling"))
    unknown = there("child").groupBy("repo").agg(F.countDistinct("child").alias("unknown_children"))
    return counts.join(dangling, "repo", "left").join(unknown, "repo", "left").fillna(0, ["dangling", "unknown_children"])


@query("commits", "SELECT repo, count(DISTINCT sha) AS commits, count(DISTINCT branch) AS branches FROM (SELECT b.repo, b.chain AS branch, a.sha FROM anc a JOIN top b ON b.sha = a.head) GROUP BY 1", "top AS (SELECT repo, chain, arg_max(sha, started * 10000000 + sha) AS sha FROM commits GROUP BY ALL), anc(head, sha) AS (SELECT sha, sha FROM top UNION SELECT head, parent FROM anc JOIN edges ON child = sha)")
def g09_commits_of_all_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that the heads of a repository's branches reach, and the number of branches."""
    h = past(spark, sf_dir)
    top = h.rows.groupBy(*graph.REPO_BRANCH).agg(F.max_by("sha", "n").alias("sha"))
    extent = dag.reach(h.graph, top.select(F.col("repo").alias("head"), "sha"))
    return extent.groupBy(F.col("head").alias("repo")).agg(F.sum("upto").alias("commits")).join(top.groupBy("repo").agg(F.count("*").alias("branches")), "repo")


@query("commits", "SELECT e.child, e.parent, e.idx AS parent_index, b.sha IS NOT NULL AS seed FROM lossy e JOIN bad USING (child) LEFT JOIN seeds b ON b.sha = e.child", "lossy AS (SELECT e.child, CASE WHEN c.k = 7 AND c.kind = 'signup' THEN NULL ELSE e.parent END AS parent, e.idx FROM edges e JOIN commits c ON c.sha = e.parent WHERE NOT (e.idx = 0 AND e.child % 149 = 0 AND EXISTS (SELECT 1 FROM edges o WHERE o.child = e.child AND o.idx = 1))), seeds AS (SELECT child AS sha FROM lossy GROUP BY 1 HAVING count(*) <> count(parent) OR max(idx) + 1 <> count(*)), bad(child) AS (SELECT sha FROM seeds UNION SELECT l.child FROM bad b JOIN lossy l ON l.parent = b.child)")
def g08_tainted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that a lossy load taints: here it drops some parents, and the first of some merges' two."""
    h = past(spark, sf_dir)
    odd = h.rows.select(F.col("sha").alias("parent"), F.expr("k = 7 and kind = 'signup'").alias("lost"))
    merges = h.edges.where("parent_index = 1").select("child")
    half = h.edges.where("parent_index = 0 and child % 149 = 0").join(merges, "child", "left_semi").select("child", "parent_index")
    lossy = h.edges.join(odd, "parent").select("child", F.when(~F.col("lost"), F.col("parent")).alias("parent"), "parent_index").join(half, ["child", "parent_index"], "left_anti")
    return dag.tainted_edges(lossy, commits=h.rows.select("sha", F.col("repo").alias("near")))


@query("commits", "SELECT root, sha AS child FROM up WHERE sha <> root", "partial AS (SELECT e.child, e.parent FROM edges e JOIN commits c ON c.sha = e.child WHERE c.k % 23 <> 0), up(root, sha) AS (SELECT DISTINCT parent, parent FROM partial WHERE parent NOT IN (SELECT child FROM partial) AND parent IN (SELECT child FROM edges) UNION SELECT root, child FROM up JOIN partial ON parent = sha)")
def g08_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs on commits whose parents a partial load lacks (k divisible by 23); true roots are known and attach."""
    h = past(spark, sf_dir)
    partial = h.edges.join(h.rows.where("k % 23 <> 0").select(F.col("sha").alias("child")), "child", "left_semi")
    known = h.rows.select("sha").join(h.edges.select(F.col("child").alias("sha")), "sha", "left_anti")
    return dag.orphans(partial, known, h.rows.select("sha", F.col("repo").alias("near")))


_RULE = "CASE repo % 3 WHEN 0 THEN 'v[0-4]' WHEN 1 THEN 'v.*' ELSE '.*[13579]' END"
_MATCHED = f"matched AS (SELECT * FROM tags WHERE regexp_full_match(tag, {_RULE})), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, tag ORDER BY published, sha) AS r FROM matched) WHERE r = 1)"


def matched_tags(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Tags that their repository's rule matches in full."""
    rules = spark.createDataFrame([(0, "v[0-4]"), (1, "v.*"), (2, ".*[13579]")], "kind long, rule string")
    return tags(rows).join(F.broadcast(rules), F.col("repo") % 3 == F.col("kind")).where(F.expr("tag rlike concat('^(', rule, ')$')")).drop("kind", "rule")


def distinct_tags(found: DataFrame) -> DataFrame:
    """One row a tag of a repository, the oldest; null tags stay."""
    w = Window.partitionBy("repo", "tag").orderBy("published", "sha")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1 or tag is null").drop("r")


@query("commits", "SELECT sha, repo, tag FROM matched", _MATCHED)
def r10_match_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases by a regular expression on tags, one rule a kind of repository."""
    return matched_tags(spark, commits(spark, sf_dir)).select("sha", "repo", "tag")


@query("commits", "SELECT sha, repo, started AS published FROM commits WHERE chain = 0 AND started >= (SELECT max(started) - 864000 FROM commits)")
def r11_match_by_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each first-parent commit of the main branch in the last ten days is a release."""
    rows = commits(spark, sf_dir)
    end = rows.agg(F.max("started").alias("end"))
    return rows.where("branch = 0").join(F.broadcast(end), F.expr(f"started >= end - {SPAN}")).select("sha", "repo", F.col("started").alias("published"))


_BRANCHES = "heads AS (SELECT repo, chain, CASE WHEN chain = 0 AND repo % 3 = 0 THEN 'master' WHEN chain = 0 AND repo % 3 = 1 THEN 'main' WHEN chain = 0 THEN 'trunk' ELSE 'release-' || (repo % 4) END AS name, arg_max(sha, started * 10000000 + sha) AS sha FROM commits GROUP BY ALL)"


def branches(h: graph.History) -> DataFrame:
    """(repo, branch, name, sha): the branches of each repository with their heads."""
    name = F.expr("case when branch = 0 and repo % 3 = 0 then 'master' when branch = 0 and repo % 3 = 1 then 'main' when branch = 0 then 'trunk' else concat('release-', repo % 4) end")
    return h.rows.groupBy("repo", "branch", name.alias("name")).agg(F.max_by("sha", "n").alias("sha"))


def releases_by_branch(h: graph.History, wanted: DataFrame, since: Column, until: Column) -> DataFrame:
    """(sha, repo, published, author): commits that count as releases of the branches whose name matches their repository's pattern in full. wanted: (repo, pattern).

    The walk down first parents from each matched head, and the merges of requests
    into the branch, each commit once; those published from ``since`` to before
    ``until``. Whoever committed is the author, but for a merge made on the site
    (here k divisible by 4), whose author is the request's.
    """
    matched = branches(h).join(wanted, "repo").where(F.expr("name rlike concat('^(', pattern, ')$')"))
    walk = dag.first_parents(h.graph, h.edges, matched.select(F.col("sha").alias("head"), "sha")).select("sha")
    merges = h.rows.where("is_merge").join(matched.select("repo", "branch"), ["repo", "branch"], "left_semi").select("sha")
    found = h.rows.join(walk.unionByName(merges).distinct(), "sha", "left_semi").withColumnRenamed("started", "published")
    author = F.when(F.col("is_merge") & (F.col("k") % 4 == 0), F.col("k") % 13).otherwise(F.col("k") % 17)
    return found.where((F.col("published") >= since) & (F.col("published") < until)).select("sha", "repo", "published", author.alias("author"))


@query("commits", "SELECT DISTINCT c.sha, c.repo, c.started AS published, CASE WHEN c.is_merge AND c.k % 4 = 0 THEN c.k % 13 ELSE c.k % 17 END AS author FROM commits c WHERE (c.sha IN (SELECT sha FROM down_first) OR (c.is_merge AND EXISTS (SELECT 1 FROM picked p WHERE p.repo = c.repo AND p.chain = c.chain))) AND c.started >= 1704844800 AND c.started < 1706054400", _BRANCHES + ", picked AS (SELECT * FROM heads WHERE regexp_full_match(name, CASE repo % 2 WHEN 0 THEN 'ma(ster|in)|release-[0-2]' ELSE 'trunk|release-.*' END)), down_first(sha) AS (SELECT sha FROM picked UNION SELECT parent FROM down_first JOIN edges ON child = down_first.sha AND idx = 0)")
def r11_releases_by_branch_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases by branch patterns, one a kind of repository, published in two weeks of January 2024."""
    h = past(spark, sf_dir)
    wanted = h.rows.select("repo").distinct().withColumn("pattern", F.when(F.col("repo") % 2 == 0, "ma(ster|in)|release-[0-2]").otherwise("trunk|release-.*"))
    return releases_by_branch(h, wanted, F.lit(1704844800), F.lit(1706054400))


@query("commits", "SELECT n.event_id AS notification, min(c.sha) AS sha FROM ev n JOIN commits c ON c.repo = n.user_id AND substr(md5(CAST(c.sha AS VARCHAR)), 1, 7) = substr(md5(CAST(n.event_id - n.event_id % 7 AS VARCHAR)), 1, 7) WHERE n.event_type = 'error' GROUP BY 1")
def r12_releases_from_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushed notifications that name a commit by a short hash, resolved in their repository."""
    short = lambda c: F.substring(F.md5(c.cast("string").cast("binary")), 1, 7)
    rows, notes = commits(spark, sf_dir), facts(spark, sf_dir, "actions").where("topic = 'error'")
    named = notes.select(F.col("event_id").alias("notification"), F.col("user_id").alias("repo"), short(F.expr("event_id - event_id % 7")).alias("short"))
    return named.join(rows.select("repo", "sha", short(F.col("sha")).alias("short")), ["repo", "short"]).groupBy("notification").agg(F.min("sha").alias("sha"))


@query("commits", "SELECT repo, CASE WHEN bool_or(m.sha IS NOT NULL) THEN 'tag' ELSE 'branch' END AS matched_by FROM commits LEFT JOIN (SELECT sha FROM matched WHERE published >= (SELECT max(started) - 864000 FROM commits)) m USING (sha) GROUP BY 1", _MATCHED)
def r13_tag_or_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories with a matching tag around the window (the last ten days here) release by tag, the others by branch."""
    rows = commits(spark, sf_dir)
    end = rows.agg(F.max("started").alias("end"))
    recent = matched_tags(spark, rows).join(F.broadcast(end), F.expr(f"published >= end - {SPAN}")).select("repo").distinct()
    repos = rows.select("repo").distinct()
    return repos.join(recent, "repo", "left_semi").select("repo", F.lit("tag").alias("matched_by")).unionByName(repos.join(recent, "repo", "left_anti").select("repo", F.lit("branch").alias("matched_by")))


@query("commits", "SELECT sha, repo, tag FROM kept", _MATCHED)
def r14_distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_tags(matched_tags(spark, commits(spark, sf_dir))).select("sha", "repo", "tag")


_MINED = f"{_OWN}, mined AS (SELECT t.sha AS release, t.repo, t.tag, t.published, count(*) AS commits, count(DISTINCT c.k % 17) AS authors, CAST(sum(c.k) AS BIGINT) AS lines, count(CASE WHEN c.is_merge AND c.chain = 0 THEN 1 END) AS prs, t.published - coalesce(lag(t.published) OVER (PARTITION BY t.repo ORDER BY t.published, t.sha), min(c.started)) AS age FROM tags t JOIN own o ON o.owner = t.sha JOIN commits c ON c.sha = o.sha GROUP BY t.sha, t.repo, t.tag, t.published)"


def mined_releases(h: graph.History, own: DataFrame | None = None) -> DataFrame:
    """Releases with what they own: commits, authors, lines, requests, age since the release before (the first: since its first commit)."""
    own, rows = (ownership(h) if own is None else own).select("sha", "owner"), h.rows
    held = own.join(rows.select("sha", "k", "started", "is_merge", "branch"), "sha").groupBy(F.col("owner").alias("sha")).agg(
        F.count("*").alias("commits"), F.countDistinct(F.col("k") % 17).alias("authors"), F.sum("k").alias("lines"), F.count(F.when(F.col("is_merge") & (F.col("branch") == 0), 1)).alias("prs"), F.min("started").alias("began")
    )
    before = F.lag("published").over(Window.partitionBy("repo").orderBy("published", "sha"))
    return tags(rows).join(held, "sha").withColumn("age", F.col("published") - F.coalesce(before, "began")).withColumnRenamed("sha", "release")


@query("commits", "SELECT release, repo, commits, authors, lines, prs, age FROM mined", _MINED)
def r15_mined_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined_releases(past(spark, sf_dir)).select("release", "repo", "commits", "authors", "lines", "prs", "age")


@query("commits", "SELECT DISTINCT o.owner AS release FROM own o JOIN commits c USING (sha) WHERE c.k % 17 IN (3, 5)", _OWN)
def r09_r16_releases_by_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases with a commit by one of the wanted authors."""
    h = past(spark, sf_dir)
    return ownership(h).join(h.rows.where(F.expr("k % 17 in (3, 5)")).select("sha"), "sha", "left_semi").select(F.col("owner").alias("release")).distinct()


@query("commits", "SELECT release, repo, tag, commits, age FROM mined WHERE (repo % 2 = 0 AND tag = 'v3') OR (repo % 2 = 1 AND tag IN ('v1', 'v7'))", _MINED)
def r17_releases_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(0, "v3"), (1, "v1"), (1, "v7")], "odd long, tag string")
    found = mined_releases(past(spark, sf_dir)).withColumn("odd", F.col("repo") % 2)
    return found.join(F.broadcast(names), ["odd", "tag"]).select("release", "repo", "tag", "commits", "age")


@query("commits", "SELECT b.repo, t.sha AS release FROM ends a JOIN ends b ON a.repo = b.repo AND a.tag = 'v2' AND b.tag = 'v8' AND a.published < b.published JOIN tags t ON t.repo = b.repo AND t.published > a.published AND t.published <= b.published WHERE EXISTS (SELECT 1 FROM anc WHERE head = b.sha AND anc.sha = t.sha) AND EXISTS (SELECT 1 FROM anc WHERE head = b.sha AND anc.sha = a.sha)", f"{_ANC}, ends AS (SELECT repo, tag, min(published) AS published, arg_min(sha, published * 10000000 + sha) AS sha FROM tags GROUP BY ALL)")
def r18_release_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases after v2 up to v8 of each repository that v8 reaches, where it reaches v2."""
    h = past(spark, sf_dir)
    found = tags(h.rows)
    ends = distinct_tags(found)
    side = lambda tag, to: ends.where(F.col("tag") == tag).select("repo", F.col("sha").alias(f"{to}_sha"), F.col("published").alias(to))
    pairs = side("v2", "since").join(side("v8", "until"), "repo").where("since < until")
    extent = dag.reach(h.graph, pairs.select(F.col("until_sha").alias("head"), F.col("until_sha").alias("sha"))).withColumnRenamed("head", "until_sha")
    at = lambda c: h.graph.commits.select(F.col("sha").alias(c), "chain", "pos")
    held = pairs.join(at("since_sha"), "since_sha").join(extent, ["until_sha", "chain"]).where("pos <= upto").select("repo", "until_sha", "since", "until")
    within = held.join(found.select("repo", F.col("sha").alias("release"), "published"), "repo").where("published > since and published <= until")
    return within.join(at("release"), "release").join(extent, ["until_sha", "chain"]).where("pos <= upto").select("repo", "release")


@query("commits", "SELECT repo, arg_min(release, published * 10000000 + release) AS release FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY published, release) AS r FROM mined) GROUP BY 1 HAVING count(*) >= 3 AND min(CASE WHEN r = 1 THEN age END) >= 2 * median(CASE WHEN r > 1 THEN age END)", _MINED)
def r19_outlier_first_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First releases far older than the median of the others (twice here, as the stand-in ages vary little)."""
    w = Window.partitionBy("repo").orderBy("published", "release")
    ranked = mined_releases(past(spark, sf_dir)).withColumn("r", F.row_number().over(w))
    cells = ranked.groupBy("repo").agg(F.count("*").alias("n"), F.min_by("release", "r").alias("release"), F.min_by("age", "r").alias("first"), F.median(F.when(F.col("r") > 1, F.col("age"))).alias("usual"))
    return cells.where("n >= 3 and first >= 2 * usual").select("repo", "release")


@query("commits", "SELECT c.sha AS pr, o.owner AS release, greatest(t.published, c.started) AS released FROM commits c JOIN own o ON o.sha = c.sha JOIN tags t ON t.sha = o.owner WHERE c.is_merge AND c.chain = 0", _OWN)
def r20_pull_requests_to_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each merged request goes to the release that owns its merge commit."""
    return released_pulls(past(spark, sf_dir)).select("pr", "release", "released")


def released_pulls(h: graph.History, own: DataFrame | None = None) -> DataFrame:
    own, found = ownership(h) if own is None else own, tags(h.rows)
    to = pulls(h.rows).join(own.select(F.col("sha").alias("pr"), F.col("owner").alias("release")), "pr")
    return to.join(found.select(F.col("sha").alias("release"), "published"), "release").withColumn("released", F.greatest("published", "merged"))


@query("commits", "SELECT c.sha AS pr, o.owner AS release FROM commits c JOIN own o ON o.sha = c.sha JOIN tags t ON t.sha = o.owner, (SELECT max(started) - 864000 AS since FROM commits) WHERE c.is_merge AND c.chain = 0 AND c.started < since AND t.published >= since", _OWN)
def r21_released_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests merged before the window (the last ten days) and released in it."""
    h = past(spark, sf_dir)
    since = h.rows.agg((F.max("started") - SPAN).alias("since"))
    return released_pulls(h).join(F.broadcast(since), F.expr("merged < since and published >= since")).select("pr", "release")


@query("commits", "SELECT repo, arg_min(name, CASE WHEN name = 'master' THEN 0 WHEN name = 'main' THEN 1 ELSE 2 END * 1000000000000 - last) AS default_branch FROM (SELECT repo, CASE WHEN chain = 0 AND repo % 3 = 0 THEN 'master' WHEN chain = 0 AND repo % 3 = 1 THEN 'main' WHEN chain = 0 THEN 'trunk' ELSE 'side' END AS name, max(started) AS last FROM commits GROUP BY ALL) GROUP BY 1")
def r22_default_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """master, else main, else the branch with the newest head."""
    name = F.expr("case when branch = 0 and repo % 3 = 0 then 'master' when branch = 0 and repo % 3 = 1 then 'main' when branch = 0 then 'trunk' else 'side' end")
    branches = commits(spark, sf_dir).groupBy("repo", name.alias("name")).agg(F.max("started").alias("last"))
    first = F.when(F.col("name") == "master", 0).when(F.col("name") == "main", 1).otherwise(2)
    w = Window.partitionBy("repo").orderBy(first, F.desc("last"), "name")
    return branches.withColumn("r", F.row_number().over(w)).where("r = 1").select("repo", F.col("name").alias("default_branch"))


def rollouts(rows: DataFrame) -> DataFrame:
    """Deployments of the graph: purchases, with the commit that they deploy (itself)."""
    return rows.where("kind = 'purchase'").select("sha", "repo", (F.col("k") % 3).alias("env"), F.col("started").alias("published"), "k", F.expr("case when k % 10 = 0 then 'FAILURE' when k % 10 = 1 then 'CANCELLED' else 'SUCCESS' end").alias("conclusion"))


_ROLL = "rolls AS (SELECT sha, repo, k % 3 AS env, started AS published, k, CASE k % 10 WHEN 0 THEN 'FAILURE' WHEN 1 THEN 'CANCELLED' ELSE 'SUCCESS' END AS conclusion FROM commits WHERE kind = 'purchase')"
_DEP = f"{_ROLL}, danc(head, sha) AS (SELECT sha, sha FROM rolls WHERE conclusion = 'SUCCESS' UNION SELECT head, parent FROM danc JOIN edges ON child = sha), down AS (SELECT r.env, a.sha, arg_min(a.head, r.published * 10000000 + r.sha) AS deployment FROM danc a JOIN rolls r ON r.sha = a.head GROUP BY ALL)"


def deployed(h: graph.History) -> DataFrame:
    """(env, sha, deployment): the earliest successful deployment of each environment that reaches a commit."""
    good = rollouts(h.rows).where("conclusion = 'SUCCESS'")
    return dag.owners(h.graph, good.select("env", F.col("sha").alias("head"), "sha", (F.col("published") * 10_000_000 + F.col("sha")).alias("rank")), ["env"]).select("env", "sha", F.col("owner").alias("deployment"))


@query("commits", "SELECT env, sha, deployment FROM down", _DEP)
def d11_commits_of_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deployed(past(spark, sf_dir))


@query("commits", "SELECT r.env, f.sha, f.head AS deployment FROM fanc f JOIN rolls r ON r.sha = f.head LEFT JOIN down d ON d.env = r.env AND d.sha = f.sha LEFT JOIN rolls o ON o.sha = d.deployment WHERE o.sha IS NULL OR o.published * 10000000 + o.sha > r.published * 10000000 + r.sha", _DEP + ", fanc(head, sha) AS (SELECT sha, sha FROM rolls WHERE conclusion <> 'SUCCESS' UNION SELECT head, parent FROM fanc JOIN edges ON child = sha)")
def d11_commits_of_failed_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each deployment that didn't succeed would have brought: commits that no earlier success of its environment reaches."""
    h = past(spark, sf_dir)
    ranked = rollouts(h.rows).select("env", F.col("sha").alias("head"), "sha", (F.col("published") * 10_000_000 + F.col("sha")).alias("rank"), "conclusion")
    marks = dag.settled(h.graph, ranked.where("conclusion = 'SUCCESS'").drop("conclusion"), ["env"])
    failed = ranked.where("conclusion <> 'SUCCESS'").drop("conclusion")
    return dag.brought(h.graph, failed, marks, ["env"]).join(failed.select("head", "env"), "head").select("env", "sha", F.col("head").alias("deployment"))


@query("commits", "SELECT d.deployment, count(*) AS commits, count(CASE WHEN c.is_merge AND c.chain = 0 THEN 1 END) AS prs, CAST(sum(c.k) AS BIGINT) AS lines, count(DISTINCT c.k % 17) AS authors FROM down d JOIN commits c USING (sha) GROUP BY 1", _DEP)
def d12_deployment_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each successful deployment brings: commits, requests by merge commit, lines, authors."""
    h = past(spark, sf_dir)
    held = deployed(h).join(h.rows.select("sha", "k", "is_merge", "branch"), "sha")
    return held.groupBy("deployment").agg(F.count("*").alias("commits"), F.count(F.when(F.col("is_merge") & (F.col("branch") == 0), 1)).alias("prs"), F.sum("k").alias("lines"), F.countDistinct(F.col("k") % 17).alias("authors"))


@query("commits", "SELECT t.sha AS release, d.env, d.deployment FROM tags t JOIN down d ON d.sha = t.sha", _DEP)
def d13_releases_to_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = past(spark, sf_dir)
    return tags(h.rows).select("sha").join(deployed(h), "sha").select(F.col("sha").alias("release"), "env", "deployment")


@query("commits", "SELECT c.sha AS pr, d.env, min(r.published) AS deployed FROM commits c JOIN down d ON d.sha = c.sha JOIN rolls r ON r.sha = d.deployment WHERE c.is_merge AND c.chain = 0 AND r.published >= c.started GROUP BY ALL", _DEP)
def p43_first_deployment_per_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request and environment, when its first successful deployment was; not before the merge."""
    h = past(spark, sf_dir)
    when = rollouts(h.rows).select(F.col("sha").alias("deployment"), F.col("published").alias("deployed"))
    return pulls(h.rows).select(F.col("pr").alias("sha"), "merged").join(deployed(h), "sha").join(when, "deployment").where("deployed >= merged").groupBy(F.col("sha").alias("pr"), "env").agg(F.min("deployed").alias("deployed"))


@query("commits", "SELECT c.sha AS pr, e.env FROM commits c JOIN (SELECT DISTINCT repo, env FROM rolls) e ON e.repo = c.repo WHERE c.is_merge AND c.chain = 0 AND NOT EXISTS (SELECT 1 FROM down d WHERE d.sha = c.sha AND d.env = e.env)", _DEP)
def p46_deployment_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged requests of repositories that deploy to an environment, not deployed there."""
    h = past(spark, sf_dir)
    where = rollouts(h.rows).select("repo", "env").distinct()
    return pulls(h.rows).select(F.col("pr").alias("sha"), "repo").join(where, "repo").join(deployed(h).select("sha", "env"), ["sha", "env"], "left_anti").select(F.col("sha").alias("pr"), "env")


@query("commits", "SELECT r.sha AS deployment FROM rolls r WHERE r.published >= (SELECT max(started) - 864000 FROM commits) AND env IN (0, 2) AND conclusion <> 'CANCELLED' AND k % 7 <> 0", _ROLL)
def d09_deployment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployments by time, environment and conclusion, without the failure label."""
    rows = commits(spark, sf_dir)
    end = rows.agg(F.max("started").alias("end"))
    found = rollouts(rows).where(F.col("env").isin(0, 2) & (F.col("conclusion") != "CANCELLED"))
    labelled = rollouts(rows).where("k % 7 = 0").select("sha")
    return found.join(F.broadcast(end), F.expr(f"published >= end - {SPAN}")).join(labelled, "sha", "left_anti").select(F.col("sha").alias("deployment"))


@query("commits", "SELECT r.sha AS deployment, count(*) AS components, min(c.sha) AS first_commit FROM rolls r JOIN commits c ON c.repo = r.repo AND c.sha <= r.sha AND c.sha > r.sha - 40 WHERE r.k % 11 <> 0 GROUP BY 1", _ROLL)
def d10_components_of_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployments whose components resolved (k not divisible by 11), with the components nested; buckets of ids make the near-id join an equi join."""
    rows = commits(spark, sf_dir)
    lost = rollouts(rows).where("k % 11 = 0").select("sha")
    held = rollouts(rows).join(lost, "sha", "left_anti").select(F.col("sha").alias("deployment"), "repo", F.explode(F.array(F.expr("sha div 40"), F.expr("sha div 40 - 1"))).alias("near"))
    parts = held.join(rows.select("repo", "sha", F.expr("sha div 40").alias("near")), ["repo", "near"]).where("sha <= deployment and sha > deployment - 40")
    nested = parts.groupBy("deployment").agg(F.array_sort(F.collect_list("sha")).alias("components"))
    return nested.select("deployment", F.size("components").cast("long").alias("components"), F.element_at("components", 1).alias("first_commit"))


@query("commits", "SELECT repo, env, arg_min(sha, published * 10000000 + sha) AS deployment FROM (SELECT *, published - lag(published) OVER (PARTITION BY repo, env ORDER BY published, sha) AS gap, min(published) OVER (PARTITION BY repo, env) AS first, (SELECT min(started) FROM commits c WHERE c.repo = rolls.repo) AS born FROM rolls WHERE conclusion = 'SUCCESS') GROUP BY ALL HAVING count(*) >= 2 AND (min(first) - min(born)) / greatest(median(gap), 1) > 2", _ROLL)
def d16_outlier_first_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First deployments later after the repository's birth than twice the median gap (the stand-in's gaps are even)."""
    rows = commits(spark, sf_dir)
    w = Window.partitionBy("repo", "env").orderBy("published", "sha")
    good = rollouts(rows).where("conclusion = 'SUCCESS'").withColumn("gap", F.col("published") - F.lag("published").over(w))
    cells = good.groupBy("repo", "env").agg(F.count("*").alias("n"), F.min("published").alias("first"), F.greatest(F.median("gap"), F.lit(1.0)).alias("usual"), F.min_by("sha", F.struct("published", "sha")).alias("deployment"))
    born = rows.groupBy("repo").agg(F.min("started").alias("born"))
    return cells.join(born, "repo").where("n >= 2 and (first - born) / usual > 2").select("repo", "env", "deployment")


@query("commits", "SELECT sha AS deployment, coalesce(max(CAST(k % 11 = 0 AS INT)) OVER (PARTITION BY env ORDER BY published, sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stale FROM rolls WHERE k % 11 <> 0 OR k % 11 = 0", _ROLL)
def d17_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployments newer than one of their environment that isn't processed yet (k divisible by 11): the earliest such one is found per environment, so no window sorts it whole."""
    found = rollouts(commits(spark, sf_dir)).withColumn("at", F.struct("published", "sha"))
    missed = found.where("k % 11 = 0").groupBy("env").agg(F.min("at").alias("from"))
    return found.join(F.broadcast(missed), "env", "left").select(F.col("sha").alias("deployment"), F.coalesce(F.col("at") > F.col("from"), F.lit(False)).alias("stale"))


@query("commits", "SELECT env, repo, sha, n FROM (SELECT r.env, r.repo, c.sha, count(*) AS n FROM rolls r JOIN commits c ON c.repo = r.repo AND c.chain = 0 AND c.started <= r.published JOIN (SELECT repo, chain, started, sha, lead(started) OVER (PARTITION BY repo ORDER BY started, sha) AS until FROM commits WHERE chain = 0) s ON s.sha = c.sha AND (s.until IS NULL OR s.until > r.published) WHERE r.conclusion = 'SUCCESS' GROUP BY ALL) WHERE n > 1", _ROLL)
def d18_repeated_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of the main chain deployed with success more than once in an environment: a deployment takes the newest main commit at its time, by a running maximum."""
    rows = commits(spark, sf_dir)
    w = Window.partitionBy("repo").orderBy("started").rangeBetween(Window.unboundedPreceding, 0)
    newest = F.max(F.when(F.col("branch") == 0, F.struct("started", F.col("sha").alias("id")))).over(w)
    taken = rows.withColumn("newest", newest.getField("id")).select("sha", "newest")
    good = rollouts(rows).where("conclusion = 'SUCCESS'").join(taken, "sha").where("newest is not null")
    return good.groupBy("env", "repo", F.col("newest").alias("sha")).agg(F.count("*").alias("n")).where("n > 1")
