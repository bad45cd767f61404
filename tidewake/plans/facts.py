"""Fact tables of the delivery domain, built from the warehouse tables.

Times are whole seconds since 1970 (bigint); null means "has not happened".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table


def pull_requests(spark: SparkSession, sf_dir: str, until: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """One row of lifecycle times per pull request: children are pre-aggregated per request, then joined once.

    until: as known before that date; keys: (node_id) of the requests wanted, whose rows alone are read on.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if until:
        lines, orders = lines.where(F.col("l_shipdate") < F.lit(until).cast("date")), orders.where(F.col("o_orderdate") < F.lit(until).cast("date"))
    if keys is not None:
        lines, orders = lines.join(keys.select(F.col("node_id").alias("l_orderkey")), "l_orderkey", "left_semi"), orders.join(keys.select(F.col("node_id").alias("o_orderkey")), "o_orderkey", "left_semi")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    repo = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    at = lambda flag: F.when(F.col("l_returnflag") == flag, F.unix_seconds("l_shipdate"))
    # Few narrow columns of a request meet its repository here; its whole facts would be shuffled for that.
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority").join(repo.select(F.col("c_custkey").alias("o_custkey"), "n_name", "n_regionkey"), "o_custkey")
    rows = orders.join(lines.select("l_orderkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_suppkey", "l_quantity", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    valid = F.col("l_shipdate") >= F.col("o_orderdate")
    only = lambda c: F.when(valid, c)
    facts = rows.groupBy("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "n_name", "n_regionkey").agg(
        F.min(only(at("A"))).alias("first_commit"), F.max(only(at("A"))).alias("last_commit"), F.count(only(at("A"))).alias("n_commits"),
        F.min(only(at("N"))).alias("first_review_request"), F.count(only(at("N"))).alias("regular_comments"),
        F.min(only(at("R"))).alias("first_comment"), F.max(only(at("R"))).alias("last_review"), F.count(only(at("R"))).alias("n_reviews"),
        F.max(only(F.when(F.col("l_linestatus") == "O", at("R")))).alias("ok_review"), F.count(only(F.when(F.col("l_linestatus") == "F", at("R")))).alias("n_rejections"),
        F.max(only(F.unix_seconds("l_shipdate"))).alias("last_event"), F.coalesce(F.sum(only(F.col("l_quantity"))).cast("bigint"), F.lit(0)).alias("size"),
        F.array_sort(F.collect_list(only(at("R")))).alias("reviews"), F.array_sort(F.collect_set(only(F.expr("unix_seconds(l_shipdate) div 86400")))).alias("activity_days"),
        F.array_sort(F.collect_list(F.when(valid & (F.col("l_returnflag") == "R"), F.struct(F.col("l_suppkey").alias("reviewer"), F.unix_seconds("l_shipdate").alias("at"), (F.col("l_linestatus") == "F").alias("rejects"))))).alias("verdicts"),
        (F.size(F.collect_set(only(F.col("l_suppkey")))) + 1).cast("bigint").alias("participants"), F.size(F.collect_set(only(F.col("l_partkey")))).cast("bigint").alias("n_issues"),
    )
    created, status = F.unix_seconds("o_orderdate"), F.col("o_orderstatus")
    facts = facts.select(
        F.col("o_custkey").alias("author"), F.col("o_orderkey").alias("node_id"), F.col("o_orderpriority").alias("label"), created.alias("created"), *[c for c in facts.columns if c[:2] != "o_" and c not in ("n_name", "n_regionkey")], "n_name", "n_regionkey",
        F.when(status.isin("F", "P"), F.coalesce("last_event", created)).alias("closed"), F.when(status == "F", F.coalesce("last_event", created)).alias("merged"),
        F.when(~F.exists("verdicts", lambda v: v["rejects"] & ~F.exists("verdicts", lambda w: (w["reviewer"] == v["reviewer"]) & ((w["at"] > v["at"]) | ((w["at"] == v["at"]) & ~w["rejects"])))), F.col("last_review")).alias("approved"), F.least(created, "first_commit").alias("work_began"),
    )
    quarter = F.date_trunc("quarter", F.timestamp_seconds("merged"))
    facts = facts.withColumn("released", F.unix_seconds(F.add_months(quarter, 3).cast("timestamp")))
    facts = facts.withColumn("deployed", F.when(F.col("node_id") % 4 != 0, F.col("released") + (F.col("node_id") % 10) * 86400 - (F.col("node_id") % 3) * 43200)).withColumn("env", F.col("node_id") % 3)
    ends = F.transform(F.array("created", "closed", "released"), lambda t: F.floor(t / 86400))
    facts = facts.withColumn("activity_days", F.array_sort(F.array_distinct(F.concat("activity_days", F.array_compact(ends)))))
    facts = facts.withColumn("done", F.col("released").isNotNull() | (F.col("closed").isNotNull() & F.col("merged").isNull()))
    return facts.withColumns({"grp": F.col("n_name"), "region": F.col("n_regionkey")}).drop("n_name", "n_regionkey")


def request_stamps(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """(node_id, stamp): a number that changes with what is known of a request, from four columns of its rows."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if until:
        lines, orders = lines.where(F.col("l_shipdate") < F.lit(until).cast("date")), orders.where(F.col("o_orderdate") < F.lit(until).cast("date"))
    known = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"))
    return orders.join(known, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("node_id"), F.xxhash64("o_orderstatus", "n", "last").alias("stamp"))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One release per repository and quarter; its age counts from the one before, the first one's from the first request."""
    prs = pull_requests(spark, sf_dir)
    found = prs.where("released is not null").groupBy("grp", "released").agg(F.count("*").alias("prs"), F.sum("n_commits").alias("commits"), F.sum("size").alias("lines"), F.min("created").alias("oldest"))
    before = F.lag("released").over(Window.partitionBy("grp").orderBy("released"))
    return found.withColumn("age", F.col("released") - F.coalesce(before, "oldest")).withColumn("matched_by", F.when(F.length("grp") % 2 == 0, "tag").otherwise("branch")).withColumnRenamed("released", "published")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.unix_seconds("ts").alias("started"), F.floor("value").cast("bigint").alias("seconds"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), (F.col("user_id") % 10).cast("string").alias("grp"))


def check_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check runs; a suite is a user's day."""
    e = _events(spark, sf_dir)
    return e.select("event_id", "grp", F.col("event_type").alias("name"), "started", (F.col("started") + F.col("seconds")).alias("completed"), (F.col("user_id") * 100000 + F.floor(F.col("started") / 86400)).alias("suite"), (~(F.col("k") % 10).isin(0, 1, 2)).alias("ok"), F.expr("CASE k % 10 WHEN 0 THEN 'FAILURE' WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'SKIPPED' WHEN 3 THEN 'NEUTRAL' ELSE 'SUCCESS' END").alias("conclusion"), F.when(F.col("k") % 4 != 0, F.col("user_id") * 100 + F.col("k") % 7).alias("pr"), F.expr("user_id * 100000 + started div 172800").alias("commit"), F.col("user_id").alias("pusher"))


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type = 'purchase'")
    conclusion = F.when(F.col("k") % 10 == 0, "FAILURE").when(F.col("k") % 10 == 1, "CANCELLED").otherwise("SUCCESS")
    return e.select("event_id", "grp", (F.col("k") % 3).alias("env"), "started", (F.col("started") + F.col("seconds")).alias("finished"), conclusion.alias("conclusion"), (F.col("k") % 7 == 0).alias("failure_label"), (F.col("k") % 5).alias("prs"), (F.col("k") % 11).alias("commits"), F.col("k").alias("lines"), F.col("user_id").alias("repo"))


def issues(spark: SparkSession, sf_dir: str, links: str = "l_linenumber = 1 and l_quantity >= 40") -> DataFrame:
    """Issues with the times of the pull requests mapped to them by ``links``; prs_released is null while any of them is unreleased."""
    prs = pull_requests(spark, sf_dir).select("node_id", "created", "first_commit", "closed", "released")
    links = table(spark, sf_dir, "lineitem").where(links).select("l_partkey", F.col("l_orderkey").alias("node_id")).distinct()
    times = links.join(prs, "node_id").groupBy("l_partkey").agg(F.min("created").alias("prs_began"), F.min("first_commit").alias("began"), F.max("closed").alias("last_closed"), F.max("released").alias("last_released"), F.count("*").alias("prs_count"), F.count("released").alias("n_released"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    size = F.col("p_size")
    return part.join(times, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("id"), F.substring_index("p_type", " ", 1).alias("grp"), (F.lit(694224000) + size * 86400 * 20).alias("created"), F.when(size % 5 != 0, F.coalesce("began", F.lit(725846400) + size * 86400)).alias("work_began"),
        F.when(size % 3 == 0, F.coalesce("last_closed", F.lit(852076800) + size * 86400)).alias("resolved"), "prs_began", F.when(F.col("n_released") == F.col("prs_count"), F.col("last_released")).alias("prs_released"), F.coalesce("prs_count", F.lit(0)).alias("prs_count"),
        F.when(size % 3 == 0, "Done").when(size % 3 == 1, "In Progress").otherwise("To Do").alias("category"),
    )


def linked_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with all pull requests that name them."""
    return issues(spark, sf_dir, "true")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "grp", "user_id", F.col("event_type").alias("topic"), "started", F.col("k").alias("lines"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits of a repository's two branches (see ``operators.graph``)."""
    from ..operators.graph import branched_commits

    return branched_commits(_events(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.unix_seconds("l_shipdate").alias("at"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region")


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))


#: The same tables as SQL, for the comparison with DuckDB.
SQL = {
    "prs": """last_verdicts AS (SELECT l_orderkey AS pr, l_suppkey, max(l_shipdate) AS seen, arg_max(l_linestatus, epoch(l_shipdate) * 2 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS verdict FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_shipdate >= o_orderdate GROUP BY 1, 2),
verdicts AS (SELECT pr, CAST(epoch(max(seen)) AS BIGINT) AS approved FROM last_verdicts GROUP BY 1 HAVING count(CASE WHEN verdict = 'F' THEN 1 END) = 0),
prs0 AS (SELECT o_orderkey AS node_id, o_custkey AS author, o_orderpriority AS label, CAST(epoch(o_orderdate) AS BIGINT) AS created, o_orderstatus AS status,
  CAST(epoch(min(l_shipdate) FILTER (l_returnflag = 'A')) AS BIGINT) AS first_commit, CAST(epoch(max(l_shipdate) FILTER (l_returnflag = 'A')) AS BIGINT) AS last_commit, count(*) FILTER (l_returnflag = 'A') AS n_commits,
  CAST(epoch(min(l_shipdate) FILTER (l_returnflag = 'N')) AS BIGINT) AS first_review_request, count(*) FILTER (l_returnflag = 'N') AS regular_comments,
  CAST(epoch(min(l_shipdate) FILTER (l_returnflag = 'R')) AS BIGINT) AS first_comment, CAST(epoch(max(l_shipdate) FILTER (l_returnflag = 'R')) AS BIGINT) AS last_review, count(*) FILTER (l_returnflag = 'R') AS n_reviews,
  CAST(epoch(max(l_shipdate) FILTER (l_returnflag = 'R' AND l_linestatus = 'O')) AS BIGINT) AS ok_review, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS n_rejections,
  list(CAST(epoch(l_shipdate) AS BIGINT) ORDER BY l_shipdate) FILTER (l_returnflag = 'R') AS reviews, coalesce(list(DISTINCT CAST(epoch(l_shipdate) AS BIGINT) // 86400) FILTER (l_shipdate IS NOT NULL), []) AS line_days, max(l_shipdate) AS last_event, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS size, count(DISTINCT l_suppkey) + 1 AS participants, count(DISTINCT l_partkey) AS n_issues, o_orderdate
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate GROUP BY ALL),
prs1 AS (SELECT *, CASE WHEN status IN ('F', 'P') THEN coalesce(last_event, o_orderdate) END AS closed_ts, CASE WHEN status = 'F' THEN coalesce(last_event, o_orderdate) END AS merged_ts FROM prs0),
prs2 AS (SELECT *, CAST(epoch(closed_ts) AS BIGINT) AS closed, CAST(epoch(merged_ts) AS BIGINT) AS merged, verdicts.approved, least(created, first_commit) AS work_began, CAST(epoch(date_trunc('quarter', merged_ts) + INTERVAL 3 MONTH) AS BIGINT) AS released FROM prs1 LEFT JOIN verdicts ON pr = node_id),
prs AS (SELECT p.*, CASE WHEN node_id % 4 <> 0 THEN released + (node_id % 10) * 86400 - (node_id % 3) * 43200 END AS deployed, node_id % 3 AS env, released IS NOT NULL OR (closed IS NOT NULL AND merged IS NULL) AS done, list_sort(list_distinct(list_concat(line_days, list_filter([created // 86400, closed // 86400, released // 86400], lambda d: d IS NOT NULL)))) AS activity_days, n_name AS grp, n_regionkey AS region
  FROM prs2 p JOIN customer ON c_custkey = author JOIN nation ON n_nationkey = c_nationkey)""",
    "releases": """releases AS (SELECT grp, published, prs, commits, lines, published - coalesce(lag(published) OVER (PARTITION BY grp ORDER BY published), oldest) AS age, CASE WHEN length(grp) % 2 = 0 THEN 'tag' ELSE 'branch' END AS matched_by
  FROM (SELECT grp, released AS published, count(*) AS prs, sum(n_commits) AS commits, sum(size) AS lines, min(created) AS oldest FROM prs WHERE released IS NOT NULL GROUP BY ALL))""",
    "ev": """ev AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS started, CAST(floor(value) AS BIGINT) AS seconds, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(user_id % 10 AS VARCHAR) AS grp FROM events)""",
    "checks": """checks AS (SELECT event_id, grp, event_type AS name, started, started + seconds AS completed, user_id * 100000 + started // 86400 AS suite, k % 10 > 2 AS ok, CASE k % 10 WHEN 0 THEN 'FAILURE' WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'SKIPPED' WHEN 3 THEN 'NEUTRAL' ELSE 'SUCCESS' END AS conclusion, CASE WHEN k % 4 <> 0 THEN user_id * 100 + k % 7 END AS pr, user_id * 100000 + started // 172800 AS commit, user_id AS pusher FROM ev)""",
    "deployments": """deployments AS (SELECT event_id, grp, k % 3 AS env, started, started + seconds AS finished, CASE k % 10 WHEN 0 THEN 'FAILURE' WHEN 1 THEN 'CANCELLED' ELSE 'SUCCESS' END AS conclusion, k % 7 = 0 AS failure_label, k % 5 AS prs, k % 11 AS commits, k AS lines, user_id AS repo FROM ev WHERE event_type = 'purchase')""",
    "issues": """issues AS (SELECT p_partkey AS id, split_part(p_type, ' ', 1) AS grp, 694224000 + p_size * 86400 * 20 AS created, CASE WHEN p_size % 5 <> 0 THEN coalesce(began, 725846400 + p_size * 86400) END AS work_began, CASE WHEN p_size % 3 = 0 THEN coalesce(last_closed, 852076800 + p_size * 86400) END AS resolved,
  prs_began, CASE WHEN n_released = prs_count THEN last_released END AS prs_released, coalesce(prs_count, 0) AS prs_count, CASE p_size % 3 WHEN 0 THEN 'Done' WHEN 1 THEN 'In Progress' ELSE 'To Do' END AS category
  FROM part LEFT JOIN (SELECT l_partkey, min(created) AS prs_began, min(first_commit) AS began, max(closed) AS last_closed, max(released) AS last_released, count(*) AS prs_count, count(released) AS n_released
  FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 40) JOIN prs ON node_id = l_orderkey GROUP BY 1) ON p_partkey = l_partkey)""",
    "commits": """commits0 AS (SELECT event_id AS sha, user_id AS repo, event_type AS kind, started, k, k % 2 AS chain FROM ev),
commits1 AS (SELECT *, lag(sha) OVER (PARTITION BY repo, chain ORDER BY started, sha) AS parent0, last_value(CASE WHEN chain = 0 THEN sha END IGNORE NULLS) OVER w AS before0, last_value(CASE WHEN chain = 1 THEN sha END IGNORE NULLS) OVER w AS before1 FROM commits0 WINDOW w AS (PARTITION BY repo ORDER BY started, sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
commits AS (SELECT *, CASE WHEN kind = 'signup' THEN CASE chain WHEN 0 THEN before1 ELSE before0 END END AS parent1, kind = 'signup' AND CASE chain WHEN 0 THEN before1 ELSE before0 END IS NOT NULL AS is_merge FROM commits1),
edges AS (SELECT sha AS child, parent0 AS parent, 0 AS idx FROM commits WHERE parent0 IS NOT NULL UNION ALL SELECT sha, parent1, 1 FROM commits WHERE parent1 IS NOT NULL),
tags AS (SELECT sha, repo, started AS published, 'v' || (k // 10) AS tag, k FROM commits WHERE kind = 'purchase' AND chain = 0)""",
    "actions": """actions AS (SELECT event_id, grp, user_id, event_type AS topic, started, k AS lines FROM ev)""",
}
SQL["linked_issues"] = SQL["issues"].replace("issues AS", "linked_issues AS", 1).replace(" WHERE l_linenumber = 1 AND l_quantity >= 40", "")
NEEDS = {"linked_issues": ["prs", "linked_issues"], "prs": ["prs"], "releases": ["prs", "releases"], "checks": ["ev", "checks"], "deployments": ["ev", "deployments"], "issues": ["prs", "issues"], "actions": ["ev", "actions"], "commits": ["ev", "commits"]}
BUILD = {"linked_issues": linked_issues, "prs": pull_requests, "releases": releases, "checks": check_runs, "deployments": deployments, "issues": issues, "actions": actions, "commits": commits, "lines": lines, "parts": parts, "regions": regions, "authors": authors, "reviewers": reviewers}
