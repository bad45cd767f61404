"""Groupings, filters and set operations over the facts, and people's metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import facts, query, steps
from ..functions.intervals import binned, dense
from .metrics import RESOLUTION

_TRAITS = "traits AS (SELECT l_orderkey AS node_id, list(DISTINCT split_part(p_type, ' ', 1)) AS types, max(p_size) AS priority FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"


@query("prs", "SELECT 'economy and pressing' AS trait_group, grp, count(*) AS prs FROM prs JOIN traits USING (node_id) WHERE list_contains(types, 'ECONOMY') AND priority >= 40 GROUP BY ALL UNION ALL SELECT 'large or standard', grp, count(*) FROM prs JOIN traits USING (node_id) WHERE list_has_any(types, ['LARGE', 'STANDARD']) GROUP BY ALL", _TRAITS)
def e08_group_by_issue_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by traits of a request's issues: arrays that meet the wanted list, and bounds; a request may be in both."""
    lines, parts = facts(spark, sf_dir, "lines"), facts(spark, sf_dir, "parts")
    traits = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("node_id")).agg(F.collect_set(F.substring_index("p_type", " ", 1)).alias("types"), F.max("p_size").alias("priority"))
    wanted = F.array(*[F.lit(x) for x in ("LARGE", "STANDARD")])
    own = F.array_compact(F.array(F.when(F.array_contains("types", "ECONOMY") & (F.col("priority") >= 40), "economy and pressing"), F.when(F.arrays_overlap("types", wanted), "large or standard")))
    return facts(spark, sf_dir, "prs").select("node_id", "grp").join(traits, "node_id").select("grp", F.explode(own).alias("trait_group")).groupBy("trait_group", "grp").agg(F.count("*").alias("prs"))


@query("prs", "SELECT g AS people_group, count(*) AS prs FROM prs JOIN (VALUES (0, 0, 1), (1, 1, 2), (2, 2, 3)) AS v(g, a, b) ON author % 5 = a OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = node_id AND l_shipdate >= o_orderdate AND l_returnflag = 'R' AND l_suppkey % 7 = b) GROUP BY 1")
def e09_group_by_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of people: author in the group, or any reviewer."""
    own = [F.expr(f"CASE WHEN author % 5 = {a} OR exists(verdicts, v -> v.reviewer % 7 = {b}) THEN {g} END") for g, a, b in ((0, 0, 1), (1, 1, 2), (2, 2, 3))]
    return facts(spark, sf_dir, "prs").select(F.explode(F.array_compact(F.array(*own))).alias("people_group")).groupBy("people_group").agg(F.count("*").alias("prs"))


@query("prs", "SELECT grp, count(DISTINCT node_id) AS prs FROM (SELECT grp, node_id FROM prs UNION ALL SELECT grp, node_id FROM prs WHERE label <> '5-LOW') GROUP BY 1")
def e10_logical_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that several logical repositories with equal settings hold count once."""
    prs = facts(spark, sf_dir, "prs").select("grp", "node_id", "label")
    logical = prs.withColumn("logical", F.explode(F.when(F.col("label") != "5-LOW", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))))
    settings = F.sha2(F.concat_ws("|", "grp", F.lit("tag")), 256)  # of the logical repository: the same for both
    return logical.withColumn("settings", settings).dropDuplicates(["settings", "node_id"]).groupBy("grp").agg(F.count("*").alias("prs"))


@query("prs", "SELECT node_id FROM prs WHERE (label = '1-URGENT' OR (label LIKE '%HIGH%' AND grp LIKE '%1')) AND label <> '5-LOW'")
def e18_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single labels, or all labels of a group; and none of the excluded. A request's labels here: its priority and its repository."""
    labels = F.array("label", "grp")
    last = F.regexp_extract("grp", "(.)$", 1)
    group = F.array(F.lit("2-HIGH"), F.lit("1"))
    held = F.array("label", last)
    keep = F.array_contains(labels, "1-URGENT") | (F.size(F.array_except(group, held)) == 0)
    return facts(spark, sf_dir, "prs").where(keep & ~F.array_contains(labels, "5-LOW")).select("node_id")


@query("prs", "SELECT r_name AS team, count(*) AS prs, CAST(trunc(avg(closed - created)) AS BIGINT) AS open_time FROM prs JOIN region ON r_regionkey = region WHERE closed IS NOT NULL GROUP BY 1 UNION ALL SELECT grp, count(*), CAST(trunc(avg(closed - created)) AS BIGINT) FROM prs WHERE closed IS NOT NULL GROUP BY 1 UNION ALL SELECT 'everyone', count(*), CAST(trunc(avg(closed - created)) AS BIGINT) FROM prs WHERE closed IS NOT NULL")
def e20_e21_team_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams own what the teams below them own: nations in regions in everyone. Members are additive, so each level adds up the one below."""
    region = facts(spark, sf_dir, "regions")
    leaf = facts(spark, sf_dir, "prs").where("closed is not null").groupBy("grp", "region").agg(F.count("*").alias("n"), F.sum(F.expr("closed - created")).alias("s"))
    named = leaf.join(F.broadcast(region), F.col("region") == F.col("r_regionkey"))
    up = named.select("n", "s", F.explode(F.array("grp", "r_name", F.lit("everyone"))).alias("team"))
    return up.groupBy("team").agg(F.sum("n").alias("prs"), (F.sum("s") / F.sum("n")).cast("bigint").alias("open_time"))


@query("prs", "SELECT node_id, size, approved - first_review_request AS review_time, released - work_began AS lead_time FROM prs WHERE released IS NOT NULL")
def e23_samples_of_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of single facts, without aggregation."""
    return facts(spark, sf_dir, "prs").where("released is not null").select("node_id", "size", (F.col("approved") - F.col("first_review_request")).alias("review_time"), (F.col("released") - F.col("work_began")).alias("lead_time"))


_Z = 1.2815515655446004  # the 0.9 quantile of the normal distribution
_ZS = f"{_Z}e0"


@query("prs", f"SELECT grp, idx, n, round(m, 4) AS mean, round(m - t * s / sqrt(n), 4) AS low, round(m + t * s / sqrt(n), 4) AS high FROM (SELECT *, {_ZS} + (pow({_ZS}, 3) + {_ZS}) / (4 * (n - 1)) + (5 * pow({_ZS}, 5) + 16 * pow({_ZS}, 3) + 3 * {_ZS}) / (96 * (n - 1) * (n - 1)) AS t FROM (SELECT grp, idx, count(*) AS n, avg(merged - last_commit) AS m, stddev_samp(merged - last_commit) AS s FROM prs JOIN steps ON merged >= ts_from AND merged < ts_to WHERE last_commit IS NOT NULL GROUP BY ALL) WHERE n > 1)")
def e02_mean_with_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and its 80 % interval by Student's t, whose quantile comes from the normal one by the usual expansion in 1 / (n - 1)."""
    x, z = F.expr("merged - last_commit"), _Z
    cells = binned(facts(spark, sf_dir, "prs").where("last_commit is not null"), steps("prs"), "merged").groupBy("grp", "idx").agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).where("n > 1")
    free = F.col("n") - 1
    t = F.lit(z) + F.lit((z**3 + z) / 4) / free + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (free * free)
    half = t * F.col("s") / F.sqrt("n")
    return cells.select("grp", "idx", "n", F.round("m", 4).alias("mean"), F.round(F.col("m") - half, 4).alias("low"), F.round(F.col("m") + half, 4).alias("high"))


_ENDED = "ended AS (SELECT grp, CASE WHEN prs_began IS NULL THEN resolved WHEN prs_released >= resolved THEN prs_released WHEN prs_released < resolved THEN resolved END AS ended_at FROM issues)"


@query("issues", "SELECT grp, idx, round((coalesce(f, 0) + 1) / (coalesce(r, 0) + 1), 9) AS rate FROM (SELECT grp, idx, count(*) AS r FROM issues JOIN steps ON created >= ts_from AND created < ts_to GROUP BY ALL) FULL JOIN (SELECT grp, idx, count(*) AS f FROM ended JOIN steps ON ended_at >= ts_from AND ended_at < ts_to GROUP BY ALL) USING (grp, idx)", _ENDED)
def j04_resolution_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that ended to issues raised, both plus 1; an issue with requests ends when it is resolved and all of them are released."""
    rows = facts(spark, sf_dir, "issues").select("grp", F.explode(F.array(F.struct(F.col("created").alias("at"), F.lit(1).alias("r"), F.lit(0).alias("f")), F.struct(F.expr(RESOLUTION).alias("at"), F.lit(0).alias("r"), F.lit(1).alias("f")))).alias("e")).select("grp", "e.*")
    cells = binned(rows, steps("issues"), "at").groupBy("grp", "idx").agg(F.sum("r").alias("r"), F.sum("f").alias("f"))
    return cells.select("grp", "idx", F.round((F.col("f") + 1) / (F.col("r") + 1), 9).alias("rate"))


@query("actions", "SELECT user_id, idx, CASE WHEN EXISTS (SELECT 1 FROM actions a WHERE a.user_id = u.user_id AND a.started >= ts_from AND a.started < ts_to AND a.topic IN ('click', 'signup', 'view', 'error', 'purchase')) THEN 1 ELSE 0 END AS worked FROM (SELECT DISTINCT user_id FROM actions JOIN steps ON started >= ts_from AND started < ts_to) u CROSS JOIN steps")
def v09_dev_worked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 for each developer and interval with any commit, request, review, comment or release, else 0."""
    rows = facts(spark, sf_dir, "actions").where(F.col("topic").isin("click", "signup", "view", "error", "purchase"))
    cells = binned(rows, steps("actions"), "started").groupBy("user_id", "idx").agg(F.lit(1).cast("bigint").alias("worked"))
    return dense(cells, len(steps("actions")) - 1, ("user_id",), ["worked"])


@query("issues", "SELECT CASE id % 3 WHEN 0 THEN 'team a' WHEN 1 THEN 'team b' END AS people_group, count(*) AS issues FROM issues WHERE id % 3 < 2 GROUP BY 1 UNION ALL SELECT 'everyone', count(*) FROM issues")
def j11_issues_by_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by groups of people (reporters: id modulo 3), and a group of all."""
    own = F.array_compact(F.array(F.when(F.col("id") % 3 == 0, "team a").when(F.col("id") % 3 == 1, "team b"), F.lit("everyone")))
    return facts(spark, sf_dir, "issues").select(F.explode(own).alias("people_group")).groupBy("people_group").agg(F.count("*").alias("issues"))


@query("issues", "SELECT word AS label, count(*) AS issues, row_number() OVER (ORDER BY count(*) DESC, word) AS rank FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def j12_issues_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels (words of an issue's name), the most used first; the ordering sees labels, not issues."""
    used = facts(spark, sf_dir, "parts").select(F.explode(F.split("p_name", " ")).alias("label")).groupBy("label").agg(F.count("*").alias("issues"))
    return used.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("issues"), "label")).cast("long"))


@query("prs", "SELECT reviewer, idx, count(*) AS prs FROM (SELECT l_suppkey AS reviewer, l_orderkey, min(epoch(l_shipdate)) AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_shipdate >= o_orderdate GROUP BY ALL) JOIN steps ON t >= ts_from AND t < ts_to GROUP BY ALL")
def v05_prs_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request counts once for a reviewer, at the first review."""
    rows = facts(spark, sf_dir, "prs").select("node_id", F.explode("verdicts").alias("v")).groupBy("node_id", F.col("v.reviewer").alias("reviewer")).agg(F.min("v.at").alias("at"))
    return binned(rows, steps("prs"), "at").groupBy("reviewer", "idx").agg(F.count("*").alias("prs"))


@query("commits", "SELECT c.repo, c.started // 604800 AS week, count(*) AS commits, count(CASE WHEN s.sha IS NULL AND NOT c.is_merge THEN 1 END) AS bypassing, CAST(sum(c.k) AS BIGINT) AS lines FROM commits c LEFT JOIN (SELECT DISTINCT sha FROM side) s ON s.sha = c.sha GROUP BY ALL", "side(sha) AS (SELECT parent FROM edges JOIN commits m ON m.sha = child AND m.chain = 0 WHERE idx = 1 UNION SELECT parent FROM side JOIN edges e ON e.child = side.sha AND e.idx = 0)")
def v11_code_bypassing_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits a week, and those that no request brought: neither merges nor on a side branch up to its last merge."""
    rows = facts(spark, sf_dir, "commits")
    merged = rows.where("is_merge and branch = 0").groupBy("repo", F.col("side_branch").alias("branch")).agg(F.max("side_n").alias("upto"))
    flagged = rows.join(merged, ["repo", "branch"], "left").withColumn("bypass", ~F.col("is_merge") & ~F.coalesce(F.col("n") <= F.col("upto"), F.lit(False)))
    return flagged.groupBy("repo", F.expr("started div 604800").alias("week")).agg(F.count("*").alias("commits"), F.count_if("bypass").alias("bypassing"), F.sum("k").alias("lines"))


@query("actions", "SELECT user_id, count(DISTINCT topic) AS kinds FROM actions WHERE started >= (SELECT max(started) - 604800 FROM actions) GROUP BY 1")
def v14_active_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories with any action in the last week."""
    rows = facts(spark, sf_dir, "actions")
    end = rows.agg(F.max("started").alias("end"))
    return rows.join(F.broadcast(end), F.expr("started >= end - 604800")).groupBy("user_id").agg(F.countDistinct("topic").alias("kinds"))


@query("prs", "SELECT 'both' AS part, count(*) AS people FROM (SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier) UNION ALL SELECT 'authors only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier) UNION ALL SELECT 'either', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier)")
def q13_v16_sets_of_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and union of the ids of authors and reviewers."""
    a, b = facts(spark, sf_dir, "authors"), facts(spark, sf_dir, "reviewers")
    count = lambda df, n: df.agg(F.count("*").alias("people")).select(F.lit(n).alias("part"), "people")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "authors only")).unionByName(count(a.union(b).distinct(), "either"))


@query("prs", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def q06_without_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors without an urgent merged request."""
    return facts(spark, sf_dir, "authors").join(facts(spark, sf_dir, "prs").where("label = '1-URGENT' and merged is not null").select(F.col("author").alias("id")), "id", "left_anti")


@query("prs", "SELECT node_id, rank FROM (SELECT node_id, row_number() OVER (PARTITION BY grp ORDER BY closed DESC NULLS LAST, merged NULLS FIRST, node_id) AS rank FROM prs WHERE size > 0) WHERE rank <= 20")
def q14_q16_search_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 20 a repository: closed ones first, newest first, unmerged before merged among equals; ties by id."""
    w = Window.partitionBy("grp").orderBy(F.col("closed").desc_nulls_last(), F.col("merged").asc_nulls_first(), "node_id")
    return facts(spark, sf_dir, "prs").where("size > 0").select("grp", "node_id", "closed", "merged").withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("node_id", F.col("rank").cast("long").alias("rank"))


@query("prs", "SELECT node_id FROM prs WHERE regexp_full_match(grp, 'NATION_1[0-9]?') AND label ~ '^[12]-'")
def q04_q22_lists_and_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short list inline, a long one by a broadcast semi join, and a prefix pattern."""
    names = spark.createDataFrame([(f"NATION_{k}",) for k in (1, *range(10, 20))], "grp string")
    return facts(spark, sf_dir, "prs").join(F.broadcast(names), "grp", "left_semi").where(F.col("label").rlike("^[12]-")).select("node_id")


@query("actions", "SELECT day, count(a.event_id) AS events, count(DISTINCT a.user_id) AS people FROM (SELECT unnest(range(min(started) // 86400, max(started) // 86400 + 1)) AS day FROM actions) LEFT JOIN actions a ON a.started // 86400 = day GROUP BY 1")
def q25_q27_activity_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day between the first and the last, with its events and people."""
    rows = facts(spark, sf_dir, "actions").withColumn("day", F.expr("started div 86400"))
    days = rows.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    told = rows.groupBy("day").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("people"))
    return days.join(F.broadcast(told), "day", "left").fillna(0)
