"""Nested records, unions, name rules and logical repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import facts, query, steps
from ..functions.aggregates import confidence_score
from ..functions.intervals import binned
from ..functions.order_statistics import median_ranks

_RECORD = "node_id long, label string, reviews array<long>, activity_days array<long>"


@query("prs", "SELECT node_id, label, coalesce(len(reviews), 0) AS n_reviews, list_min(reviews) AS first_review, count(DISTINCT d) AS days FROM prs JOIN (SELECT l_orderkey AS node_id, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate UNION SELECT node_id, unnest([created, closed, released]) // 86400 FROM prs) USING (node_id) GROUP BY ALL")
def q02_nested_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored fact records (JSON here) read back as columns with arrays by a declared schema."""
    kept = facts(spark, sf_dir, "prs").select(F.to_json(F.struct("node_id", "label", "reviews", "activity_days")).alias("record"))
    r = kept.select(F.from_json("record", _RECORD).alias("r")).select("r.*")
    return r.select("node_id", "label", F.size("reviews").cast("long").alias("n_reviews"), F.array_min("reviews").alias("first_review"), F.size("activity_days").cast("long").alias("days"))


@query("prs", "SELECT kind, year, count(*) AS things FROM (SELECT 'opened' AS kind, year(to_timestamp(created)) AS year FROM prs UNION ALL SELECT 'rejected', year(to_timestamp(closed)) FROM prs WHERE closed IS NOT NULL AND merged IS NULL UNION ALL SELECT 'issue', year(to_timestamp(created)) FROM (SELECT 694224000 + p_size * 86400 * 20 AS created FROM part)) GROUP BY ALL")
def q12_union_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-shaped tables one under another."""
    prs = facts(spark, sf_dir, "prs")
    part = lambda df, kind, at: df.select(F.lit(kind).alias("kind"), F.year(F.timestamp_seconds(at)).cast("long").alias("year"))
    issues = facts(spark, sf_dir, "parts").select((F.lit(694224000) + F.col("p_size") * 86400 * 20).alias("created"))
    every = part(prs, "opened", "created").unionByName(part(prs.where("closed is not null and merged is null"), "rejected", "closed")).unionByName(part(issues, "issue", "created"))
    return every.groupBy("kind", "year").agg(F.count("*").alias("things"))


@query("prs", "SELECT node_id, pos, len(reviews) AS n_reviews, reviews[pos] AS reviewed FROM (SELECT node_id, reviews, unnest(range(1, len(reviews) + 1)) AS pos FROM prs)")
def q20_nested_rows_and_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays as rows with their place, and the arrays' lengths."""
    rows = facts(spark, sf_dir, "prs").select("node_id", F.size("reviews").cast("long").alias("n_reviews"), F.posexplode("reviews").alias("at", "reviewed"))
    return rows.select("node_id", (F.col("at") + 1).cast("long").alias("pos"), "n_reviews", "reviewed")


_WANTED = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)


@query("prs", f"SELECT node_id FROM prs WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = node_id AND l_shipdate >= o_orderdate AND l_returnflag = 'R' AND l_suppkey IN {_WANTED})")
def q21_array_meets_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose array of reviewers meets the wanted list."""
    wanted = F.array(*[F.lit(x).cast("long") for x in _WANTED])
    return facts(spark, sf_dir, "prs").where(F.arrays_overlap(F.col("verdicts.reviewer"), wanted)).select("node_id")


@query("prs", "SELECT 'host/org/' || grp AS repository, count(*) AS prs, count(DISTINCT label) AS logical FROM prs GROUP BY 1")
def q23_repository_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logical suffix of ``org/repo/logical`` is stripped, and the name gets its prefix."""
    name = F.concat_ws("/", F.lit("org"), "grp", "label")
    rows = facts(spark, sf_dir, "prs").select(name.alias("name"))
    return rows.groupBy(F.concat(F.lit("host/"), F.substring_index("name", "/", 2)).alias("repository")).agg(F.count("*").alias("prs"), F.countDistinct(F.substring_index("name", "/", -1)).alias("logical"))


#: Cells larger than this take their ranks from the normal approximation.
_EXACT = 200
_RANKS = ", ".join(f"({n}, {a}, {b})" for n, (a, b) in enumerate((median_ranks(n) for n in range(1, _EXACT + 1)), 1))


@query("prs", f"""SELECT grp, idx, max(n) AS n, CAST(trunc(median(x)) AS BIGINT) AS median, max(CASE WHEN r = a THEN x END) AS low, max(CASE WHEN r = b THEN x END) AS high,
  CASE WHEN trunc(median(x)) = 0 AND max(CASE WHEN r = a THEN x END) = 0 AND max(CASE WHEN r = b THEN x END) = 0 THEN 100 WHEN trunc(median(x)) = 0 THEN 0 ELSE 100 - CAST(trunc(least(100 * (max(CASE WHEN r = b THEN x END) - max(CASE WHEN r = a THEN x END)) / trunc(median(x)), 100)) AS INT) END AS score
FROM (SELECT grp, idx, x, row_number() OVER w AS r, count(*) OVER (PARTITION BY grp, idx) AS n FROM (SELECT grp, idx, merged - last_commit AS x FROM prs JOIN steps ON merged >= ts_from AND merged < ts_to WHERE last_commit IS NOT NULL) WINDOW w AS (PARTITION BY grp, idx ORDER BY x))
JOIN (SELECT * FROM (VALUES {_RANKS}) AS v(size, a, b)) ON size = n GROUP BY grp, idx""")
def e03_e16_median_with_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, its 80 % bounds by order statistics, and the confidence score.

    The bounds are the values at the ranks that a fair coin's count of n throws
    lies between; ranks of cells up to 200 come from the exact distribution, of
    larger ones from the normal approximation. Values are counted before they
    are ranked, so a window holds a cell's distinct values, not its rows.
    """
    rows = binned(facts(spark, sf_dir, "prs").where("last_commit is not null"), steps("prs"), "merged").select("grp", "idx", F.expr("merged - last_commit").alias("x"))
    cell = Window.partitionBy("grp", "idx")
    upto = F.sum("c").over(cell.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.groupBy("grp", "idx", "x").agg(F.count("*").alias("c")).withColumn("upto", upto).withColumn("n", F.sum("c").over(cell))
    exact = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in map(median_ranks, range(1, _EXACT + 1))])
    half = F.lit(1.2815515655446004 / 2) * F.sqrt("n")
    rank = lambda k, far: F.when(F.col("n") <= _EXACT, F.element_at(F.element_at(exact, F.least("n", F.lit(_EXACT)).cast("int")), k)).otherwise(far)
    low, high = rank(1, F.floor(F.col("n") / 2 - half) + 1), rank(2, F.ceil(F.col("n") / 2 + half))
    at = lambda r: F.min(F.when(F.col("upto") >= r, F.col("x")))
    cells = ranked.withColumn("a", low).withColumn("b", high).groupBy("grp", "idx", "n").agg(
        at(F.col("a")).alias("low"), at(F.col("b")).alias("high"), ((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2).cast("bigint").alias("median")
    )
    return cells.select("grp", "idx", "n", "median", "low", "high", confidence_score(F.col("median"), F.col("low"), F.col("high")).alias("score"))


def logical(rows: DataFrame, repo: Column, rules: dict[str, Column]) -> DataFrame:
    """``rows`` once for each rule that holds, with ``logical`` as ``repo/rule``; rows without any stay in the repository itself."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.concat(repo, F.lit(f"/{name}"))) for name, rule in rules.items()]))
    return rows.withColumn("logical", F.explode(F.when(F.size(held) > 0, held).otherwise(F.array(repo))))


@query("prs", "SELECT logical, count(*) AS prs, count(merged) AS merged FROM (SELECT grp || '/alpha' AS logical, merged FROM prs WHERE label ~ '^[12]-' UNION ALL SELECT grp || '/beta', merged FROM prs WHERE label IN ('2-HIGH', '3-MEDIUM') UNION ALL SELECT grp, merged FROM prs WHERE NOT label ~ '^[12]-' AND label NOT IN ('2-HIGH', '3-MEDIUM')) GROUP BY 1")
def f15_requests_in_logical_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests copied to each logical repository whose pattern or labels they meet, in one pass and without a join."""
    prs = facts(spark, sf_dir, "prs").select("grp", "label", "merged")
    split = logical(prs, F.col("grp"), {"alpha": F.col("label").rlike("^[12]-"), "beta": F.col("label").isin("2-HIGH", "3-MEDIUM")})
    return split.groupBy("logical").agg(F.count("*").alias("prs"), F.count("merged").alias("merged"))


@query("deployments", "SELECT event_id, CAST(repo AS VARCHAR) || '/urgent' AS logical FROM deployments WHERE failure_label UNION ALL SELECT event_id, CAST(repo AS VARCHAR) || '/production' FROM deployments WHERE env = 0 UNION ALL SELECT event_id, CAST(repo AS VARCHAR) FROM deployments WHERE NOT failure_label AND env <> 0")
def f16_deployments_in_logical_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for deployments, by a pattern on their names and by label."""
    rows = facts(spark, sf_dir, "deployments").withColumn("name", F.concat(F.lit("deploy-"), F.col("env").cast("string")))
    split = logical(rows, F.col("repo").cast("string"), {"urgent": F.col("failure_label"), "production": F.col("name").rlike("-0$")})
    return split.select("event_id", "logical")


@query("prs", "SELECT p.node_id, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS commits, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS requests, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS reviews, count(DISTINCT l_partkey) AS issues FROM prs p LEFT JOIN lineitem ON l_orderkey = node_id AND l_shipdate >= o_orderdate WHERE created < 852076800 AND (closed IS NULL OR closed >= 820454400) GROUP BY 1")
def f12_requests_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests active in 1996 with the number of their children of each kind; requests are cut down before children are counted."""
    prs = facts(spark, sf_dir, "prs").where("created < 852076800 and (closed is null or closed >= 820454400)")
    return prs.select("node_id", F.col("n_commits").alias("commits"), F.col("regular_comments").alias("requests"), F.col("n_reviews").alias("reviews"), F.col("n_issues").alias("issues"))


@query("actions", "SELECT team, topic, idx, count(*) AS events, count(DISTINCT user_id) AS people FROM actions JOIN (VALUES ('a', 0), ('a', 1), ('b', 1), ('c', 2)) AS v(team, m) ON user_id % 3 = m JOIN steps ON started >= ts_from AND started < ts_to GROUP BY ALL")
def v10_topics_by_developer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each topic by sets of developers, which may overlap."""
    team = {"a": (0, 1), "b": (1,), "c": (2,)}
    own = F.array_compact(F.array(*[F.when((F.col("user_id") % 3).isin(*m), n) for n, m in team.items()]))
    rows = binned(facts(spark, sf_dir, "actions"), steps("actions"), "started").withColumn("team", F.explode(own))
    return rows.groupBy("team", "topic", "idx").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("people"))


@query("commits", "SELECT c.sha, c.repo, count(e.child) AS children, min(e.child) AS first_child FROM commits c LEFT JOIN edges e ON e.parent = c.sha WHERE NOT c.is_merge AND c.repo % 3 <> 0 AND c.started >= (SELECT max(started) - 864000 FROM commits) GROUP BY ALL")
def v12_commits_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of the last ten days by wanted repositories, merges left out, with their children."""
    from ..catalogue import QUERIES

    rows = facts(spark, sf_dir, "commits").select("sha", "repo", "started", "is_merge")
    end = rows.agg(F.max("started").alias("end"))
    wanted = rows.where("not is_merge and repo % 3 <> 0").join(F.broadcast(end), F.expr("started >= end - 864000"))
    children = QUERIES["g00_commit_edges"](spark, sf_dir).groupBy(F.col("parent").alias("sha")).agg(F.count("*").alias("n"), F.min("child").alias("first_child"))
    return wanted.join(children, "sha", "left").select("sha", "repo", F.coalesce("n", F.lit(0)).alias("children"), "first_child")


@query("prs", "SELECT 'requests' AS name, count(*) AS n, min(created) AS first FROM prs UNION ALL SELECT 'lines', count(*), CAST(min(epoch(l_shipdate)) AS BIGINT) FROM lineitem UNION ALL SELECT 'authors', count(*), NULL FROM customer UNION ALL SELECT 'reviewers', count(*), NULL FROM supplier UNION ALL SELECT 'issues', count(*), NULL FROM part UNION ALL SELECT 'events', count(*), CAST(min(floor(epoch(ts))) AS BIGINT) FROM events")
def v17_every_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table at once, each with its size and first time."""
    first = {"requests": ("prs", "created"), "lines": ("lines", "at"), "authors": ("authors", None), "reviewers": ("reviewers", None), "issues": ("parts", None), "events": ("actions", "started")}
    told = [facts(spark, sf_dir, t).agg(F.count("*").alias("n"), (F.min(c) if c else F.lit(None)).cast("long").alias("first")).select(F.lit(n).alias("name"), "n", "first") for n, (t, c) in first.items()]
    out = told[0]
    for t in told[1:]:
        out = out.unionByName(t)
    return out


@query("commits", "SELECT m.sha AS pr FROM commits m WHERE m.is_merge AND m.chain = 0 AND m.k % 13 = 0 AND m.started < (SELECT max(started) - 3600 FROM commits)")
def f13_force_push_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests merged over an hour ago whose merge commit the graph lacks (here the commits with k divisible by 13 didn't arrive)."""
    from .history import pulls

    rows = facts(spark, sf_dir, "commits")
    end = rows.agg(F.max("started").alias("end"))
    present = rows.where("k % 13 <> 0").select(F.col("sha").alias("pr"), "repo")
    return pulls(rows).join(F.broadcast(end), F.expr("merged < end - 3600")).join(present, ["repo", "pr"], "left_anti").select("pr")

