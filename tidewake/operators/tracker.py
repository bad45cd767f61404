"""Issues: scans, epics, summaries, what deployments resolve; charts and filters by issue traits; late preparations of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import _ALIVE, _alive, facts, query, steps
from ..functions.intervals import binned, dense
from .checks import _FIRST, suites


@query("prs", f"SELECT grp, idx, round(avg(nullif(n_rejections, 0)), 6) AS review_comments_per FROM prs JOIN steps ON {_ALIVE} GROUP BY ALL")
def p39_pr_review_comments_per(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean review comments of the requests alive in the quarter that have any; a rejecting review stands for a comment."""
    return _alive(spark, sf_dir).groupBy("grp", "idx").agg(F.round(F.avg(F.expr("nullif(n_rejections, 0)")), 6).alias("review_comments_per"))


@query("checks", """SELECT grp, idx, round(avg(filled), 3) AS suite_time FROM (SELECT grp, runs, idx, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY grp, runs ORDER BY idx), first_value(m IGNORE NULLS) OVER (PARTITION BY grp, runs ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS filled
FROM (SELECT DISTINCT grp, runs FROM means) CROSS JOIN (SELECT idx FROM steps) LEFT JOIN means USING (grp, runs, idx)) GROUP BY ALL""", f"{_FIRST}, means AS (SELECT grp, runs, idx, avg(suite_end - started) AS m FROM firsts JOIN steps ON started >= ts_from AND started < ts_to GROUP BY ALL)")
def c06_chk_robust_suite_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over suite sizes of their mean times; an interval without suites of a size takes the nearest earlier mean, or the earliest. Windows run over intervals, not suites."""
    cells = binned(suites(spark, sf_dir), steps("checks"), "started").groupBy("grp", "runs", "idx").agg(F.avg(F.expr("suite_end - started")).alias("m"))
    own = Window.partitionBy("grp", "runs").orderBy("idx")
    grid = dense(cells, len(steps("checks")) - 1, ("grp", "runs"), [])
    filled = F.coalesce(F.last("m", ignorenulls=True).over(own), F.first("m", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return grid.select("grp", "idx", filled.alias("filled")).groupBy("grp", "idx").agg(F.round(F.avg("filled"), 3).alias("suite_time"))


@query("checks", "SELECT CASE WHEN span < 35 THEN day WHEN span < 150 THEN first + (day - first) // 7 * 7 ELSE greatest(first, date_diff('day', DATE '1970-01-01', date_trunc('month', DATE '1970-01-01' + CAST(day AS INT)))) END AS begins, count(*) AS runs FROM (SELECT started // 86400 AS day, min(started // 86400) OVER () AS first, max(started // 86400) OVER () - min(started // 86400) OVER () + 1 AS span FROM checks) GROUP BY 1")
def c19_adaptive_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by day where all span less than 35 days, by week below 150, else by calendar month."""
    rows = facts(spark, sf_dir, "checks").select(F.expr("started div 86400").alias("day"))
    ends = rows.agg(F.min("day").alias("first"), (F.max("day") - F.min("day") + 1).alias("span"))
    return rows.groupBy("day").agg(F.count("*").alias("n")).join(F.broadcast(ends), F.col("day") >= F.col("first")).groupBy(timeline(F.col("day"), F.col("first"), F.col("span")).alias("begins")).agg(F.sum("n").alias("runs"))


def timeline(day: Column, first: Column, span: Column) -> Column:
    """Day (since 1970) at which the interval that holds ``day`` begins."""
    month = F.unix_date(F.trunc(F.date_from_unix_date(day.cast("int")), "month")).cast("long")
    return F.when(span < 35, day).when(span < 150, first + F.floor((day - first) / 7) * 7).otherwise(F.greatest(first, month))


_STATES = "states AS (SELECT event_id, commit, name, started, CASE conclusion WHEN 'NEUTRAL' THEN 'PENDING' ELSE conclusion END AS status FROM checks)"


@query("checks", "SELECT event_id, CASE WHEN n > 1 AND first_status = 'PENDING' THEN first_started ELSE started END AS started, CASE WHEN n > 1 AND first_status = 'PENDING' AND started - first_started <= 86400 THEN started END AS completed, status FROM (SELECT *, count(*) OVER (PARTITION BY commit, name) AS n, first_value(status) OVER w AS first_status, first_value(started) OVER w AS first_started, row_number() OVER (PARTITION BY commit, name ORDER BY started DESC, event_id DESC) AS r FROM states WINDOW w AS (PARTITION BY commit, name ORDER BY started, event_id)) WHERE NOT (n > 1 AND first_status = 'PENDING') OR r = 1", _STATES)
def c21_pending_with_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of one commit and check: where the first is pending, the last of them stands for all, from the first's start to its own, without an end beyond 24 hours."""
    key = Window.partitionBy("commit", "name")
    rows = facts(spark, sf_dir, "checks").select("event_id", "commit", "name", "started", F.when(F.col("conclusion") == "NEUTRAL", "PENDING").otherwise(F.col("conclusion")).alias("status"))
    seen = rows.withColumn("a", F.min(F.struct("started", "event_id", "status")).over(key)).withColumn("z", F.max(F.struct("started", "event_id")).over(key))
    pair = (F.col("a.status") == "PENDING") & (F.col("a.event_id") != F.col("z.event_id"))
    kept = seen.withColumn("pair", pair).where(~F.col("pair") | (F.col("event_id") == F.col("z.event_id")))
    end = F.when(F.col("pair") & (F.col("started") - F.col("a.started") <= 86400), F.col("started"))
    return kept.select("event_id", F.when(F.col("pair"), F.col("a.started")).otherwise(F.col("started")).alias("started"), end.alias("completed"), "status")


@query("checks", "SELECT event_id, name, conclusion FROM checks WHERE started >= (SELECT max(started) - 864000 FROM checks) AND grp IN ('1', '3', '5') AND pusher % 4 <> 0 AND pr IS NOT NULL AND conclusion <> 'SKIPPED'")
def c25_mined_check_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the last ten days of wanted repositories and pushers, inside requests."""
    rows = facts(spark, sf_dir, "checks")
    end = rows.agg(F.max("started").alias("end"))
    wanted = rows.where(F.col("grp").isin("1", "3", "5") & (F.col("pusher") % 4 != 0) & F.col("pr").isNotNull() & (F.col("conclusion") != "SKIPPED"))
    return wanted.join(F.broadcast(end), F.expr("started >= end - 864000")).select("event_id", "name", "conclusion")


def _released_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, env, deployed, l_partkey): the distinct issues of the requests that went out together."""
    prs = facts(spark, sf_dir, "prs").where("deployed is not null").select(F.col("node_id").alias("l_orderkey"), "grp", "env", "deployed", "created")
    return facts(spark, sf_dir, "lines").join(prs, "l_orderkey").where("at >= created").select("grp", "env", "deployed", "l_partkey").distinct()


_SENT = "sent AS (SELECT DISTINCT grp, env, deployed, l_partkey FROM prs JOIN lineitem ON l_orderkey = node_id AND l_shipdate >= o_orderdate WHERE deployed IS NOT NULL)"


@query("prs", "SELECT grp, idx, count(*) AS issues, count(CASE WHEN lower(p_type) = 'economy' THEN 1 END) AS bug_fixes FROM sent JOIN part ON p_partkey = l_partkey JOIN steps ON deployed >= ts_from AND deployed < ts_to GROUP BY ALL", _SENT)
def d07_dep_jira_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique issues of each deployment, added up; bug fixes by type (economy stands for bug)."""
    rows = _released_issues(spark, sf_dir).join(facts(spark, sf_dir, "parts").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return binned(rows, steps("prs"), "deployed").groupBy("grp", "idx").agg(F.count("*").alias("issues"), F.count_if(F.lower("p_type") == "economy").alias("bug_fixes"))


@query("prs", "SELECT grp, env, deployed, count(*) AS issues, array_to_string(list_sort(list(l_partkey)), ',') AS ids FROM sent GROUP BY ALL", _SENT)
def d19_issues_of_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of the requests of each deployment."""
    held = _released_issues(spark, sf_dir).groupBy("grp", "env", "deployed").agg(F.sort_array(F.collect_list("l_partkey")).alias("ids"))
    return held.select("grp", "env", "deployed", F.size("ids").cast("long").alias("issues"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("deployments", "SELECT r AS repo_group, e AS env_group, count(*) AS deployments, count(CASE WHEN conclusion = 'SUCCESS' THEN 1 END) AS successful FROM deployments JOIN (VALUES ('even', 0), ('even', 2), ('low', 0), ('low', 1)) AS a(r, m) ON repo % 4 = m AND commits > 0 JOIN (VALUES ('production', 0), ('any', 0), ('any', 1), ('any', 2)) AS b(e, v) ON env = v GROUP BY ALL")
def d08_deployments_by_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployments by groups of repositories and of environments, which overlap; a repository without deployed commits doesn't count."""
    meet = lambda c, sets: F.explode(F.array_compact(F.array(*[F.when(c.isin(*m), n) for n, m in sets.items()])))
    rows = facts(spark, sf_dir, "deployments").where("commits > 0").withColumn("repo_group", meet(F.col("repo") % 4, {"even": (0, 2), "low": (0, 1)}))
    rows = rows.withColumn("env_group", meet(F.col("env"), {"production": (0,), "any": (0, 1, 2)}))
    return rows.groupBy("repo_group", "env_group").agg(F.count("*").alias("deployments"), F.count_if(F.col("conclusion") == "SUCCESS").alias("successful"))


@query("prs", "SELECT grp, env, deployed, bool_or(label = '1-URGENT') AS included, bool_and(label <> '5-LOW') AS clean FROM prs WHERE deployed IS NOT NULL GROUP BY ALL HAVING bool_or(label = '1-URGENT') OR bool_and(label <> '5-LOW')")
def d14_filtered_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployments that a filter keeps: one that includes passes on any request, one that only excludes needs all to pass."""
    sent = facts(spark, sf_dir, "prs").where("deployed is not null").groupBy("grp", "env", "deployed")
    return sent.agg(F.bool_or(F.col("label") == "1-URGENT").alias("included"), F.bool_and(F.col("label") != "5-LOW").alias("clean")).where("included or clean")


def combined(a: dict[str, set], b: dict[str, set]) -> dict[str, set]:
    """A filter of issue traits that passes what both pass: lists of one trait intersect."""
    return {t: a[t] & b[t] if t in a and t in b else a.get(t, b.get(t)) for t in {*a, *b}}


@query("prs", "SELECT DISTINCT node_id FROM prs JOIN lineitem ON l_orderkey = node_id AND l_shipdate >= o_orderdate JOIN part ON p_partkey = l_partkey WHERE p_type IN ('ECONOMY', 'PROMO') AND p_type IN ('PROMO', 'SMALL') AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def e19_combined_issue_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with an issue that two filters pass; the filters are made one first, so issues are scanned once."""
    one = combined({"p_type": {"ECONOMY", "PROMO"}, "p_brand": {"Brand#1", "Brand#2", "Brand#3"}}, {"p_type": {"PROMO", "SMALL"}})
    parts = facts(spark, sf_dir, "parts")
    for trait, wanted in one.items():
        parts = parts.where(F.col(trait).isin(*sorted(wanted)))
    lines = facts(spark, sf_dir, "lines").join(parts.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    prs = facts(spark, sf_dir, "prs").select("node_id", "created")
    return lines.join(prs, F.col("l_orderkey") == F.col("node_id")).where("at >= created").select("node_id").distinct()


@query("prs", "SELECT chart, series, idx, count(*) AS closed, CAST(trunc(avg(closed - created)) AS BIGINT) AS open_time FROM (SELECT 'repositories' AS chart, grp AS series, created, closed FROM prs WHERE grp IN ('NATION_1', 'NATION_2', 'NATION_3') UNION ALL SELECT 'teams', CAST(region AS VARCHAR), created, closed FROM prs UNION ALL SELECT 'priorities', label, created, closed FROM prs WHERE label IN ('1-URGENT', '2-HIGH')) JOIN steps ON closed >= ts_from AND closed < ts_to GROUP BY ALL")
def e22_dashboard_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts of one metric, each grouped by its own stored rule (repositories, teams, labels), in one pass over the facts."""
    charts = {"repositories": F.when(F.col("grp").isin("NATION_1", "NATION_2", "NATION_3"), F.col("grp")), "teams": F.col("region").cast("string"), "priorities": F.when(F.col("label").isin("1-URGENT", "2-HIGH"), F.col("label"))}
    rows = binned(facts(spark, sf_dir, "prs"), steps("prs"), "closed")
    rows = rows.select("idx", "created", "closed", F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("chart"), c.alias("series")) for n, c in charts.items()]), lambda x: x["series"].isNotNull())).alias("c"))
    return rows.groupBy("c.chart", "c.series", "idx").agg(F.count("*").alias("closed"), (F.sum(F.expr("closed - created")) / F.count("*")).cast("bigint").alias("open_time"))


@query("issues", "SELECT id, category FROM issues JOIN part ON p_partkey = id WHERE created < 820454400 AND (resolved IS NULL OR resolved >= 788918400) AND category IN ('Done', 'In Progress') AND (grp IN ('ECONOMY', 'PROMO') OR list_has_any(string_split(p_name, ' '), ['red', 'small']))")
def f21_scanned_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues active in 1995 of the wanted status, by type or by a label of theirs."""
    labels = facts(spark, sf_dir, "parts").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("labels"))
    rows = facts(spark, sf_dir, "issues").where("created < 820454400 and (resolved is null or resolved >= 788918400) and category in ('Done', 'In Progress')")
    meet = F.arrays_overlap("labels", F.array(F.lit("red"), F.lit("small")))
    return rows.join(labels, "id").where(F.col("grp").isin("ECONOMY", "PROMO") | meet).select("id", "category")


@query("issues", "SELECT e.id AS epic, count(c.id) AS children, count(CASE WHEN c.category = 'Done' THEN 1 END) AS done, max(c.resolved) AS last_resolved FROM issues e LEFT JOIN issues c ON c.id - c.id % 10 = e.id AND c.id <> e.id WHERE e.id % 10 = 0 GROUP BY 1")
def f23_epics_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epics (ids divisible by ten) with their children counted: children name their epic, so one grouping does and no self join."""
    rows = facts(spark, sf_dir, "issues").withColumn("epic", F.expr("id - id % 10")).withColumn("child", F.col("id") != F.col("epic"))
    told = rows.groupBy("epic").agg(F.count_if("child").alias("children"), F.count_if(F.col("child") & (F.col("category") == "Done")).alias("done"), F.max(F.when(F.col("child"), F.col("resolved"))).alias("last_resolved"), F.bool_or(~F.col("child")).alias("known"))
    return told.where("known").drop("known")


@query("issues", "SELECT kind, name, count(*) AS issues, max(updated) AS last_update FROM (SELECT 'type' AS kind, grp AS name, coalesce(resolved, created) AS updated FROM issues UNION ALL SELECT 'status', category, coalesce(resolved, created) FROM issues UNION ALL SELECT 'priority', CASE WHEN p_size >= 40 THEN 'high' ELSE 'low' END, coalesce(resolved, created) FROM issues JOIN part ON p_partkey = id UNION ALL SELECT 'label', unnest(string_split(p_name, ' ')), coalesce(resolved, created) FROM issues JOIN part ON p_partkey = id) GROUP BY ALL")
def f24_tracker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, statuses, priorities and labels in use, with counts and last update; one pass."""
    part = facts(spark, sf_dir, "parts").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    rows = facts(spark, sf_dir, "issues").join(part, "id").withColumn("updated", F.coalesce("resolved", "created").cast("long"))
    item = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    own = F.array(item("type", F.col("grp")), item("status", F.col("category")), item("priority", F.when(F.col("p_size") >= 40, "high").otherwise("low")))
    every = F.concat(own, F.transform(F.split("p_name", " "), lambda x: item("label", x)))
    return rows.select("updated", F.explode(every).alias("i")).groupBy("i.kind", "i.name").agg(F.count("*").alias("issues"), F.max("updated").alias("last_update"))


@query("issues", "SELECT p_partkey AS id, coalesce(n, 0) AS comments, array_to_string(list_sort(list_distinct(list_append(string_split(p_name, ' '), p_brand))), ',') AS labels FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def f25_comments_and_component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of each issue (review lines), and its labels with its component (brand) among them."""
    from ..sources.tables import table

    said = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    labels = F.array_sort(F.array_union(F.split("p_name", " "), F.array("p_brand")))
    return facts(spark, sf_dir, "parts").join(said, "p_partkey", "left").select(F.col("p_partkey").alias("id"), F.coalesce("n", F.lit(0)).alias("comments"), F.array_join(labels, ",").alias("labels"))


@query("issues", "SELECT grp AS project_key, brand AS project, CAST(min(created) AS BIGINT) AS first_issue FROM (SELECT i.*, p_brand AS brand, EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = id AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND l_quantity >= 48) AS mapped FROM issues i JOIN part ON p_partkey = id) GROUP BY ALL HAVING NOT bool_or(mapped) AND min(created) < 725846400")
def f27_unused_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects (type and brand) whose first issue is old and none of whose issues is mapped to an urgent rejected request by a large line."""
    from ..sources.tables import table

    rejected = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    mapped = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").join(rejected, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("id")).distinct().withColumn("mapped", F.lit(True))
    rows = facts(spark, sf_dir, "issues").join(facts(spark, sf_dir, "parts").select(F.col("p_partkey").alias("id"), "p_brand"), "id").join(mapped, "id", "left")
    kept = rows.groupBy(F.col("grp").alias("project_key"), F.col("p_brand").alias("project")).agg(F.min("created").cast("long").alias("first_issue"), F.count("mapped").alias("m"))
    return kept.where("m = 0 and first_issue < 725846400").drop("m")
