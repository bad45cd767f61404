"""All queries of the delivery domain, and the SQL that they are held against."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.aggregates import cut_outliers
from .functions.intervals import alive_sums, binned, bucket, interval_rows, spread, split
from .operators.metrics import METRICS, SAMPLES, ZERO, Metric, compute
from .plans import facts as plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Quarters over the warehouse's dates, and weeks over the events'.
QUARTERS = split("3 month", dt.date(1992, 1, 1), dt.date(2002, 12, 31))
EVENT_SPANS = split("month", dt.date(2023, 1, 1), dt.date(2025, 12, 31))
BOUNDS = {"prs": QUARTERS, "releases": QUARTERS, "issues": QUARTERS, "linked_issues": QUARTERS, "checks": EVENT_SPANS, "deployments": EVENT_SPANS, "actions": EVENT_SPANS, "commits": EVENT_SPANS}


def facts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return plans.BUILD[name](spark, sf_dir)


def steps(name: str) -> list[dt.date]:
    """Boundaries of the intervals that the facts ``name`` are binned in."""
    return BOUNDS[name]


def with_sql(name: str, body: str, tables: str = "") -> str:
    """``body`` with the SQL fact tables that ``name`` needs, its intervals as ``steps``, and more tables of its own."""
    rows = ", ".join(f"({i}, {a}, {b})" for i, a, b in interval_rows(BOUNDS[name]))
    return "WITH RECURSIVE " + ",\n".join(plans.SQL[n] for n in plans.NEEDS[name]) + f",\nsteps(idx, ts_from, ts_to) AS (VALUES {rows})" + (f",\n{tables}" if tables else "") + f"\n{body}"


def _metric_query(row: str, metrics: dict[str, Metric]) -> None:
    name = next(iter(metrics.values())).facts
    QUERIES[row] = lambda spark, sf_dir: compute(facts(spark, sf_dir, name), steps(name), metrics)
    parts = "".join(f" LEFT JOIN (SELECT grp, idx, {m.sql()} AS {n} FROM {name} JOIN steps ON ({m.time}) >= ts_from AND ({m.time}) < ts_to GROUP BY ALL) AS part_{n} USING (grp, idx)" for n, m in metrics.items())
    known = " UNION ".join(f"SELECT grp FROM {name} JOIN steps ON ({m.time}) >= ts_from AND ({m.time}) < ts_to" for m in metrics.values())
    told = ", ".join(f"coalesce({n}, 0) AS {n}" if m.kind in ZERO else n for n, m in metrics.items())
    ORACLES[row] = with_sql(name, f"SELECT grp, idx, {told} FROM (SELECT DISTINCT grp FROM ({known})) CROSS JOIN (SELECT idx FROM steps){parts}")


for _row, _metrics in METRICS.items():
    _metric_query(_row, _metrics)


def query(name: str, body: str | None, tables: str = "") -> Callable:
    """Register a query over the facts ``name`` with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if body:
            ORACLES[f.__name__] = with_sql(name, body, tables)
        return f

    return add


def _cut_query(row: str, sample: str) -> None:
    s, t, _ = SAMPLES[sample]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = facts(spark, sf_dir, "prs").select("grp", F.expr(s).alias("sample"), F.expr(t).alias("at"))
        return binned(cut_outliers(rows, ["grp"], "at", "sample", 0.0, 0.95), steps("prs"), "at").groupBy("grp", "idx").agg(F.count("*").alias("value"))

    QUERIES[row] = run
    ORACLES[row] = with_sql("prs", f"""SELECT grp, idx, count(*) AS value FROM (
  SELECT *, max(CASE WHEN r = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) THEN sample END) OVER w AS hi, min(sample) OVER w AS lo FROM (
    SELECT *, row_number() OVER (PARTITION BY grp, cell ORDER BY sample) - 1 AS r, count(*) OVER (PARTITION BY grp, cell) AS n FROM (
      SELECT grp, {s} AS sample, {t} AS t_at, floor((({t}) - 946857600) / 5184000.0) AS cell FROM prs) WHERE sample IS NOT NULL AND t_at IS NOT NULL)
  WINDOW w AS (PARTITION BY grp, cell)) JOIN steps ON t_at >= ts_from AND t_at < ts_to WHERE sample BETWEEN lo AND hi GROUP BY ALL""")


for _row, _sample in (("p02q_pr_wip_count_q", "wip"), ("p05q_pr_review_count_q", "review"), ("p08q_pr_merging_count_q", "merging"), ("p11q_pr_release_count_q", "release"), ("p13q_pr_open_count_q", "open"), ("e04_outlier_cut_lead", "lead"), ("p22q_pr_wait_first_review_count_q", "wait_first_review"), ("p45q_pr_deployment_count_q", "deployment"), ("p47q_pr_lead_deployment_count_q", "lead_deployment")):
    _cut_query(_row, _sample)


@query("prs", """SELECT grp, idx, sum(o) AS opened, sum(c) AS closed, round((sum(o) + 1.0) / (sum(c) + 1.0), 9) AS flow_ratio, CAST(trunc(CAST(sum(s) AS DOUBLE) / nullif(sum(c), 0)) AS BIGINT) AS open_time FROM (
  SELECT grp, idx, 1 AS o, 0 AS c, 0 AS s FROM prs JOIN steps ON created >= ts_from AND created < ts_to
  UNION ALL SELECT grp, idx, 0, 1, closed - created FROM prs JOIN steps ON closed >= ts_from AND closed < ts_to) GROUP BY ALL""")
def flagship_nation_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opened, closed, flow ratio (P33) and mean open time per repository and quarter: two additive events a request, one grouping."""
    rows = facts(spark, sf_dir, "prs").select("grp", "created", "closed").selectExpr("grp", "stack(2, created, 1, 0, 0L, closed, 0, 1, closed - created) as (at, o, c, s)")
    cells = binned(rows, steps("prs"), "at").groupBy("grp", "idx").agg(F.sum("o").alias("opened"), F.sum("c").alias("closed"), F.sum("s").alias("s"))
    return cells.select("grp", "idx", "opened", "closed", F.round((F.col("opened") + 1.0) / (F.col("closed") + 1.0), 9).alias("flow_ratio"), F.when(F.col("closed") > 0, F.col("s") / F.col("closed")).cast("bigint").alias("open_time"))


_ALIVE = "created < ts_to AND (released >= ts_from OR closed >= ts_from OR closed IS NULL OR (merged < ts_from AND released IS NULL))"


#: The end of a request's life; none while it is open, or merged and unreleased.
_END = "CASE WHEN closed IS NOT NULL AND NOT (merged IS NOT NULL AND released IS NULL) THEN greatest(released, closed) END"


def _alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with each interval that their life overlaps."""
    return spread(facts(spark, sf_dir, "prs"), steps("prs"), "created", _END)


@query("prs", f"""SELECT grp, idx, count(*) AS alive, count(CASE WHEN n_issues > 0 THEN 1 END) AS mapped, round(avg(participants), 6) AS participants_per, round(avg(nullif(n_reviews, 0)), 6) AS reviews_per, round(avg(nullif(regular_comments + n_reviews, 0)), 6) AS comments_per,
  coalesce(round(avg(CASE WHEN n_reviews >= 3 THEN 1.0 WHEN n_reviews > 0 THEN 0.0 END), 9), 0.0) AS many_reviews,
  count(CASE WHEN NOT done AND merged IS NOT NULL THEN 1 END) AS releasing, count(CASE WHEN NOT done AND merged IS NULL AND approved IS NOT NULL THEN 1 END) AS merging,
  count(CASE WHEN NOT done AND merged IS NULL AND approved IS NULL AND first_review_request IS NOT NULL THEN 1 END) AS reviewing, count(CASE WHEN NOT done AND merged IS NULL AND approved IS NULL AND first_review_request IS NULL THEN 1 END) AS wip FROM prs JOIN steps ON {_ALIVE} GROUP BY ALL""")
def p20_p36_p42_pr_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose life overlaps the quarter (P20) and what is counted over them: P36 stages, P37-P42."""
    flag = lambda c: F.when(F.expr(c), 1)
    none = "NOT done AND merged IS NULL AND "
    sums = alive_sums(facts(spark, sf_dir, "prs"), steps("prs"), "created", _END, ["grp"], {
        "mapped": flag("n_issues > 0"), "participants": F.col("participants"), "reviews": F.col("n_reviews"), "reviewed": flag("n_reviews > 0"), "comments": F.expr("regular_comments + n_reviews"), "commented": flag("regular_comments + n_reviews > 0"), "many": flag("n_reviews >= 3"),
        "releasing": flag("NOT done AND merged IS NOT NULL"), "merging": flag(f"{none} approved IS NOT NULL"), "reviewing": flag(f"{none} approved IS NULL AND first_review_request IS NOT NULL"), "wip": flag(f"{none} approved IS NULL AND first_review_request IS NULL"),
    })
    per = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    many = F.coalesce(F.round(F.when(F.col("reviewed") > 0, F.col("many") / F.col("reviewed")), 9), F.lit(0.0))
    return sums.select("grp", "idx", "alive", "mapped", per("participants", "alive").alias("participants_per"), per("reviews", "reviewed").alias("reviews_per"), per("comments", "commented").alias("comments_per"), many.alias("many_reviews"), "releasing", "merging", "reviewing", "wip")


@query("checks", """SELECT grp, idx, count(*) AS suites, count(pr) AS in_prs, count(CASE WHEN conclusion IN ('SUCCESS', 'NEUTRAL') THEN 1 END) AS successful, round(count(CASE WHEN conclusion IN ('SUCCESS', 'NEUTRAL') THEN 1 END) / count(*), 9) AS success_ratio, CAST(trunc(CAST(sum(e - f.started) AS DOUBLE) / count(*)) AS BIGINT) AS suite_time, round(avg(CASE WHEN n > 1 AND e > s THEN busy / (n * (e - s)) END), 6) AS occupancy
  FROM firsts f JOIN (SELECT suite, min(started) AS s, max(completed) AS e, count(*) AS n, sum(completed - started) AS busy FROM checks GROUP BY ALL) USING (suite) JOIN steps ON f.started >= ts_from AND f.started < ts_to GROUP BY ALL""", "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY started, event_id) AS r FROM checks WHERE conclusion <> 'SKIPPED') WHERE r = 1)")
def c01_c05_c14_chk_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites (C01: the first run that isn't skipped speaks for its suite), counts C02-C04, time C05 and occupancy C14."""
    first = F.min(F.when(F.col("conclusion") != "SKIPPED", F.struct("started", "event_id", "conclusion", "pr"))).alias("first")
    suites = facts(spark, sf_dir, "checks").groupBy("grp", "suite").agg(first, F.min("started").alias("s"), F.max("completed").alias("e"), F.count("*").alias("n"), F.sum(F.col("completed") - F.col("started")).alias("busy")).where("first is not null")
    cells = binned(suites.select("*", "first.started", "first.conclusion", "first.pr"), steps("checks"), "started").groupBy("grp", "idx")
    good = F.count(F.when(F.col("conclusion").isin("SUCCESS", "NEUTRAL"), 1))
    return cells.agg(F.count("*").alias("suites"), F.count("pr").alias("in_prs"), good.alias("successful"), F.round(good / F.count("*"), 9).alias("success_ratio"), (F.sum(F.expr("e - started")) / F.count("*")).cast("bigint").alias("suite_time"), F.round(F.avg(F.expr("CASE WHEN n > 1 AND e > s THEN busy / (n * (e - s)) END")), 6).alias("occupancy"))


@query("checks", "SELECT grp, idx, count(*) AS flaky_commits FROM (SELECT grp, commit, min(s) AS s FROM (SELECT grp, commit, name, min(started) AS s FROM checks GROUP BY ALL HAVING bool_or(ok) AND bool_or(conclusion = 'FAILURE')) GROUP BY ALL) JOIN steps ON s >= ts_from AND s < ts_to GROUP BY ALL")
def c09_chk_flaky_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits where one check both succeeded and failed, dated by that check's first run."""
    both = facts(spark, sf_dir, "checks").groupBy("grp", "commit", "name").agg(F.min("started").alias("s"), F.bool_or("ok").alias("a"), F.bool_or(F.expr("conclusion = 'FAILURE'")).alias("b")).where("a and b")
    both = both.groupBy("grp", "commit").agg(F.min("s").alias("s"))
    return binned(both, steps("checks"), "s").groupBy("grp", "idx").agg(F.count("*").alias("flaky_commits"))


@query("checks", """SELECT event_id, round(sum(least(ae, be) - greatest(a_s, b_s)) / max(ae - a_s), 6) AS concurrency FROM (
  SELECT a.event_id, a.started AS a_s, greatest(a.completed, a.started + 1) AS ae, b.started AS b_s, greatest(b.completed, b.started + 1) AS be FROM checks a JOIN checks b ON a.grp = b.grp AND a.name = b.name AND b.started < greatest(a.completed, a.started + 1) AND greatest(b.completed, b.started + 1) > a.started) GROUP BY 1""")
def c11_chk_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-weighted number of runs open at once, itself included, by a sweep line.

    The area under the count of open runs up to a time is a running sum over
    starts and ends, so a run's mean is the difference of two areas over its
    length: a window and no self join.
    """
    runs = facts(spark, sf_dir, "checks").withColumn("e", F.greatest("completed", F.col("started") + 1))
    edges = runs.selectExpr("grp", "name", "event_id", "stack(2, started, 1, e, -1) as (at, step)")
    w = Window.partitionBy("grp", "name").orderBy("at")
    # open runs at t: sum(step); area up to t: t * open - sum(step * at)
    area = edges.withColumn("area", F.col("at") * F.sum("step").over(w) - F.sum(F.col("step") * F.col("at")).over(w))
    ends = area.groupBy("event_id").agg(F.max("area").alias("hi"), F.min("area").alias("lo"), (F.max("at") - F.min("at")).alias("n"))
    return ends.select("event_id", F.round((F.col("hi") - F.col("lo")) / F.col("n"), 6).alias("concurrency"))


@query("deployments", "SELECT grp, idx, round(count(CASE WHEN conclusion = 'SUCCESS' THEN 1 END) / count(*), 9) AS success_ratio, count(CASE WHEN conclusion = 'SUCCESS' AND failure_label THEN 1 END) AS change_failures, round(count(CASE WHEN conclusion = 'SUCCESS' AND failure_label THEN 1 END) / nullif(count(CASE WHEN conclusion = 'SUCCESS' THEN 1 END), 0), 9) AS failure_ratio FROM deployments JOIN steps ON finished >= ts_from AND finished < ts_to GROUP BY ALL")
def d03_d04_dep_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = F.count(F.expr("CASE WHEN conclusion = 'SUCCESS' THEN 1 END")), F.count(F.expr("CASE WHEN conclusion = 'SUCCESS' AND failure_label THEN 1 END"))
    return binned(facts(spark, sf_dir, "deployments"), steps("deployments"), "finished").groupBy("grp", "idx").agg(F.round(good / F.count("*"), 9).alias("success_ratio"), bad.alias("change_failures"), F.round(bad / F.nullif(good, F.lit(0)), 9).alias("failure_ratio"))


@query("deployments", "SELECT env, count(*) AS deployments, arg_max(conclusion, event_id) AS latest, count(DISTINCT repo) AS repositories FROM deployments GROUP BY ALL")
def d15_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, "deployments").groupBy("env").agg(F.count("*").alias("deployments"), F.max_by("conclusion", "event_id").alias("latest"), F.countDistinct("repo").alias("repositories"))


@query("deployments", "SELECT env, repo, event_id, finished FROM (SELECT *, row_number() OVER (PARTITION BY env, repo ORDER BY finished DESC, event_id) AS r FROM deployments WHERE conclusion = 'SUCCESS') WHERE r <= 2")
def q17_latest_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest two successful deployments per environment and repository."""
    w = Window.partitionBy("env", "repo").orderBy(F.desc("finished"), "event_id")
    return facts(spark, sf_dir, "deployments").where("conclusion = 'SUCCESS'").withColumn("r", F.row_number().over(w)).where("r <= 2").select("env", "repo", "event_id", "finished")


@query("issues", f"SELECT grp, idx, count(*) AS still_open FROM (SELECT *, CASE WHEN prs_began IS NOT NULL THEN CASE WHEN prs_released IS NOT NULL AND resolved IS NOT NULL THEN greatest(prs_released, resolved) END ELSE resolved END AS fixed FROM issues) JOIN steps ON created < ts_to AND (fixed IS NULL OR fixed >= ts_to) GROUP BY ALL")
def j03_jira_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = "CASE WHEN prs_began IS NOT NULL THEN CASE WHEN prs_released IS NOT NULL AND resolved IS NOT NULL THEN greatest(prs_released, resolved) END ELSE resolved END"
    rows = spread(facts(spark, sf_dir, "issues").withColumn("fixed", F.expr(fixed)), steps("issues"), "created", "fixed")
    ends = F.array(*[F.lit(b) for _, _, b in interval_rows(steps("issues"))])
    rows = rows.where(F.col("fixed").isNull() | (F.col("fixed") >= F.element_at(ends, F.col("idx") + 1)))
    return rows.groupBy("grp", "idx").agg(F.count("*").alias("still_open"))


@query("actions", "SELECT user_id, idx, count(DISTINCT CASE WHEN topic = 'click' THEN started // 86400 END) * 5 > (ts_to - ts_from) // 86400 AS active FROM actions JOIN steps ON started >= ts_from AND started < ts_to GROUP BY user_id, idx, ts_to, ts_from")
def v07_dev_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active: commits on more than a fifth of the interval's days."""
    days = F.countDistinct(F.expr("CASE WHEN topic = 'click' THEN started div 86400 END"))
    return binned(facts(spark, sf_dir, "actions"), steps("actions"), "started").groupBy("user_id", "idx", "ts_from", "ts_to").agg(days.alias("days")).select("user_id", "idx", F.expr("days * 5 > (ts_to - ts_from) div 86400").alias("active"))


@query("actions", "SELECT user_id, count(CASE WHEN topic = 'click' THEN 1 END) AS committer, count(CASE WHEN topic = 'view' THEN 1 END) AS reviewer, count(CASE WHEN topic = 'signup' THEN 1 END) AS author, count(CASE WHEN topic = 'purchase' THEN 1 END) AS releaser, count(CASE WHEN topic = 'error' THEN 1 END) AS commenter FROM actions GROUP BY 1")
def v13_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role counts of each person, by a pivot over topics."""
    roles = {"click": "committer", "view": "reviewer", "signup": "author", "purchase": "releaser", "error": "commenter"}
    wide = facts(spark, sf_dir, "actions").groupBy("user_id").pivot("topic", list(roles)).count()
    return wide.select("user_id", *[F.coalesce(k, F.lit(0)).alias(v) for k, v in roles.items()])


@query("prs", "SELECT label, count(*) AS prs FROM prs GROUP BY 1")
def v15_label_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, "prs").groupBy("label").agg(F.count("*").alias("prs"))


_STAGE = "CASE WHEN done THEN 'DONE' WHEN merged IS NOT NULL THEN 'RELEASING' WHEN approved IS NOT NULL THEN 'MERGING' WHEN first_review_request IS NOT NULL THEN 'REVIEWING' ELSE 'WIP' END"


@query("prs", f"SELECT node_id, {_STAGE} AS stage FROM prs")
def f07_pr_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, "prs").select("node_id", F.expr(_STAGE).alias("stage"))


@query("prs", f"SELECT CAST(floor(s / 864000) AS BIGINT) AS bin, count(*) AS frequency FROM (SELECT greatest(60, least({SAMPLES['open'][0]}, 2592000)) AS s FROM prs WHERE closed IS NOT NULL) GROUP BY 1")
def e14_histogram_open_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations clamped to [1 minute, 30 days] in bins of ten days."""
    s = F.greatest(F.lit(60), F.least(F.expr(SAMPLES["open"][0]), F.lit(2592000)))
    return facts(spark, sf_dir, "prs").where("closed is not null").select(F.floor(s / 864000).cast("bigint").alias("bin")).groupBy("bin").agg(F.count("*").alias("frequency"))


@query("prs", "SELECT g AS lines_group, grp, count(*) AS prs FROM prs JOIN (VALUES (0, 20, 50), (1, 50, 100), (2, 100, 150)) AS v(g, a, b) ON size >= a AND size < b GROUP BY ALL")
def e05_e07_group_by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two grouping dimensions at once: size bins [20, 50), [50, 100), [100, 150), with what lies outside left out, and repository."""
    return facts(spark, sf_dir, "prs").withColumn("lines_group", bucket(F.col("size"), [20, 50, 100, 150])).where("lines_group is not null").groupBy("lines_group", "grp").agg(F.count("*").alias("prs"))


from .operators import asked, bootstrap, check_types, checks, deployed, groups, histograms, history, identities, lists, matching, outliers, people, predicates, rebased, records, reruns, reviews, stored, streams, tracker  # noqa: E402, F401  they register their queries
