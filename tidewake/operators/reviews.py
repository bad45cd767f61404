"""Metrics and lists over the arrays of pull-request facts: reviews, activity days, stages, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import facts, query, steps
from ..functions.intervals import bucket, seconds
from .metrics import METRICS, SAMPLES, compute

_MARKS = [seconds(d) for d in steps("prs")]
_STAGES = ("wip", "review", "merging", "release")


def _at(t: Column) -> Column:
    return bucket(t, _MARKS)


_REVIEWED = """seen AS (SELECT DISTINCT p.grp, p.node_id, s.idx FROM prs p JOIN lineitem l ON l.l_orderkey = p.node_id AND l.l_returnflag = 'R' AND l.l_shipdate >= p.o_orderdate JOIN steps s ON epoch(l.l_shipdate) >= s.ts_from AND epoch(l.l_shipdate) < s.ts_to),
shut AS (SELECT grp, node_id, idx FROM prs JOIN steps ON closed >= ts_from AND closed < ts_to)"""


@query("prs", """SELECT grp, idx, coalesce(r, 0) AS reviewed, coalesce(n, 0) AS not_reviewed, coalesce(rc, 0) AS reviewed_closed, round(coalesce(r, 0) / nullif(coalesce(r, 0) + coalesce(n, 0), 0), 9) AS reviewed_ratio
FROM (SELECT grp, idx, count(*) AS r FROM seen GROUP BY ALL) FULL JOIN (SELECT grp, idx, count(CASE WHEN s.node_id IS NULL THEN 1 END) AS n, count(s.node_id) AS rc FROM shut LEFT JOIN seen s USING (grp, node_id, idx) GROUP BY ALL) USING (grp, idx)""", _REVIEWED)
def p25_p29_p30_p32_pr_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests reviewed in the quarter (each once), closed without and with a review in it, and the ratio of the first to both."""
    rows = facts(spark, sf_dir, "prs").select("grp", "node_id", F.array_distinct(F.transform("reviews", _at)).alias("seen"), _at(F.col("closed")).alias("shut"))
    cells = rows.withColumn("idx", F.explode(F.array_distinct(F.array_compact(F.concat("seen", F.array("shut"))))))
    cells = cells.withColumn("hit", F.array_contains("seen", F.col("idx"))).withColumn("ends", F.coalesce(F.col("shut") == F.col("idx"), F.lit(False)))
    count = lambda c: F.count(F.when(c, 1))
    out = cells.groupBy("grp", "idx").agg(count(F.col("hit")).alias("reviewed"), count(F.col("ends") & ~F.col("hit")).alias("not_reviewed"), count(F.col("ends") & F.col("hit")).alias("reviewed_closed"))
    return out.withColumn("reviewed_ratio", F.round(F.col("reviewed") / F.nullif(F.col("reviewed") + F.col("not_reviewed"), F.lit(0)), 9))


_STAGE_SQL = " UNION ".join(f"SELECT grp, node_id, idx FROM prs JOIN steps ON ({SAMPLES[s][1]}) >= ts_from AND ({SAMPLES[s][1]}) < ts_to WHERE ({SAMPLES[s][0]}) IS NOT NULL" for s in _STAGES)


@query("prs", f"SELECT grp, idx, count(*) AS value FROM ({_STAGE_SQL}) GROUP BY ALL")
def p19_pr_live_cycle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a sample of at least one of the four stages in the quarter: one pass, no union of facts."""
    times = F.array(*[F.when(F.expr(SAMPLES[s][0]).isNotNull(), _at(F.expr(SAMPLES[s][1]).cast("bigint"))) for s in _STAGES])
    rows = facts(spark, sf_dir, "prs").select("grp", F.explode(F.array_distinct(F.array_compact(times))).alias("idx"))
    return rows.groupBy("grp", "idx").agg(F.count("*").alias("value"))


@query("prs", """SELECT grp, idx, round(o, 9) AS opened_mapped, round(d, 9) AS done_mapped FROM (SELECT grp, idx, avg(CASE WHEN n_issues > 0 THEN 1.0 ELSE 0.0 END) AS o FROM prs JOIN steps ON created >= ts_from AND created < ts_to GROUP BY ALL)
FULL JOIN (SELECT grp, idx, avg(CASE WHEN n_issues > 0 THEN 1.0 ELSE 0.0 END) AS d FROM prs JOIN steps ON (CASE WHEN released IS NOT NULL THEN released WHEN merged IS NULL THEN closed END) >= ts_from AND (CASE WHEN released IS NOT NULL THEN released WHEN merged IS NULL THEN closed END) < ts_to WHERE done GROUP BY ALL) USING (grp, idx)""")
def p37_pr_mapped_to_jira(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of opened and of done requests that have issues."""
    done = F.when(F.col("done"), F.coalesce("released", F.when(F.col("merged").isNull(), F.col("closed"))))
    rows = facts(spark, sf_dir, "prs").select("grp", (F.col("n_issues") > 0).cast("double").alias("mapped"), F.explode(F.array(F.struct(F.lit(0).alias("which"), _at(F.col("created")).alias("idx")), F.struct(F.lit(1).alias("which"), _at(done).alias("idx")))).alias("e")).where("e.idx is not null")
    part = lambda k: F.round(F.avg(F.when(F.col("e.which") == k, F.col("mapped"))), 9)
    return rows.groupBy("grp", F.col("e.idx").alias("idx")).agg(part(0).alias("opened_mapped"), part(1).alias("done_mapped"))


_PARTS = ("p01_pr_wip_time", "p04_pr_review_time", "p07_pr_merging_time", "p10_pr_release_time", "p44_pr_deployment_time")
_PART_SQL = " JOIN ".join(f"(SELECT grp, idx, {METRICS[r]['value'].sql()} AS v{k} FROM prs JOIN steps ON ({METRICS[r]['value'].time}) >= ts_from AND ({METRICS[r]['value'].time}) < ts_to GROUP BY ALL) AS t{k}" + (" USING (grp, idx)" if k else "") for k, r in enumerate(_PARTS))


@query("prs", f"SELECT grp, idx, v0 + v1 + v2 + v3 + v4 AS value FROM {_PART_SQL} WHERE v0 + v1 + v2 + v3 + v4 IS NOT NULL")
def p48_pr_cycle_deployment_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four stage means and the deployment's, only where all exist."""
    cells = compute(facts(spark, sf_dir, "prs"), steps("prs"), {r[:3]: METRICS[r]["value"] for r in _PARTS})
    total = sum((F.col(r[:3]) for r in _PARTS[1:]), F.col(_PARTS[0][:3]))
    return cells.select("grp", "idx", total.alias("value")).where("value is not null")


@query("prs", "SELECT node_id, count(DISTINCT d) AS days, min(d) AS first_day, max(d) AS last_day FROM (SELECT node_id, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS d FROM prs JOIN lineitem ON l_orderkey = node_id AND l_shipdate >= o_orderdate UNION SELECT node_id, created // 86400 FROM prs UNION SELECT node_id, closed // 86400 FROM prs WHERE closed IS NOT NULL UNION SELECT node_id, released // 86400 FROM prs WHERE released IS NOT NULL) GROUP BY 1")
def f04_activity_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct days on which anything happened to a request: its commits, reviews and comments, and its creation, close and release."""
    rows = facts(spark, sf_dir, "prs")
    return rows.select("node_id", F.size("activity_days").cast("long").alias("days"), F.element_at("activity_days", 1).alias("first_day"), F.element_at("activity_days", -1).alias("last_day"))


@query("prs", "SELECT node_id, CASE WHEN last_commit > closed THEN 'last commit after close' WHEN created > closed THEN 'created after close' ELSE 'merged after release' END AS reason FROM prs WHERE last_commit > closed OR created > closed OR merged >= released - 86400")
def f05_sanity_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows set aside as impossible (a release within a day of the merge counts as before it here), with the first reason that holds."""
    reason = F.when(F.expr("last_commit > closed"), "last commit after close").when(F.expr("created > closed"), "created after close").when(F.expr("merged >= released - 86400"), "merged after release")
    return facts(spark, sf_dir, "prs").select("node_id", reason.alias("reason")).where("reason is not null")


_SINCE = 852076800


@query("prs", f"""SELECT node_id, event FROM (SELECT node_id, unnest(['CREATED', 'COMMITTED', 'REVIEWED', 'REVIEW_REQUESTED', 'APPROVED', 'MERGED', 'REJECTED', 'RELEASED', 'DEPLOYED']) AS event, unnest([created >= {_SINCE}, last_commit >= {_SINCE}, len(list_filter(reviews, lambda x: x >= {_SINCE} AND (closed IS NULL OR x <= closed))) > 0, first_review_request >= {_SINCE}, approved >= {_SINCE}, merged >= {_SINCE}, closed >= {_SINCE} AND merged IS NULL, released >= {_SINCE}, deployed >= {_SINCE}]) AS on_ FROM prs) WHERE on_""")
def f08_events_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened to each request since 1997-01-01."""
    since = lambda c: F.col(c) >= _SINCE
    told = {
        "CREATED": since("created"), "COMMITTED": since("last_commit"), "REVIEWED": F.exists("reviews", lambda x: (x >= _SINCE) & (F.col("closed").isNull() | (x <= F.col("closed")))), "REVIEW_REQUESTED": since("first_review_request"), "APPROVED": since("approved"),
        "MERGED": since("merged"), "REJECTED": since("closed") & F.col("merged").isNull(), "RELEASED": since("released"), "DEPLOYED": since("deployed"),
    }
    return facts(spark, sf_dir, "prs").select("node_id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in told.items()]))).alias("event"))


_NOW = 1041379200


@query("prs", f"SELECT node_id, {SAMPLES['wip'][0]} AS wip, CASE WHEN first_review_request IS NOT NULL THEN coalesce({SAMPLES['review'][1]}, {_NOW}) - first_review_request END AS review, CASE WHEN coalesce(approved, last_review, last_commit) IS NOT NULL AND (merged IS NOT NULL OR closed IS NULL) THEN coalesce(merged, {_NOW}) - coalesce(approved, last_review, last_commit) END AS merge, CASE WHEN merged IS NOT NULL THEN coalesce(released, {_NOW}) - merged END AS release FROM prs")
def f09_stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of each request in its stages; a stage that isn't over counts until 2003-01-01."""
    last = F.coalesce("approved", "last_review", "last_commit")
    merging = F.when(last.isNotNull() & (F.col("merged").isNotNull() | F.col("closed").isNull()), F.coalesce("merged", F.lit(_NOW)) - last)
    review = F.when(F.col("first_review_request").isNotNull(), F.coalesce(F.expr(SAMPLES["review"][1]), F.lit(_NOW)) - F.col("first_review_request"))
    return facts(spark, sf_dir, "prs").select("node_id", F.expr(SAMPLES["wip"][0]).alias("wip"), review.alias("review"), merging.alias("merge"), F.when(F.col("merged").isNotNull(), F.coalesce("released", F.lit(_NOW)) - F.col("merged")).alias("release"))


@query("prs", "SELECT p.node_id, p.label, count(DISTINCT l_partkey) AS issues, count(DISTINCT l_suppkey) AS people, p.merged FROM prs p JOIN lineitem ON l_orderkey = node_id AND l_shipdate >= o_orderdate WHERE p.label IN ('1-URGENT', '2-HIGH') AND p.merged IS NOT NULL AND p.n_reviews > 0 AND EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = node_id AND x.l_shipdate >= o_orderdate AND x.l_suppkey % 5 = 0) GROUP BY ALL")
def f10_f11_list_pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent merged and reviewed requests in which some wanted person took part, with the issues and people nested and counted."""
    prs = facts(spark, sf_dir, "prs").where("label in ('1-URGENT', '2-HIGH') and merged is not null and n_reviews > 0").select("node_id", "label", "merged", "created")
    lines = facts(spark, sf_dir, "lines").withColumnRenamed("l_orderkey", "node_id")
    nested = lines.join(prs, "node_id").where("at >= created").groupBy("node_id", "label", "merged").agg(F.collect_set("l_partkey").alias("i"), F.collect_set("l_suppkey").alias("p"))
    return nested.where(F.exists("p", lambda x: x % 5 == 0)).select("node_id", "label", F.size("i").cast("long").alias("issues"), F.size("p").cast("long").alias("people"), "merged")


@query("prs", "SELECT node_id FROM prs WHERE merged < 881020800 AND created < 881020800 AND (released IS NULL OR released >= 883612800)")
def f17_merged_unreleased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests merged before December 1997 that were not released in that year."""
    rows = facts(spark, sf_dir, "prs").select("node_id", "created", "merged", "done", "released").where("merged < 881020800 and created < 881020800")
    return rows.where(F.coalesce(F.when(F.col("done"), F.col("released")), F.lit(32503680000)) >= 883612800).select("node_id")


@query("prs", "SELECT p.node_id, list_aggregate(list_sort(list(DISTINCT split_part(p_type, ' ', 1))), 'string_agg', ',') AS types, CAST(max(p_size) AS BIGINT) AS priority FROM prs p JOIN lineitem ON l_orderkey = node_id AND l_shipdate >= o_orderdate JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING bool_or(p_size >= 45) AND bool_or(p_type LIKE 'ECONOMY%')")
def f19_f20_requests_by_jira(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with an issue of high priority and one of the wanted type; issue traits attached as arrays."""
    prs, part = facts(spark, sf_dir, "prs").select("node_id", "created"), facts(spark, sf_dir, "parts")
    lines = facts(spark, sf_dir, "lines").withColumnRenamed("l_orderkey", "node_id")
    held = lines.join(prs, "node_id").where("at >= created").join(part, F.col("l_partkey") == F.col("p_partkey"))
    traits = held.groupBy("node_id").agg(F.array_sort(F.collect_set(F.substring_index("p_type", " ", 1))).alias("types"), F.max("p_size").cast("long").alias("priority"))
    return traits.where((F.col("priority") >= 45) & F.array_contains("types", "ECONOMY")).select("node_id", F.array_join("types", ",").alias("types"), "priority")


@query("prs", "SELECT node_id, label FROM (SELECT node_id, label, CASE WHEN node_id % 7 = 0 THEN '5-LOW' ELSE label END AS kept FROM prs WHERE merged IS NOT NULL) WHERE kept <> label")
def f28_changed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored facts whose labels are stale (every seventh kept an old one here) and what they become."""
    now = facts(spark, sf_dir, "prs").where("merged is not null").select("node_id", "label")
    kept = now.select("node_id", F.when(F.col("node_id") % 7 == 0, "5-LOW").otherwise(F.col("label")).alias("kept"))
    return now.join(kept, "node_id").where(~F.col("label").eqNullSafe(F.col("kept"))).select("node_id", "label")
