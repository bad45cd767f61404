"""Metrics asked for by id, over several interval series and overlapping sets of groups, in one pass of their facts."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import facts, query
from ..functions.intervals import bucket, interval_rows, seconds, split
from ..plans import facts as plans
from .metrics import METRICS, RESOLUTION, Metric

#: Metric ids and what they are computed by.
BY_ID: dict[str, Metric] = {
    f"pr-{name}-{kind}": METRICS[row]["value"]
    for name, rows in (("wip", ("p01_pr_wip_time", "p02_pr_wip_count", "p03_pr_wip_below_threshold")), ("review", ("p04_pr_review_time", "p05_pr_review_count", "p06_pr_review_below_threshold")), ("merging", ("p07_pr_merging_time", "p08_pr_merging_count", "p09_pr_merging_below_threshold")), ("open", ("p12_pr_open_time", "p13_pr_open_count", "p14_pr_open_below_threshold")), ("lead", ("p15_pr_lead_time", "p16_pr_lead_count", "p17_pr_lead_below_threshold")))
    for kind, row in zip(("time", "count", "time-below-threshold-ratio"), rows, strict=True)
} | {
    "pr-opened": METRICS["p24_pr_opened"]["value"], "pr-merged": METRICS["p26_pr_merged"]["value"], "pr-rejected": METRICS["p27_pr_rejected"]["value"], "pr-closed": METRICS["p28_pr_closed"]["value"], "pr-done": METRICS["p31_pr_done"]["value"],
    "pr-size": METRICS["p34_pr_size"]["mean_size"], "pr-median-size": METRICS["p34_pr_size"]["median_size"],
    "release-count": METRICS["r01_release_count"]["every"], "release-age": METRICS["r08_release_age"]["every"],
    "dep-count": METRICS["d01_dep_count"]["every"], "dep-duration-all": METRICS["d02_dep_duration"]["every"], "jira-raised": METRICS["j01_jira_raised"]["value"], "jira-resolved": METRICS["j02_jira_resolved"]["value"],
}


def metrics_asked(rows: DataFrame | dict[str, DataFrame], ids: list[str], series: dict[str, list[dt.date]], sets: dict[str, list[str]]) -> DataFrame:
    """(metric, set, series, idx, value): every cell that has a fact. rows: facts with ``grp``, of one kind or by the name of their kind; series: boundaries by name; sets: groups by name, which may overlap.

    Each fact gives a row for each distinct event time, set and interval that
    holds it, and one grouping serves all metrics of a kind; a set holds groups of
    any kind. An id asked for twice counts once. An unknown id, or one whose facts
    aren't given, raises an error.
    """
    if unknown := [i for i in ids if i not in BY_ID]:
        raise ValueError(f"no such metric: {', '.join(unknown)}")
    asked = {i: BY_ID[i] for i in ids}
    kinds = list(dict.fromkeys(m.facts for m in asked.values()))
    if not isinstance(rows, dict):
        if len(kinds) != 1:
            raise ValueError("the metrics are of several kinds of facts")
        rows = {kinds[0]: rows}
    if missing := [k for k in kinds if k not in rows]:
        raise ValueError(f"no facts given for: {', '.join(missing)}")
    parts = [_of_one_kind(rows[k], {i: m for i, m in asked.items() if m.facts == k}, series, sets) for k in kinds]
    return reduce(DataFrame.unionByName, parts)


def _of_one_kind(rows: DataFrame, asked: dict[str, Metric], series: dict[str, list[dt.date]], sets: dict[str, list[str]]) -> DataFrame:
    times = list(dict.fromkeys(m.time for m in asked.values()))
    members = [F.when(F.col("grp").isin(*groups), F.lit(name)) for name, groups in sets.items()]
    events = rows.withColumn("set", F.explode(F.array_compact(F.array(*members)))).withColumn("event", F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.expr(t).cast("bigint").alias("at")) for k, t in enumerate(times)])))
    events = events.withColumn("tw_at", F.col("event.at")).where("tw_at is not null")
    cells = F.array(*[F.struct(F.lit(name).alias("series"), bucket(F.col("tw_at"), [seconds(d) for d in bounds]).alias("idx")) for name, bounds in series.items()])
    events = events.withColumn("cell", F.explode(cells)).where("cell.idx is not null")
    told = events.groupBy("set", F.col("cell.series").alias("series"), F.col("cell.idx").alias("idx")).agg(*[m.aggregate(F.col("event.which") == times.index(m.time)).cast("double").alias(i) for i, m in asked.items()])
    return told.select("set", "series", "idx", F.explode(F.array(*[F.struct(F.lit(i).alias("metric"), F.col(f"`{i}`").alias("value")) for i in asked])).alias("m")).select("m.metric", "set", "series", "idx", "m.value")


_IDS = ["pr-lead-time", "pr-open-count", "pr-open-time-below-threshold-ratio", "pr-opened", "pr-size", "pr-median-size"]
_SERIES = {"months": split("month", dt.date(1996, 1, 1), dt.date(1997, 12, 31)), "years": split("aligned year", dt.date(1995, 3, 1), dt.date(2000, 2, 28))}
_SETS = {"early": [f"NATION_{k}" for k in range(12)], "even": [f"NATION_{k}" for k in range(0, 25, 2)], "alone": ["NATION_3"]}
_CELLS = "asked_sets(name, grp) AS (VALUES " + ", ".join(f"('{n}', '{g}')" for n, gs in _SETS.items() for g in gs) + "), spans(series, idx, ts_from, ts_to) AS (VALUES " + ", ".join(f"('{n}', {i}, {a}, {b})" for n, bounds in _SERIES.items() for i, a, b in interval_rows(bounds)) + ")"
_LEAD_SQL = {  # sample, event time and aggregate of each, written out
    "pr-lead-time": ("released - work_began", "released", "CAST(trunc(CAST(sum(x) AS DOUBLE) / count(x)) AS DOUBLE)"), "pr-open-count": ("closed - created", "closed", "CAST(count(x) AS DOUBLE)"),
    "pr-open-time-below-threshold-ratio": ("closed - created", "closed", "coalesce(round(avg(CASE WHEN x <= 259200 THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END), 9), 0.0)"), "pr-opened": ("1", "created", "CAST(count(x) AS DOUBLE)"),
    "pr-size": ("size", "created", "CAST(trunc(CAST(sum(x) AS DOUBLE) / count(x)) AS DOUBLE)"), "pr-median-size": ("size", "created", "CAST(trunc(median(x)) AS DOUBLE)"),
}
_PER_METRIC = " UNION ALL ".join(f"SELECT '{i}' AS metric, name, series, idx, {agg} AS value FROM (SELECT name, series, idx, {x} AS x FROM prs JOIN asked_sets USING (grp) JOIN spans ON ({t}) >= ts_from AND ({t}) < ts_to) GROUP BY ALL" for i, (x, t, agg) in _LEAD_SQL.items())
_ALL_CELLS = " UNION ".join(f"SELECT name, series, idx FROM prs JOIN asked_sets USING (grp) JOIN spans ON {t} >= ts_from AND {t} < ts_to" for t in ("released", "closed", "created"))


@query("prs", f"SELECT c.metric, c.name AS set, c.series, c.idx, coalesce(v.value, CASE WHEN c.metric IN ('pr-open-count', 'pr-opened', 'pr-open-time-below-threshold-ratio') THEN 0.0 END) AS value FROM (SELECT * FROM ({_ALL_CELLS}) CROSS JOIN (SELECT unnest([{', '.join(repr(i) for i in _IDS)}]) AS metric)) c LEFT JOIN ({_PER_METRIC}) v USING (metric, name, series, idx)", _CELLS)
def e01_e06_e15_metrics_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six metrics by id over months and years and three sets of repositories, two of which overlap."""
    return metrics_asked(facts(spark, sf_dir, "prs"), _IDS, _SERIES, _SETS)


_MIXED_SERIES = {"years": split("aligned year", dt.date(1992, 1, 1), dt.date(2025, 12, 31)), "january": split("week", dt.date(2024, 1, 1), dt.date(2024, 1, 31))}
_MIXED_SETS = {"first": [*[f"NATION_{k}" for k in range(8)], "PROMO", "STANDARD", "0", "1", "2"], "second": [*[f"NATION_{k}" for k in range(5, 20)], "PROMO", "2", "3", "4", "5"], "releases alone": ["NATION_21"]}
_MIXED = {  # id: facts, sample, event time, aggregate of the samples x, and whether an empty cell is 0; written out
    "pr-closed": ("prs", "1", "closed", "count(x)", True), "pr-lead-time": ("prs", "released - work_began", "released", "trunc(CAST(sum(x) AS DOUBLE) / count(x))", False),
    "release-count": ("releases", "1", "published", "sum(x)", True), "release-age": ("releases", "age", "published", "trunc(CAST(sum(x) AS DOUBLE) / count(x))", False),
    "dep-count": ("deployments", "1", "finished", "sum(x)", True), "dep-duration-all": ("deployments", "CASE WHEN conclusion <> 'CANCELLED' THEN finished - started END", "finished", "trunc(CAST(sum(x) AS DOUBLE) / count(x))", False),
    "jira-raised": ("issues", "1", "created", "count(x)", True), "jira-resolved": ("issues", "1", RESOLUTION, "count(x)", True),
}
_MIXED_CELLS = "asked_sets(name, grp) AS (VALUES " + ", ".join(f"('{n}', '{g}')" for n, gs in _MIXED_SETS.items() for g in gs) + "), spans(series, idx, ts_from, ts_to) AS (VALUES " + ", ".join(f"('{n}', {i}, {a}, {b})" for n, bounds in _MIXED_SERIES.items() for i, a, b in interval_rows(bounds)) + ")"
_MIXED_VALUES = " UNION ALL ".join(f"SELECT '{i}' AS metric, name, series, idx, CAST({agg} AS DOUBLE) AS value FROM (SELECT name, series, idx, {x} AS x FROM {kind} JOIN asked_sets USING (grp) JOIN spans ON ({t}) >= ts_from AND ({t}) < ts_to) GROUP BY ALL" for i, (kind, x, t, agg, _) in _MIXED.items())
_MIXED_KNOWN = " UNION ".join(f"SELECT name, series, idx, unnest([{', '.join(repr(i) for i, m in _MIXED.items() if m[0] == kind)}]) AS metric FROM {kind} JOIN asked_sets USING (grp) JOIN spans ON ({t}) >= ts_from AND ({t}) < ts_to" for kind, t in dict.fromkeys((m[0], m[2]) for m in _MIXED.values()))
_MIXED_ZERO = ", ".join(f"'{i}'" for i, m in _MIXED.items() if m[4])


@query("prs", f"SELECT c.metric, c.name AS set, c.series, c.idx, coalesce(v.value, CASE WHEN c.metric IN ({_MIXED_ZERO}) THEN 0.0 END) AS value FROM ({_MIXED_KNOWN}) c LEFT JOIN ({_MIXED_VALUES}) v USING (metric, name, series, idx)", ", ".join([plans.SQL["releases"], plans.SQL["ev"], plans.SQL["deployments"], plans.SQL["issues"], _MIXED_CELLS]))
def e01_e06_e15_metrics_of_several_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight metrics of requests, releases, deployments and issues asked for in one call, over years and weeks and three sets."""
    kinds = dict.fromkeys(m[0] for m in _MIXED.values())
    return metrics_asked({k: facts(spark, sf_dir, k) for k in kinds}, list(_MIXED), _MIXED_SERIES, _MIXED_SETS)
