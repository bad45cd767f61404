"""The metric registry: name -> facts, sample, event time and aggregate.

Expressions are Spark SQL over fact columns (times in seconds). ``kind``:
mean (whole numbers, cut toward zero), count, sum, max, share (of samples up to
``threshold``), average (double, 6 digits) or median.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import mean_int, share
from ..functions.intervals import binned, dense

DAY, HOUR = 86400, 3600


@dataclass(frozen=True)
class Metric:
    facts: str
    kind: str
    sample: str
    time: str
    threshold: int = 0

    def aggregate(self, of: Column | None = None) -> Column:
        """The aggregate, over the rows that ``of`` holds for."""
        x = F.expr(self.sample)
        x = x if of is None else F.when(of, x)
        return {
            "mean": lambda: mean_int(x), "count": lambda: F.count(x), "sum": lambda: F.coalesce(F.sum(x), F.lit(0)).cast("bigint"), "max": lambda: F.max(x), "share": lambda: share(x <= self.threshold), "average": lambda: F.round(F.avg(x), 6), "median": lambda: F.floor(F.percentile(x, 0.5)).cast("bigint"),
        }[self.kind]()

    def sql(self) -> str:
        x = self.sample
        return {
            "mean": f"CAST(trunc(CAST(sum({x}) AS DOUBLE) / count({x})) AS BIGINT)", "count": f"count({x})", "sum": f"CAST(coalesce(sum({x}), 0) AS BIGINT)", "max": f"max({x})", "share": f"coalesce(round(avg(CASE WHEN ({x}) <= {self.threshold} THEN 1.0 WHEN ({x}) > {self.threshold} THEN 0.0 END), 9), 0.0)", "average": f"round(avg({x}), 6)", "median": f"CAST(floor(quantile_cont({x}, 0.5)) AS BIGINT)",
        }[self.kind]


WIP_END = "coalesce(CASE WHEN last_review IS NOT NULL THEN first_review_request ELSE last_commit END, closed, first_review_request)"
REVIEW_END = "CASE WHEN closed IS NOT NULL AND first_review_request IS NOT NULL THEN coalesce(approved, last_review) END"
RELEASED_OR_MERGED = "CASE WHEN released <= deployed THEN released ELSE merged END"
SAMPLES = {  # name: (sample, event time, threshold)
    "wip": (f"{WIP_END} - work_began", WIP_END, DAY),
    "review": (f"{REVIEW_END} - first_review_request", REVIEW_END, 2 * DAY),
    "merging": ("merged - coalesce(approved, last_review, last_commit)", "merged", 4 * HOUR),
    "release": ("CASE WHEN merged IS NOT NULL THEN released - merged END", "released", 5 * DAY),
    "open": ("closed - created", "closed", 3 * DAY),
    "lead": ("released - work_began", "released", 5 * DAY),
    "wait_first_review": ("first_comment - first_review_request", "first_comment", 6 * HOUR),
    "deployment": (f"deployed - ({RELEASED_OR_MERGED})", "deployed", 5 * DAY),
    "lead_deployment": ("deployed - work_began", "deployed", 5 * DAY),
    "size": ("size", "created", 100),
}
METRICS: dict[str, dict[str, Metric]] = {}


def _register(row: str, **metrics: Metric) -> None:
    METRICS[row] = metrics


for _time, _count, _share, _name in (("p01", "p02", "p03", "wip"), ("p04", "p05", "p06", "review"), ("p07", "p08", "p09", "merging"), ("p10", "p11", None, "release"), ("p12", "p13", "p14", "open"), ("p15", "p16", "p17", "lead"), ("p21", "p22", "p23", "wait_first_review"), ("p44", "p45", None, "deployment"), ("p47", None, None, "lead_deployment")):
    _s, _t, _limit = SAMPLES[_name]
    _register(f"{_time}_pr_{_name}_time", value=Metric("prs", "mean", _s, _t))
    if _count:
        _register(f"{_count}_pr_{_name}_count", value=Metric("prs", "count", _s, _t))
    if _share:
        _register(f"{_share}_pr_{_name}_below_threshold", value=Metric("prs", "share", _s, _t, _limit))


def _counts(row: str, facts: str, condition: str, time: str) -> None:
    _register(row, value=Metric(facts, "count", f"CASE WHEN {condition} THEN 1 END", time))


_counts("p24_pr_opened", "prs", "1 = 1", "created")
_counts("p26_pr_merged", "prs", "1 = 1", "merged")
_counts("p27_pr_rejected", "prs", "merged IS NULL", "closed")
_counts("p28_pr_closed", "prs", "1 = 1", "closed")
_counts("p31_pr_done", "prs", "done", "coalesce(released, CASE WHEN merged IS NULL THEN closed END)")
_register("p34_pr_size", mean_size=Metric("prs", "mean", "size", "created"), median_size=Metric("prs", "median", "size", "created"))
_register("p35_pr_size_below_threshold", value=Metric("prs", "share", "size", "created", 100))
for _row, _by in (("r01_release_count", None), ("r02_release_prs", "prs"), ("r03_release_commits", "commits"), ("r04_release_lines", "lines")):
    _register(_row, **{n: Metric("releases", "sum", f"CASE WHEN {c} THEN {_by or 1} END", "published") for n, c in (("every", "1 = 1"), ("by_tag", "matched_by = 'tag'"), ("by_branch", "matched_by = 'branch'"))})
for _row, _by in (("r05_release_avg_prs", "prs"), ("r06_release_avg_commits", "commits"), ("r07_release_avg_lines", "lines"), ("r08_release_age", "age")):
    _register(_row, **{n: Metric("releases", "mean", f"CASE WHEN {c} THEN {_by} END", "published") for n, c in (("every", "1 = 1"), ("by_tag", "matched_by = 'tag'"), ("by_branch", "matched_by = 'branch'"))})
_register("d01_dep_count", **{n: Metric("deployments", "sum", f"CASE WHEN {c} THEN 1 END", "finished") for n, c in (("every", "1 = 1"), ("succeeded", "conclusion = 'SUCCESS'"), ("failed", "conclusion = 'FAILURE'"))})
_register("d02_dep_duration", **{n: Metric("deployments", "mean", f"CASE WHEN {c} THEN finished - started END", "finished") for n, c in (("every", "conclusion <> 'CANCELLED'"), ("succeeded", "conclusion = 'SUCCESS'"), ("failed", "conclusion = 'FAILURE'"))})
_register("d05_dep_size", **{f"avg_{x}": Metric("deployments", "average", x, "finished") for x in ("prs", "commits", "lines")})
_register("d06_dep_sums", **{f"sum_{x}": Metric("deployments", "sum", x, "finished") for x in ("prs", "commits", "lines")})
_counts("j01_jira_raised", "issues", "1 = 1", "created")
RESOLUTION = "CASE WHEN prs_began IS NOT NULL THEN CASE WHEN prs_released IS NOT NULL AND resolved IS NOT NULL THEN greatest(prs_released, resolved) END ELSE resolved END"
_counts("j02_jira_resolved", "issues", "1 = 1", RESOLUTION)
_LIFE = f"{RESOLUTION} - least(created, prs_began)"
_LEAD = f"{RESOLUTION} - least(work_began, prs_began)"
_ACK = "CASE WHEN category <> 'To Do' THEN least(work_began, prs_began) END"
_register("j05_jira_life_time", value=Metric("issues", "mean", _LIFE, "resolved"), below=Metric("issues", "share", _LIFE, "resolved", 5 * DAY))
_register("j06_jira_lead_time", value=Metric("issues", "mean", _LEAD, "resolved"), below=Metric("issues", "share", _LEAD, "resolved", 5 * DAY))
_register("j07_jira_acknowledge_time", value=Metric("issues", "mean", f"greatest(0, ({_ACK}) - created)", _ACK), below=Metric("issues", "share", f"greatest(0, ({_ACK}) - created)", _ACK, 3 * DAY))
_counts("j08_jira_acknowledged", "linked_issues", "1 = 1", _ACK)
_register("j09_jira_pr_lag_time", value=Metric("issues", "mean", "CASE WHEN category <> 'To Do' AND work_began IS NOT NULL THEN greatest(0, prs_began - work_began) END", "prs_began"))
_register("j10_jira_backlog_time", value=Metric("issues", "mean", "CASE WHEN category <> 'To Do' THEN work_began - created END", "work_began"))
_register("v01_dev_commits", pushed=Metric("actions", "count", "CASE WHEN topic = 'click' THEN 1 END", "started"), lines_changed=Metric("actions", "sum", "CASE WHEN topic = 'click' THEN lines END", "started"))
_register("v02_dev_prs", created_prs=Metric("actions", "count", "CASE WHEN topic = 'signup' THEN 1 END", "started"), merged_prs=Metric("actions", "count", "CASE WHEN topic = 'signup' AND lines % 2 = 0 THEN 1 END", "started"))
_counts("v03_dev_releases", "actions", "topic = 'purchase'", "started")
_register("v04_dev_reviews", **{n: Metric("actions", "count", f"CASE WHEN topic = 'view' AND {c} THEN 1 END", "started") for n, c in (("every", "1 = 1"), ("approvals", "lines % 3 = 0"), ("rejections", "lines % 3 = 1"), ("neutrals", "lines % 3 = 2"))})
_register("v06_dev_comments", every=Metric("actions", "count", "CASE WHEN topic IN ('error', 'view') THEN 1 END", "started"), regular=Metric("actions", "count", "CASE WHEN topic = 'error' THEN 1 END", "started"))
_register("v08_dev_active0", value=Metric("actions", "max", "CASE WHEN topic = 'click' THEN 1 ELSE 0 END", "started"))


#: Kinds whose empty cells are 0; the others don't exist there.
ZERO = ("count", "sum", "share")


def compute(facts: DataFrame, bounds: list[dt.date], metrics: dict[str, Metric], groups: tuple[str, ...] = ("grp",)) -> DataFrame:
    """(groups, idx, metrics) for every group with any fact in any interval.

    Metrics of several event times are one pass over the facts and one grouping:
    a fact gives a row for each distinct event time, and a metric aggregates the
    rows of its own.
    """
    times = list(dict.fromkeys(m.time for m in metrics.values()))
    if len(times) == 1:
        rows, own = binned(facts, bounds, times[0]), {n: m.aggregate() for n, m in metrics.items()}
    else:
        stacked = facts.withColumn("event", F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.expr(t).cast("bigint").alias("at")) for k, t in enumerate(times)])))
        rows, own = binned(stacked, bounds, "event.at"), {n: m.aggregate(F.col("event.which") == times.index(m.time)) for n, m in metrics.items()}
    cells = rows.groupBy(*groups, "idx").agg(*[c.alias(n) for n, c in own.items()])
    return dense(cells, len(bounds) - 1, groups, [n for n, m in metrics.items() if m.kind in ZERO])
