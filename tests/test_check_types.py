"""Statistics of check types on a small table."""

import datetime as dt

from tidewake.operators.check_types import check_type_stats, check_type_timelines

RUNS = "grp string, name string, suite long, commit long, pr long, started long, completed long, conclusion string"
BOUNDS = [dt.date(1970, 1, 1), dt.date(1970, 1, 2), dt.date(1970, 1, 3)]


def test_stats_and_timelines(spark):
    d = 86400
    rows = [
        ("a", "unit", 1, 1, 5, 0, 10, "SUCCESS"), ("a", "unit", 1, 1, 5, 20, 40, "FAILURE"), ("a", "unit", 2, 2, None, d, d + 1000, "NEUTRAL"), ("a", "unit", 2, 2, None, d + 1, None, None),
        ("a", "unit", 3, 3, 6, 5, 6, "SKIPPED"), ("a", "unit", 9, 9, 5, 3 * d, 3 * d + 1, "SUCCESS"), ("a", "lint", 1, 1, 5, 0, 41, "SUCCESS"),
    ]
    runs = spark.createDataFrame(rows, RUNS)
    got = {(r.name, r.side): r for r in check_type_stats(runs, BOUNDS, 0.0, 0.5).collect()}
    assert set(got) == {("unit", "total"), ("unit", "prs"), ("lint", "total"), ("lint", "prs")}
    t, p = got["unit", "total"], got["unit", "prs"]
    assert (t.last_run, t.sizes, t.runs, t.successes, t.skips, t.critical, t.flaky) == (3 * d, [2, 3], 4, 2, 1, True, 1)
    assert (t.mean_time, t.spread, t.median_time) == (15.0, 5.0, 20.0)
    assert (p.runs, p.successes, p.skips, p.critical, p.flaky, p.mean_time, p.spread, p.median_time) == (2, 1, 1, False, 1, 10.0, 0.0, 15.0)
    assert got["lint", "prs"].critical and got["lint", "prs"].flaky == 0
    lines = {(r.name, r.side, r.idx): (r.runs, r.successes, r.mean_time, r.median_time) for r in check_type_timelines(runs, BOUNDS, 0.0, 0.5).collect()}
    assert lines["unit", "total", 0] == (2, 1, 15.0, 15.0) and lines["unit", "total", 1] == (2, 1, None, 1000.0) and len(lines) == 5


def test_empty(spark):
    assert check_type_stats(spark.createDataFrame([], RUNS), BOUNDS).count() == 0
