"""Requests merged although a check's latest run failed."""

import datetime as dt

from tidewake.operators.lists import merged_with_failed_checks

RUNS, REQUESTS = "pr long, name string, started long, event_id long, conclusion string", "node_id long, grp string, created long, closed long, merged long"


def test_latest_run_of_each_check_counts(spark):
    day = lambda d: int(dt.datetime(2020, 1, d, tzinfo=dt.UTC).timestamp())
    runs = [(1, "unit", 10, 1, "FAILURE"), (1, "unit", 20, 2, "SUCCESS"), (2, "unit", 10, 3, "SUCCESS"), (2, "lint", 10, 4, "FAILURE"), (2, "slow", 10, 5, "FAILURE"), (3, "unit", 10, 6, "FAILURE"), (4, "unit", 10, 7, None), (None, "unit", 30, 8, "FAILURE"), (6, "unit", 10, 9, "SUCCESS"), (6, "unit", 10, 10, "FAILURE")]
    requests = [(1, "a", day(1), day(3), day(3)), (2, "a", day(2), day(8), day(8)), (3, "a", day(1), day(2), None), (4, "a", day(6), day(7), day(7)), (5, "a", day(1), day(9), day(9)), (6, "b", day(5), day(5), day(5))]
    bounds = [dt.date(2020, 1, 1), dt.date(2020, 1, 5), dt.date(2020, 1, 9)]
    got = {(r.grp, r.idx): (r.merged_with_failed, r.merged_with_checks, r.failed_ratio) for r in merged_with_failed_checks(spark.createDataFrame(runs, RUNS), spark.createDataFrame(requests, REQUESTS), bounds).collect()}
    assert got == {("a", 0): (1, 2, 0.5), ("a", 1): (1, 2, 0.5), ("b", 1): (1, 1, 1.0)}


def test_empty(spark):
    assert merged_with_failed_checks(spark.createDataFrame([], RUNS), spark.createDataFrame([], REQUESTS), [dt.date(2020, 1, 1), dt.date(2020, 1, 5)]).count() == 0
