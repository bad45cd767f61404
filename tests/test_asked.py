"""Metrics asked for by id."""

import datetime as dt

import pytest

from tidewake.operators.asked import metrics_asked

FACTS = "grp string, created long, closed long, merged long, released long, work_began long, size long"


def test_sets_overlap_and_series_differ(spark):
    day = lambda d: int(dt.datetime(2020, 1, d, tzinfo=dt.UTC).timestamp())
    rows = spark.createDataFrame([("a", day(1), day(3), None, None, day(1), 10), ("b", day(2), day(8), day(8), day(9), day(1), 31), ("c", day(2), None, None, None, day(2), 7), ("z", day(2), None, None, None, day(2), 99)], FACTS)
    series = {"all": [dt.date(2020, 1, 1), dt.date(2020, 1, 20)], "halves": [dt.date(2020, 1, 1), dt.date(2020, 1, 5), dt.date(2020, 1, 9)]}
    got = {(r.metric, r["set"], r.series, r.idx): r.value for r in metrics_asked(rows, ["pr-opened", "pr-open-time", "pr-size", "pr-lead-time"], series, {"ab": ["a", "b"], "bc": ["b", "c"], "none": ["q"]}).collect()}
    assert {k[1] for k in got} == {"ab", "bc"}
    assert (got["pr-opened", "ab", "all", 0], got["pr-opened", "bc", "all", 0], got["pr-size", "ab", "all", 0], got["pr-size", "bc", "all", 0]) == (2, 2, 20, 19)
    assert got["pr-open-time", "ab", "halves", 0] == 2 * 86400 and got["pr-open-time", "ab", "halves", 1] == 6 * 86400 and got["pr-opened", "ab", "halves", 1] == 0
    assert got["pr-lead-time", "bc", "all", 0] == 8 * 86400 and got["pr-lead-time", "bc", "halves", 1] is None


def test_ids_are_checked(spark):
    rows = spark.createDataFrame([], FACTS)
    with pytest.raises(ValueError, match="no such metric: pr-nothing"):
        metrics_asked(rows, ["pr-nothing"], {}, {})
    with pytest.raises(ValueError, match="several kinds"):
        metrics_asked(rows, ["pr-opened", "dep-count"], {}, {})


def test_facts_of_several_kinds_in_one_call(spark):
    day = lambda d: int(dt.datetime(2020, 1, d, tzinfo=dt.UTC).timestamp())
    prs = spark.createDataFrame([("a", day(1), day(3), None, None, day(1), 10), ("b", day(2), None, None, None, day(1), 30)], FACTS)
    shipped = spark.createDataFrame([("a", day(2), day(4), "SUCCESS"), ("c", day(2), day(6), "FAILURE"), ("c", day(2), day(6), "CANCELLED")], "grp string, started long, finished long, conclusion string")
    series = {"halves": [dt.date(2020, 1, 1), dt.date(2020, 1, 5), dt.date(2020, 1, 9)]}
    got = {(r.metric, r["set"], r.idx): r.value for r in metrics_asked({"prs": prs, "deployments": shipped}, ["pr-opened", "dep-count", "pr-opened", "dep-duration-all"], series, {"ab": ["a", "b"], "ac": ["a", "c"]}).collect()}
    assert got == {("pr-opened", "ab", 0): 2, ("pr-opened", "ac", 0): 1, ("dep-count", "ab", 0): 1, ("dep-duration-all", "ab", 0): 2 * 86400, ("dep-count", "ac", 0): 1, ("dep-duration-all", "ac", 0): 2 * 86400, ("dep-count", "ac", 1): 2, ("dep-duration-all", "ac", 1): 4 * 86400}
    with pytest.raises(ValueError, match="no facts given for: issues"):
        metrics_asked({"prs": prs}, ["pr-opened", "jira-raised"], series, {"ab": ["a"]})
