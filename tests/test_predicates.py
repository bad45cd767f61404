"""Lists, labels, active repositories and logical repositories on small tables."""

import pytest
from pyspark.sql import functions as F

from tidewake.operators import predicates
from tidewake.operators.predicates import active_repositories, labelled, listed, logical_duplicates, upserted_labels


@pytest.mark.parametrize(("inline", "broadcast"), [(100, 100), (0, 100), (0, 0)])
def test_lists_whatever_their_length(spark, monkeypatch, inline, broadcast):
    monkeypatch.setattr(predicates, "INLINE", inline)
    monkeypatch.setattr(predicates, "BROADCAST", broadcast)
    rows = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "x long")
    of = lambda *a: sorted(r.x for r in listed(rows, "x", *a).collect())
    assert of([2, 3, 3, None]) == [2, 2, 3] and of([2, None], False) == [1, 3]
    assert of([]) == [] and of([], False) == [1, 2, 2, 3]


def test_labels(spark):
    held = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", {}), ("c", None)], "name string, labels map<string,string>")
    changes = spark.createDataFrame([("a", "x", "8", 1), ("a", "x", "9", 2), ("a", "z", None, 1), ("b", "x", "1", 1), ("b", None, "1", 1), ("q", "x", "1", 1)], "name string, key string, value string, at long")
    got = upserted_labels(held, changes)
    assert {r.name: r.labels for r in got.collect()} == {"a": {"x": "9", "y": "2", "z": None}, "b": {"x": "1"}, "c": {}}
    named = lambda *a: sorted(r.name for r in held.where(labelled(F.col("labels"), *a)).collect())
    assert named({}, {}) == ["a", "b", "c"] and named({"x": "1", "w": "0"}, {}) == ["a"] and named({}, {"y": "2"}) == ["b", "c"] and named({"x": "1"}, {"y": "2"}) == []


def test_active_repositories(spark):
    activity = spark.createDataFrame([("a", 5), ("a", 6), ("b", 10), ("c", 4), (None, 5)], "repo string, at long")
    pending = spark.createDataFrame([("a",), ("c",), ("c",)], "repo string")
    assert {r.repo: r.active for r in active_repositories(activity, 5, 10, pending).collect()} == {"a": True, "c": False}
    assert [r.repo for r in active_repositories(activity, 5, 10).collect()] == ["a"]


def test_logical_repositories_of_equal_settings(spark):
    rows = spark.createDataFrame([("r/a", 1), ("r/b", 1), ("r/b", 2), ("r/c", 1), ("s/a", 1), ("plain", 1), ("other", 1), ("r/d", 3), ("r/e", 3)], "repo string, node_id long")
    settings = spark.createDataFrame([("r/a", "r", "v", "p"), ("r/b", "r", "v", "p"), ("r/c", "r", "v", "q"), ("s/a", "s", "v", "p"), ("r/d", "r", None, "p"), ("r/e", "r", None, "p")], "repo string, root string, tags string, titles string")
    got = sorted((r.repo, r.node_id) for r in logical_duplicates(rows, settings, "node_id").collect())
    assert got == [("other", 1), ("plain", 1), ("r/a", 1), ("r/b", 2), ("r/c", 1), ("r/d", 3), ("s/a", 1)]
