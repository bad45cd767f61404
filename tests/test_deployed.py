"""Requests of deployments, filters over them, groups of people, and what to redo."""

from tidewake.operators.deployed import by_participants, deployments_to_redo, filtered_deployments, requests_of_deployments


def test_a_request_stays_in_the_oldest_deployment(spark):
    owned = spark.createDataFrame([(0, 1, 10), (0, 2, 11), (1, 2, 11), (0, 3, 12), (0, 4, 13)], "env long, sha long, deployment long")
    merges = spark.createDataFrame([(100, 1), (100, 2), (101, 3), (101, 4), (102, 9)], "pr long, sha long")
    finished = spark.createDataFrame([(10, 7), (11, 5), (12, 8), (13, 8)], "deployment long, finished long")
    assert sorted(tuple(r) for r in requests_of_deployments(owned, merges, finished).select("env", "pr", "deployment").collect()) == [(0, 100, 11), (0, 101, 12), (1, 100, 11)]


def test_filters_by_requests(spark):
    rows = [(1, 1, ["Bug"], True), (1, 2, ["skip", "bug"], False), (2, 3, ["skip", "bug"], True), (3, 4, [], None), (3, 5, None, False), (4, None, ["bug"], True), (5, 6, ["other"], False), (5, 7, ["SKIP"], False)]
    held = spark.createDataFrame(rows, "deployment long, pr long, labels array<string>, has_issue boolean")
    of = lambda *a, **k: sorted(r.deployment for r in filtered_deployments(held, *a, **k).collect())
    assert of(["bug"]) == [1, 2] and of(["BUG"], ["skip"]) == [1] and of(exclude=["skip"]) == [3] and of() == [1, 2, 3, 5]
    assert of(issues=True) == [1, 2] and of(exclude=["skip"], issues=True) == [1]


def test_groups_of_people(spark):
    people = spark.createDataFrame([(1, [1, 2], [3]), (2, [], [5]), (3, None, [9])], "deployment long, pr_authors array<long>, commit_authors array<long>")
    groups = {"a": {"pr_authors": [2]}, "b": {"pr_authors": [1], "commit_authors": [5]}, "none": {"pr_authors": []}}
    assert sorted((r.deployment, r.people_group) for r in by_participants(people, groups).collect()) == [(1, "a"), (1, "b"), (2, "b")]


def test_what_to_redo(spark):
    stored = spark.createDataFrame([(0, 1, 7, 10), (0, 1, 7, 11), (0, 1, 8, 11), (1, 1, 7, 12), (0, 1, 9, 13), (0, 1, 9, 13)], "env long, repo long, sha long, deployment long")
    known = spark.createDataFrame([(10,), (11,), (12,)], "deployment long")
    assert sorted(r.deployment for r in deployments_to_redo(stored, known).collect()) == [10, 11, 13]
    assert deployments_to_redo(stored.where("false"), known).count() == 0
