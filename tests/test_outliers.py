"""First releases and deployments that are far too old."""

from tidewake.operators.outliers import first_outlier_deployments, first_outlier_releases, hidden_contents, ignoring_releases

MINED, ROLLS = "repo long, release long, published long, age long", "repo long, env long, deployment long, started long, conclusion string"


def test_first_release_against_the_median_of_the_others(spark):
    rows = [(1, 10, 5, 1000), (1, 11, 6, 10), (1, 12, 7, 10), (2, 20, 5, 999), (2, 21, 6, 10), (2, 22, 7, 10), (3, 30, 5, 1000), (3, 31, 6, 1), (4, 41, 6, 5000), (4, 40, 5, 10), (4, 42, 7, 10), (5, 50, 5, None), (5, 51, 6, 0), (5, 52, 6, 0)]
    mined = spark.createDataFrame(rows, MINED)
    assert [(r.repo, r.release) for r in first_outlier_releases(mined).collect()] == [(1, 10)]
    assert sorted(r.repo for r in first_outlier_releases(mined, 99).collect()) == [1, 2]
    requests = spark.createDataFrame([(1, 10, 5), (2, 11, 6), (3, None, None)], "pr long, release long, released long")
    got = sorted((r.pr, r.release, r.released, r.release_ignored) for r in ignoring_releases(requests, first_outlier_releases(mined)).collect())
    assert got == [(1, None, None, True), (2, 11, 6, False), (3, None, None, False)]


def test_first_deployment_of_any_conclusion_against_gaps_of_successes(spark):
    good = lambda repo, env, *ts: [(repo, env, repo * 100000 + env * 10000 + t, t, "SUCCESS") for t in ts]
    rows = good(1, 0, 1002, 1012, 1022) + [(1, 0, 7, 1001, "FAILURE")] + good(2, 0, 1000, 1010) + good(3, 0, 2000) + [(3, 0, 8, 2001, "FAILURE")] + good(4, 0, 101, 101, 101) + good(6, 0, 9000, 9001)
    born = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 0)], "repo long, created long")
    rolls = spark.createDataFrame(rows, ROLLS)
    found = first_outlier_deployments(rolls, born)
    assert sorted((r.repo, r.deployment) for r in found.collect()) == [(1, 7), (4, 400101)]
    held = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (1, 9, 3)], "repo long, deployment long, sha long")
    assert sorted(r.sha for r in hidden_contents(held, found).collect()) == [2, 3]


def test_empty(spark):
    assert first_outlier_releases(spark.createDataFrame([], MINED)).count() == 0
    assert first_outlier_deployments(spark.createDataFrame([], ROLLS), spark.createDataFrame([], "repo long, created long")).count() == 0
