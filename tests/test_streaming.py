from pyspark.sql import functions as F


def _run(spark, df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(60)
    return spark.table(name)


def test_notifications_are_ingested_once_and_counted(spark, tmp_path):
    from tidewake.streaming.notifications import day_counters, ingest_once

    rows = [(1, "a", "deploy", "2024-01-01 10:00:00"), (1, "a", "deploy", "2024-01-01 11:00:00"), (2, "a", "deploy", "2024-01-01 11:00:00"), (1, None, "release", "2024-01-02 01:00:00"), (1, None, "release", "2024-01-02 01:00:00")]
    spark.createDataFrame(rows, "repo long, name string, kind string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo long, name string, kind string, ts timestamp").parquet(str(tmp_path / "in"))
    once = _run(spark, ingest_once(stream), "once", "append").collect()
    assert sorted((r.repo, r.kind) for r in once) == [(1, "deploy"), (1, "release"), (2, "deploy")] and all(r.name for r in once)
    counted = {(str(r.day)[:10], r.kind): r.n for r in _run(spark, day_counters(stream), "counted", "update").collect()}
    assert counted == {("2024-01-01", "deploy"): 3, ("2024-01-02", "release"): 2}


def _stream(spark, folder, columns, batches):
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, columns)
        for name in ("ts", "seen"):
            if name in df.columns:
                df = df.withColumn(name, F.to_timestamp(name))
        df.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_short_hashes_are_resolved_when_the_commit_comes_late(spark, tmp_path):
    from tidewake.streaming.notifications import resolve_references

    sha = "abcdef0123"
    asked = _stream(spark, tmp_path / "n", "repo long, short string, ts string", [[(1, sha[:7], "2024-01-01 10:00:00"), (2, sha[:7], "2024-01-01 10:00:00")], [(9, "x", "2024-01-09 00:00:00")], [(9, "y", "2024-01-19 00:00:00")]])
    known = _stream(spark, tmp_path / "c", "repo long, sha string, seen string", [[(3, "0", "2024-01-01 00:00:00")], [(1, sha, "2024-01-01 20:00:00"), (9, "0", "2024-01-09 00:00:00")], [(3, "1", "2024-01-19 00:00:00")]])
    got = {(r.repo, r.short): r.sha for r in _run(spark, resolve_references(asked, known), "resolved", "append").collect()}
    assert got[1, sha[:7]] == sha and got[2, sha[:7]] is None


def test_a_late_deployment_makes_newer_ones_stale(spark, tmp_path):
    from tidewake.streaming.notifications import keep_deployments, repaired_deployments

    rows = [[("prod", 1, 100), ("prod", 2, 300), ("test", 3, 300)], [("prod", 4, 200)], [("test", 5, 400)]]
    stream = _stream(spark, tmp_path / "d", "env string, id long, finished long", rows)
    assert keep_deployments(stream, str(tmp_path / "kept")).trigger(availableNow=True).start().awaitTermination(60)
    seen = {r.id: r.stale for r in repaired_deployments(spark, str(tmp_path / "kept")).collect()}
    assert sorted(seen) == [1, 2, 3, 4, 5]
    order = spark.read.parquet(str(tmp_path / "kept")).groupBy("id").agg(F.min("batch").alias("b"))
    came, time, env = {r.id: r.b for r in order.collect()}, {i: t for b in rows for _, i, t in b}, {i: e for b in rows for e, i, _ in b}
    assert seen == {i: any(env[j] == env[i] and came[j] > came[i] and time[j] < time[i] for j in seen) for i in seen}


def test_pending_checks_are_paired_or_given_up(spark, tmp_path):
    from tidewake.streaming.notifications import pending_with_completion

    one = [(1, "a", "2024-01-01 10:00:00", "PENDING"), (1, "a", "2024-01-01 10:05:00", "SUCCESS"), (2, "a", "2024-01-01 10:00:00", "PENDING"), (3, "a", "2024-01-01 11:00:00", "FAILURE")]
    stream = _stream(spark, tmp_path / "s", "suite long, name string, ts string, status string", [one, [(4, "a", "2024-01-04 00:00:00", "SUCCESS")], [(5, "a", "2024-01-05 00:00:00", "SUCCESS")]])
    got = {r.suite: (str(r.started), r.ended and str(r.ended), r.status) for r in _run(spark, pending_with_completion(stream), "paired", "append").collect()}
    assert got[1] == ("2024-01-01 10:00:00", "2024-01-01 10:05:00", "SUCCESS") and got[3][2] == "FAILURE"
    assert got[2] == ("2024-01-01 10:00:00", None, "PENDING")


def test_names_of_a_suite_are_paired_in_one_call():
    import numpy as np
    import pandas as pd

    from tidewake.streaming.notifications import _pair

    class State:
        exists, get, removed = True, (["a", "b"], np.array([1_000_000, 2_000_000])), False

        def getCurrentWatermarkMs(self):
            return 86_402_000

        def update(self, value):
            self.get = value

        def setTimeoutTimestamp(self, at):
            self.timeout = at

    state = State()
    rows = pd.DataFrame({"suite": 7, "name": ["c", "c", "b"], "ts": pd.to_datetime([90_000, 90_005, 90_000], unit="s"), "status": ["PENDING", "SUCCESS", "PENDING"]})
    (got,) = _pair((7,), iter([rows]), state)
    assert [(r.name, r.started.timestamp(), None if pd.isna(r.ended) else r.ended.timestamp(), r.status) for r in got[["suite", "name", "started", "ended", "status"]].itertuples(index=False)] == [("a", 1, None, "PENDING"), ("c", 90_000, 90_005, "SUCCESS")]
    assert dict(zip(*state.get)) == {"b": 2_000_000} and state.timeout == 86_402_001
