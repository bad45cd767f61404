"""Reruns, runs of several requests, rewritten merges, and the store of facts."""

import shutil

import pytest
from pyspark.sql import functions as F

from tidewake.operators.rebased import best_revived, revived
from tidewake.operators.reruns import disambiguated, split_reruns
from tidewake.sources import fact_store

HOUR = 3600
RUN = "event_id long, suite long, name string, started long, conclusion string, suite_conclusion string"


def split(spark, rows):
    return {r.event_id: (r.epoch, r.part, r.conclusion) for r in split_reruns(spark.createDataFrame(rows, RUN)).collect()}



def _plain(names):
    epoch, seen, out = 0, set(), []
    for n in reversed(names):
        if n in seen:
            epoch, seen = epoch + 1, set()
        seen.add(n)
        out.append(epoch)
    return out[::-1]


@pytest.mark.parametrize("names", ["a", "aaaa", "abcabab", "abcdcba", "xyzzyx"])
def test_epochs_by_a_plain_loop(spark, names):
    got = split(spark, [(i, 7, n, i, "SUCCESS", "SUCCESS") for i, n in enumerate(names)])
    assert [got[i][0] for i in range(len(names))] == _plain(names)


def test_twelve_hours_split_from_the_parts_own_start_and_conclusions(spark):
    at = [0, 11, 12, 23, 24, 25]
    rows = [(i, 1, f"n{i}", h * HOUR, c, "NEUTRAL") for i, (h, c) in enumerate(zip(at, ["SUCCESS", "TIMED_OUT", "CANCELLED", "FAILURE", "SUCCESS", "SUCCESS"], strict=True))]
    rows += [(10, 2, "a", 5, "FAILURE", "CANCELLED"), (11, 3, "a", None, "FAILURE", None)]
    got = split(spark, rows)
    assert [got[i] for i in range(6)] == [(0, 0, "TIMED_OUT"), (0, 0, "TIMED_OUT"), (0, 1, "FAILURE"), (0, 1, "FAILURE"), (0, 2, "NEUTRAL"), (0, 2, "NEUTRAL")]
    assert got[10] == (0, 0, "CANCELLED") and got[11] == (0, 0, None)
    assert split_reruns(spark.createDataFrame([], RUN)).count() == 0


def test_runs_find_their_request(spark):
    runs = spark.createDataFrame([(1, 10, 100, 5, 1), (1, 10, 100, 5, 2), (2, 11, 500, 5, 1), (3, 12, 100, 5, 1), (3, 12, 100, 5, 3), (4, 13, 100, 9, 1), (4, 13, 100, 9, 2), (5, 14, 100, 5, None), (6, 15, 100, 9, 1), (7, 16, 100, 5, 2), (7, 16, 100, 5, 4)], "run long, suite long, started long, author long, pr long")
    requests = spark.createDataFrame([(1, 5, 50, 400 - HOUR, 9), (2, 5, 60, None, 3), (3, 5, 200, None, 1), (4, 5, 60, None, None)], "pr long, author long, created long, closed long, commits long")
    got = {r.run: r.pr for r in disambiguated(runs, requests).collect()}
    # the fewest commits; over; one outside its life; other authors; no request; alone, any author will do; unknown counts come last
    assert got == {1: 2, 2: None, 3: 1, 4: None, 5: None, 6: 1, 7: 2}


def test_rewritten_merges(spark):
    commits = spark.createDataFrame([(1, 1, 100, "Mend (#7)\nbody"), (2, 1, 95, "Mend (#7)"), (3, 1, 80, "Mend (#7)"), (4, 2, 200, "Mend (#7)"), (5, 1, 300, "Merge pull request #8 from x/y\n"), (6, 1, 300, "ABC-12 do"), (7, 1, 300, "plain"), (8, 1, 400, None)], "sha long, repo long, committed long, message string")
    requests = spark.createDataFrame([(70, 7, 1, 100, 1, "Mend (#7)"), (80, 8, 1, 100, 9, "plain"), (90, 9, 1, 100, None, "ABC-12 do\nmore"), (91, 91, 1, 100, 9, "ABC-12 do"), (95, 5, 1, 100, 9, None)], "pr long, number long, repo long, merged long, merge_sha long, message string")
    found = revived(commits, requests)
    assert {(r.pr, r.sha) for r in found.collect()} == {(70, 2), (80, 5), (90, 6), (91, 6)}
    assert {(r.pr, r.sha) for r in best_revived(found).collect()} == {(70, 2), (80, 5), (90, 6)}


FACT = "node_id long, stamp long, done boolean, merged long, released long, closed long, label string"
DAY = 86400


def facts(spark, n, moved=0):
    """Requests done in many months, merged, and open; the first ``moved`` open ones were merged meanwhile."""
    kind = F.when(F.col("id") % 10 < 8, "done").when(F.col("id") % 10 == 8, "merged").otherwise(F.when(F.col("id") < moved, "merged").otherwise("open"))
    rows = spark.range(n).select(F.col("id").alias("node_id"), kind.alias("k"), (F.col("id") * DAY).alias("at"))
    done, merged = F.col("k") == "done", F.col("k") != "open"
    return rows.select("node_id", F.xxhash64("node_id", "k").alias("stamp"), done.alias("done"), F.when(merged, F.col("at")).alias("merged"), F.when(done, F.col("at")).alias("released"), F.when(merged, F.col("at")).alias("closed"), F.concat(F.lit("l"), F.col("node_id") % 3).alias("label"))


def content(df):
    return sorted(map(repr, df.select("node_id", "stamp", "done", "merged", "released", "closed", "label", "state", "period").collect()))


def test_a_refreshed_store_equals_a_new_one(spark, tmp_path):
    path, seen = f"{tmp_path}/facts", []
    fact_store.create_store(facts(spark, 400), path)
    assert content(fact_store.read_store(spark, path)) == content(fact_store.placed_facts(facts(spark, 400)))
    files = {f for f in spark.read.parquet(path).inputFiles() if "state=done" in f}
    now = facts(spark, 420, moved=100).where("node_id <> 409 and node_id % 50 <> 19")

    def build(keys):
        seen.extend(r.node_id for r in keys.collect())
        return now.join(keys, "node_id", "left_semi")

    changes = fact_store.refresh(spark, path, now, build)
    kinds = {r.change: r.n for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"new": 18, "changed": 8, "gone": 8} and len(seen) == 26
    assert content(fact_store.read_store(spark, path)) == content(fact_store.placed_facts(now))
    assert len(files & set(spark.read.parquet(path).inputFiles())) > 8  # months without a change keep their files
    assert fact_store.refresh(spark, path, now, build).count() == 0 and len(seen) == 26


def test_a_broken_rewrite_is_finished_by_the_next_reader(spark, tmp_path, monkeypatch):
    path, now = f"{tmp_path}/facts", facts(spark, 60, moved=60)
    fact_store.create_store(facts(spark, 60), path)
    monkeypatch.setattr(fact_store, "_finish", lambda *_: None)
    fact_store.refresh(spark, path, now, lambda keys: now.join(keys, "node_id", "left_semi"))
    monkeypatch.undo()
    assert content(fact_store.read_store(spark, path)) == content(fact_store.placed_facts(now))
    assert not any("state=open" in f for f in spark.read.parquet(path).inputFiles())


def test_new_labels_go_into_stored_facts(spark, tmp_path):
    path = f"{tmp_path}/facts"
    fact_store.create_store(facts(spark, 100), path)
    before = set(spark.read.parquet(path).inputFiles())
    values = spark.createDataFrame([(3, "x"), (4, None), (5, "l2"), (1000, "y")], "node_id long, value string")
    assert sorted(r.node_id for r in fact_store.refresh_column(spark, path, "label", values).collect()) == [3, 4]
    got = {r.node_id: r.label for r in fact_store.read_store(spark, path).collect()}
    assert got == {i: {3: "x", 4: None}.get(i, f"l{i % 3}") for i in range(100)}
    assert before & set(spark.read.parquet(path).inputFiles())


def test_a_rewrite_broken_off_between_two_places_loses_none(spark, tmp_path, monkeypatch):
    path, now = str(tmp_path / "store"), facts(spark, 60).withColumn("stamp", F.col("stamp") + 1)
    fact_store.create_store(facts(spark, 60), path)
    finish = fact_store._finish
    monkeypatch.setattr(fact_store, "_finish", lambda *_: None)
    fact_store.refresh(spark, path, now, lambda keys: now.join(keys, "node_id", "left_semi"))
    monkeypatch.undo()
    first = spark.read.parquet(f"{path}/_pending").collect()[0]
    assert first.full
    place = f"state={first.state}/period={first.period}"
    shutil.rmtree(f"{path}/{place}")
    shutil.move(f"{first.staged}/{place}", f"{path}/{place}")
    finish(spark, path)
    assert content(fact_store.read_store(spark, path)) == content(fact_store.placed_facts(now))
    assert not list(tmp_path.glob("store/_staged*"))


def test_facts_are_not_shuffled_to_meet_their_repository(spark):
    from tidewake.plans.facts import pull_requests

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pull_requests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("HashAggregate") < plan.index("Exchange")  # nothing is dealt anew above the grouping
