"""The streams run over the table of events, as far as it is there, into files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..sources.store import shared_folder
from ..streaming.notifications import day_counters, ingest_once, keep_deployments, pending_with_completion, repaired_deployments, resolve_references


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(kind).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as the table may be one file
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _landed(stream: DataFrame, name: str) -> DataFrame:
    """Run ``stream`` to the end of its input into a new shared folder and read it back."""
    spark = stream.sparkSession
    path = _folder(spark, name)
    run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("actions", "SELECT repo, name, count(*) AS kept FROM (SELECT DISTINCT user_id AS repo, event_type || '-' || CAST(started // 3600 AS VARCHAR) AS name FROM ev) GROUP BY ALL")
def s01_ingested_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications named by kind and hour, each name of a repository kept once."""
    name = F.concat_ws("-", "event_type", F.expr("unix_seconds(ts) div 3600").cast("string"))
    stream = _events(spark, sf_dir).select(F.col("user_id").alias("repo"), name.alias("name"), F.col("event_type").alias("kind"), "ts")
    return _landed(ingest_once(stream), "ingested").groupBy("repo", "name").agg(F.count("*").alias("kept"))


@query("actions", "SELECT n.event_id AS notification, c.event_id AS commit FROM ev n JOIN ev c ON c.user_id = n.user_id AND substr(md5(CAST(c.event_id AS VARCHAR)), 1, 7) = substr(md5(CAST(n.event_id - n.event_id % 7 AS VARCHAR)), 1, 7) AND c.started BETWEEN n.started - 864000 AND n.started + 864000 WHERE n.event_type = 'error'")
def s02_late_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications with the commit that their short hash names, whichever of the two comes first, up to ten days apart."""
    digest = lambda c: F.md5(c.cast("string").cast("binary"))
    events = _events(spark, sf_dir)
    asked = events.where("event_type = 'error'").select(F.concat_ws("-", "user_id", "event_id").alias("repo_note"), F.col("user_id").alias("repo"), F.substring(digest(F.expr("event_id - event_id % 7")), 1, 7).alias("short"), F.date_trunc("second", "ts").alias("ts"), "event_id")
    known = _events(spark, sf_dir).select(F.col("user_id").alias("repo"), digest(F.col("event_id")).alias("sha"), F.date_trunc("second", "ts").alias("seen"), F.col("event_id").alias("commit"))
    return _landed(resolve_references(asked, known, "10 days", ["event_id"], ["commit"]), "resolved").where("sha is not null").select(F.col("event_id").alias("notification"), "commit")


@query("deployments", "SELECT event_id AS id, env, finished, finished > min(finished) OVER later AS stale FROM (SELECT *, event_id % 3 AS batch FROM deployments) WINDOW later AS (PARTITION BY env ORDER BY batch RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)".replace("finished > min(finished) OVER later AS stale", "coalesce(finished > min(finished) OVER later, false) AS stale"))
def s03_repaired_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployments that arrive in three batches (by id modulo 3), with those that a later batch's earlier deployment makes stale."""
    from ..catalogue import facts

    rows, path = facts(spark, sf_dir, "deployments").select("env", F.col("event_id").alias("id"), "finished"), _folder(spark, "deployments")
    for k in range(3):  # one file a batch, in the order of arrival
        rows.where(F.col("id") % 3 == k).coalesce(1).write.parquet(f"{path}/landed/batch-{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/landed/batch-*")
    keep_deployments(stream, f"{path}/kept").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return repaired_deployments(spark, f"{path}/kept").select("id", "env", "finished", "stale")


@query("checks", None)
def s04_pending_with_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of a user's checks paired as they come; the statuses of the last day may still be open."""
    k = F.get_json_object("props", "$.k").cast("long")
    stream = _events(spark, sf_dir).select(F.col("user_id").alias("suite"), F.col("event_type").alias("name"), "ts", F.when(k % 10 == 3, "PENDING").when(k % 10 == 0, "FAILURE").otherwise("SUCCESS").alias("status"))
    return _landed(pending_with_completion(stream), "paired")


@query("actions", "SELECT day, kind, count(*) AS n FROM (SELECT started // 86400 AS day, topic AS kind FROM actions) WHERE (day + 2) * 86400 <= (SELECT max(started) FROM actions) GROUP BY ALL")
def s05_day_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the days that are final: over for a day and more."""
    stream = _events(spark, sf_dir).select("ts", F.col("event_type").alias("kind"))
    return _landed(day_counters(stream), "counted").select(F.expr("unix_seconds(day) div 86400").alias("day"), "kind", "n")
