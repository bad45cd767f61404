"""Queries over stored facts: built once, brought up to date by what changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..plans.facts import pull_requests, request_stamps
from ..sources import fact_store
from ..sources.store import shared_folder

#: The day up to which the store of the queries knows its tables before it is refreshed.
KNOWN = "1996-07-01"


def stored_requests(spark: SparkSession, sf_dir: str, path: str, until: str | None = None) -> DataFrame:
    """Bring the store of request facts at ``path`` up to what is known before ``until`` (none: all); a missing store is made. Gives the change set."""
    stamps = request_stamps(spark, sf_dir, until)
    build = lambda keys: pull_requests(spark, sf_dir, until, keys).join(stamps, "node_id")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        fact_store.create_store(build(None), path)
        return stamps.select("node_id", F.lit("new").alias("change"))
    return fact_store.refresh(spark, path, stamps, build)


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    path = f"{shared_folder(spark).rstrip('/')}/requests-{uuid.uuid4().hex}"
    stored_requests(spark, sf_dir, path, KNOWN)
    return path, stored_requests(spark, sf_dir, path)


@query("prs", "SELECT node_id, CASE WHEN done THEN 'done' WHEN merged IS NOT NULL THEN 'merged' ELSE 'open' END AS state, created, closed, merged, released, n_commits, n_reviews, participants, size FROM prs")
def f18_incremental_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request facts out of a store that knew the tables up to a day and was refreshed once."""
    path, _ = _refreshed(spark, sf_dir)
    return fact_store.read_store(spark, path).select("node_id", "state", "created", "closed", "merged", "released", "n_commits", "n_reviews", "participants", "size")


@query("prs", "SELECT change, count(*) AS requests FROM (SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '1996-07-01' THEN 'new' WHEN count(l_orderkey) > count(CASE WHEN l_shipdate < DATE '1996-07-01' THEN 1 END) THEN 'changed' END AS change FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate) WHERE change IS NOT NULL GROUP BY 1")
def f18_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many requests the refresh found new and changed; facts of these alone were built."""
    return _refreshed(spark, sf_dir)[1].groupBy("change").agg(F.count("*").alias("requests"))


@query("prs", "SELECT CASE WHEN node_id % 7 = 0 THEN lower(label) ELSE label END AS label, state, count(*) AS requests FROM (SELECT *, CASE WHEN done THEN 'done' WHEN merged IS NOT NULL THEN 'merged' ELSE 'open' END AS state FROM prs) GROUP BY ALL")
def f28_refreshed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of stored facts after some requests were relabelled (here those divisible by 7, in lower case); only partitions with a changed one are rewritten."""
    path, _ = _refreshed(spark, sf_dir)
    stored = fact_store.read_store(spark, path)
    fact_store.refresh_column(spark, path, "label", stored.select("node_id", F.when(F.col("node_id") % 7 == 0, F.lower("label")).otherwise(F.col("label")).alias("value")))
    return fact_store.read_store(spark, path).groupBy("label", "state").agg(F.count("*").alias("requests"))
