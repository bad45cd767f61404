"""Facts kept as Parquet by state and month, and brought up to date by what changed.

A finished request never changes, so it lies in the month it was finished; merged
ones lie in the month of the merge, open ones together. A refresh compares stamps
of the inputs with the stored ones, builds the facts of new and changed keys alone,
and rewrites the partitions that these leave or enter: the open ones and a few
recent months, whatever the size of the store.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .store import checkpointed

KEY = "node_id"
PLACE = ["state", "period"]
_PENDING = "_pending"


def placed_facts(facts: DataFrame) -> DataFrame:
    """Facts with ``state`` (done, merged, open) and ``period`` (month of the end, of the merge, or ``now``)."""
    state = F.when(F.col("done"), "done").when(F.col("merged").isNotNull(), "merged").otherwise("open")
    at = F.when(F.col("done"), F.coalesce("released", "closed")).otherwise(F.col("merged"))
    return facts.withColumn("state", state).withColumn("period", F.coalesce(F.date_format(F.timestamp_seconds(at), "yyyy_MM"), F.lit("now")))


def create_store(facts: DataFrame, path: str) -> None:
    """Write a new store. facts: ``node_id``, ``stamp``, ``done``, ``merged``, ``released``, ``closed`` and more; rows of a partition are dealt over tasks by key."""
    _dealt(placed_facts(facts)).write.partitionBy(*PLACE).parquet(path)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*PLACE, F.pmod(F.xxhash64(KEY), F.lit(8)))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored facts, after finishing a rewrite that was broken off."""
    _finish(spark, path)
    return spark.read.option("mergeSchema", "false").parquet(path).withColumn("period", F.col("period").cast("string"))


def change_set(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(node_id, change): ``new``, ``changed`` (another stamp) or ``gone``. Both sides: (node_id, stamp)."""
    both = stored.select(KEY, F.col("stamp").alias("was"), F.lit(True).alias("there")).join(current.select(KEY, "stamp", F.lit(True).alias("here")), KEY, "full")
    change = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "gone").when(~F.col("was").eqNullSafe(F.col("stamp")), "changed")
    return both.select(KEY, change.alias("change")).where("change is not null")


def refresh(spark: SparkSession, path: str, current: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bring the store up to date and give the change set (node_id, change). ``build`` makes the facts, with stamps, of a table of keys.

    The result equals a store built anew. Keys are compared by their stamps, which
    two columns of the store hold; facts are read in the touched partitions alone.
    """
    stored = read_store(spark, path)
    changes = checkpointed(change_set(stored, current))
    if changes.isEmpty():
        return changes
    fresh = checkpointed(placed_facts(build(changes.where("change <> 'gone'").select(KEY))))
    left = stored.select(KEY, *PLACE).join(changes.select(KEY), KEY, "left_semi").select(*PLACE)
    touched = checkpointed(left.unionByName(fresh.select(*PLACE)).distinct())
    kept = stored.join(F.broadcast(touched), PLACE, "left_semi").join(changes.select(KEY), KEY, "left_anti")
    _rewrite(spark, path, touched, kept.unionByName(fresh.select(*kept.columns)))
    return changes


def refresh_column(spark: SparkSession, path: str, name: str, values: DataFrame) -> DataFrame:
    """Put new values (node_id, value) of a column into the stored facts, rewriting the partitions where one differs; gives the keys that changed."""
    stored = read_store(spark, path)
    own = stored.select(KEY, *PLACE, F.col(name).alias("was")).join(values.select(KEY, "value"), KEY).where(~F.col("was").eqNullSafe(F.col("value")))
    changes = checkpointed(own.select(KEY, "value", *PLACE))
    if not changes.isEmpty():
        touched = checkpointed(changes.select(*PLACE).distinct())
        told = changes.select(KEY, F.struct("value").alias("told"))
        rows = stored.join(F.broadcast(touched), PLACE, "left_semi").join(told, KEY, "left")
        value = F.when(F.col("told").isNotNull(), F.col("told.value")).otherwise(F.col(name))
        _rewrite(spark, path, touched, rows.withColumn(name, value).select(*stored.columns))
    return changes.select(KEY)


def _rewrite(spark: SparkSession, path: str, touched: DataFrame, rows: DataFrame) -> None:
    """Make ``rows`` all that the ``touched`` partitions hold. Partitions are a few hundred months, so their list is small.

    The new content is staged whole, in the store's own layout, and noted beside the
    store before a partition is replaced by its staged folder, so a rewrite that is
    broken off is done again by the next reader, and no row is written twice.
    """
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    _dealt(rows).write.partitionBy(*PLACE).parquet(staged)
    fs, at = _files(spark, path)
    noted = [(r.state, r.period, staged, fs.exists(at(f"{staged}/{_place(r)}"))) for r in touched.collect()]
    spark.createDataFrame(noted, "state string, period string, staged string, full boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/{_PENDING}")
    _finish(spark, path)


def _files(spark: SparkSession, path: str) -> tuple:
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _place(r: Row) -> str:
    return f"state={r.state}/period={r.period}"


def _finish(spark: SparkSession, path: str) -> None:
    """Carry out the rewrite that is noted beside the store, if there is one; doing it twice does no harm, as a full place whose staged folder is gone was moved already."""
    fs, at = _files(spark, path)
    if not fs.exists(at(f"{path}/{_PENDING}/_SUCCESS")):
        return
    noted = spark.read.parquet(f"{path}/{_PENDING}").collect()
    for r in noted:
        new, old = at(f"{r.staged}/{_place(r)}"), at(f"{path}/{_place(r)}")
        if not r.full or fs.exists(new):
            fs.delete(old, True)
        if fs.exists(new):
            fs.mkdirs(old.getParent())
            if not fs.rename(new, old):
                raise OSError(f"{new} can't be renamed to {old}")
    fs.delete(at(f"{path}/{_PENDING}"), True)
    for staged in {r.staged for r in noted}:
        fs.delete(at(staged), True)
