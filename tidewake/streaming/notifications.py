"""Streams: notifications ingested once, counted by day and resolved late; late deployments; pending checks paired with their ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

#: Seconds after which a pending check is given up.
GIVE_UP = 86400
#: A time that is null.
_NEVER = np.iinfo(np.int64).min
PAIRS = "suite long, name string, started timestamp, ended timestamp, status string"


def ingest_once(stream: DataFrame, late: str | None = None) -> DataFrame:
    """Each (repo, name) once; a notification without a name gets one from its content.

    Keys are known for good, in a state that grows with the notifications (kept on
    disk by the RocksDB provider where the session names it). With ``late`` a key is
    forgotten that long after its event time ``ts``.
    """
    content = F.sha2(F.concat_ws("|", F.col("repo").cast("string"), F.col("kind"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), 256)
    named = stream.withColumn("name", F.coalesce("name", F.substring(content, 1, 12)))
    return named.dropDuplicates(["repo", "name"]) if late is None else named.withWatermark("ts", late).dropDuplicatesWithinWatermark(["repo", "name"])


def day_counters(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, kind, n): running counts by day; a day is final once the watermark has passed it."""
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("n"))
    return days.select(F.col("w.start").alias("day"), "kind", "n")


def resolve_references(notifications: DataFrame, commits: DataFrame, wait: str = "1 day", keep: list[str] | None = None, give: list[str] | None = None) -> DataFrame:
    """Notifications (repo, short, ts) with the commit (repo, sha, seen) that their short hash names, waited for ``wait`` on either side of ``ts``; a null sha once the watermarks say that none will come.

    keep, give: more columns of the notifications and of the commits to hand on.
    """
    asked = notifications.withWatermark("ts", wait)
    known = commits.select(F.col("repo").alias("of"), "sha", F.substring("sha", 1, 7).alias("head"), "seen", *(give or [])).withWatermark("seen", wait)
    near = (F.col("seen") >= F.col("ts") - F.expr(f"INTERVAL {wait}")) & (F.col("seen") <= F.col("ts") + F.expr(f"INTERVAL {wait}"))
    return asked.join(known, (F.col("repo") == F.col("of")) & (F.col("short") == F.col("head")) & near, "left_outer").select("repo", "short", "ts", "sha", *(keep or []), *(give or []))


def keep_deployments(stream: DataFrame, path: str) -> DataStreamWriter:
    """Append each batch of deployments (env, id, finished) to a folder of its own number, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write)


def repaired_deployments(spark: SparkSession, path: str) -> DataFrame:
    """The kept deployments, with ``stale`` for those that a later batch brought an earlier deployment of their environment for, so that what was derived from them must be made anew.

    Nothing stored is rewritten: the earliest time that each environment got in
    a batch is one row, and a running minimum over later batches tells.
    """
    rows = spark.read.option("basePath", path).parquet(path)
    later = Window.partitionBy("env").orderBy(F.desc("batch")).rowsBetween(Window.unboundedPreceding, -1)
    came = rows.groupBy("env", "batch").agg(F.min("finished").alias("least")).withColumn("since", F.min("least").over(later)).select("env", "batch", "since")
    return rows.join(came, ["env", "batch"]).select("env", "id", "finished", F.coalesce(F.col("finished") > F.col("since"), F.lit(False)).alias("stale"))


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (suite,) = key
    begun = dict(zip(*state.get, strict=True)) if state.exists else {}
    was = dict(begun)
    rows = [r for b in batches for r in zip(b["ts"].astype("datetime64[us]").astype("int64").tolist(), b["status"].tolist(), b["name"].tolist(), strict=True)]
    came = {name for _, _, name in rows}
    out: list[tuple] = []
    for name, at in was.items():
        if name not in came and at // 1000 + GIVE_UP * 1000 <= state.getCurrentWatermarkMs():
            out.append((name, begun.pop(name), _NEVER, "PENDING"))
    for ts, status, name in sorted(rows, key=lambda r: r[:2]):
        if status == "PENDING":
            begun.setdefault(name, ts)
        else:
            first = begun.pop(name, None)
            late = first is not None and ts - first > GIVE_UP * 1_000_000
            out.append((name, ts if first is None else first, _NEVER if late else ts, status))
    if begun:
        if begun != was:
            state.update((list(begun), list(begun.values())))
        state.setTimeoutTimestamp(max(min(begun.values()) // 1000 + GIVE_UP * 1000, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    if out:
        names, started, ended, status = zip(*out, strict=True)
        times = [np.array(c, np.int64).view("datetime64[us]").astype("datetime64[ns]") for c in (started, ended)]
        yield pd.DataFrame({"suite": suite, "name": names, "started": times[0], "ended": times[1], "status": status})


def pending_with_completion(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Pending statuses (suite, name, ts, status) joined to what ends them: one row from the pending one's time to the end's; no end beyond 24 hours, and a pending row alone when none came by then.

    State holds one time for each name of a suite that is pending; a suite's names are handed to Python at once.
    """
    keyed = stream.withWatermark("ts", late).groupBy("suite")
    return keyed.applyInPandasWithState(_pair, PAIRS, "names array<string>, begun array<long>", "append", "EventTimeTimeout")
