"""Tables kept in the shared folder: cut lineage, and results that hold as long as their input files do."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Spark's factor from bytes of files to bytes of rows, when it judges what may be broadcast.
FACTOR = "spark.sql.sources.fileCompressionFactor"
#: Bytes of a value in a row: of these kinds, and of others.
WIDTHS, WIDE = dict.fromkeys(("boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp", "timestamp_ntz"), 8), 20

#: Folders of the states written so far, by their tables.
_written: dict[int, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without one gets a temporary folder; a cluster must name
    its own, as executors would not see each other's.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewake-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def _write(df: DataFrame, path: str, compression: str) -> None:
    """Write ``df`` to ``path``. Where its rows are too large to be broadcast, Spark is told how much larger than the files they are: chains and positions shrink to a small part in files, and a table broadcast for their size fills the driver."""
    spark, told = df.sparkSession, Observation()
    df.observe(told, F.count(F.lit(1)).alias("rows")).write.option("compression", compression).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    size = told.get["rows"] * (8 + sum(WIDTHS.get(f.dataType.typeName(), WIDE) for f in df.schema))
    if size > spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() and size > files * float(spark.conf.get(FACTOR)):
        spark.conf.set(FACTOR, str(size / max(1, files)))


def checkpointed(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: lineage is cut, and a lost executor costs nothing that is done.

    Read back, its size is known (``_write``), so that small states join without a shuffle, and large ones are not broadcast.
    The files of ``done``, states that this one replaces, go.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/state-{uuid.uuid4().hex}"
    _write(df, path, "lz4")
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    for old in done:
        if path_of := _written.pop(id(old), None):
            at(path_of).getFileSystem(spark._jsc.hadoopConfiguration()).delete(at(path_of), True)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = path
    return out


def _state(spark: SparkSession, path: str) -> str:
    """What the files under ``path`` are now: names, sizes and times, from one listing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return "|".join(sorted(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(at)))


def remembered(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes of the files ``inputs``, stored once and read again until one of them changes.

    It is written beside its place and renamed, so a broken write is never read.
    """
    state = hashlib.sha256("\n".join([name, *(_state(spark, p) for p in inputs)]).encode()).hexdigest()[:24]
    path = f"{shared_folder(spark).rstrip('/')}/store/{name}-{state}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path(path)):
        part = f"{path}-{uuid.uuid4().hex[:8]}"
        _write(build(), part, "snappy")
        if not fs.rename(fs_path(part), fs_path(path)) and not fs.exists(fs_path(path)):
            raise OSError(f"{part} can't be renamed to {path}")
    return spark.read.parquet(path)
