"""Token ids in Parquet: list columns with dictionary pages, delta-encoded keys, bounded row groups and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, scratch, small_batches

FILE_SCHEMA = "doc_id long, shard int, shard_start long, n_tokens int, token_ids array<int>"


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, row_group_bytes: int = 16 << 20) -> None:
    """Encode whole texts (null: empty) and write them in ascending doc_id order.

    Files are range-partitioned by doc_id and sorted, so that row-group
    statistics and page indexes prune by id. ``token_ids`` is dictionary-coded;
    keys and counts have no dictionary and get the delta encoding of format v2.
    Null doc_id sorts first; repeated rows are written as often as they occur.
    ``shard_start`` counts the ids before a document within its file.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .encoders import encoder

        shard, start, coder, end = TaskContext.get().partitionId(), 0, encoder(vocabulary, "space-led"), np.uint32(end_id).tobytes()
        for batch in batches:
            ids = coder.encode([x or "" for x in batch.column(1).to_pylist()])
            n = np.array([len(x) // 4 + 1 for x in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)])
            values = np.frombuffer(end.join([*ids, b""]), np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), shard, np.int32)), pa.array(start + offsets[:-1]), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))],
                names=["doc_id", "shard", "shard_start", "n_tokens", "token_ids"],
            )
            start += int(offsets[-1])

    ordered = only(docs, "doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    writer = ordered.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    for name in ("doc_id", "shard", "shard_start", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(128 << 10)).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """All rows; selecting columns or filtering doc_id reads those pages only."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def document_starts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, shard_start, start): ids before each document over all files; reads metadata columns, no ids."""
    meta = read_token_files(spark, path).select("doc_id", "shard", "shard_start", "n_tokens")
    totals = meta.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    return meta.join(before, "shard").select("doc_id", "shard", "shard_start", (F.col("base") + F.col("shard_start")).alias("start"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        at = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])


def token_file_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write token files, read them back: doc_id, start, n_tokens, ids_crc32. An empty table gives no rows."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_token_files(docs, vocabulary, path)
    files = read_token_files(spark, path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    read = files.mapInArrow(_crc, "doc_id long, shard int, shard_start long, n_tokens int, ids_crc32 long")
    return read.join(F.broadcast(before), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
