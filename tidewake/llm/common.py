"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder

#: Bytes up to which a stored side may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20
#: ASCII lower-casing only, as the word contracts ask.
LOWER = {c: c + 32 for c in range(65, 91)}
#: A word of the contracts: a run without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0d]+")

_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share; see ``shared_folder`` for a session that names none."""
    base = shared_folder(spark)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` to a scratch folder and read it back: lineage is cut, and lost executors cost nothing that is done."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    for key, value in options.items():
        writer = writer.option(key, str(value))
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, unless_read_by: DataFrame | None = None) -> None:
    """Delete the scratch folders made so far, unless ``unless_read_by`` still reads one of them."""
    inputs = unless_read_by.inputFiles() if unless_read_by is not None else []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in list(_made):
        if not any(path.split(":", 1)[-1].lstrip("/") in x for x in inputs):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            _made.remove(path)


def sized(df: DataFrame, row_bytes: str = "48") -> DataFrame:
    """``df`` (a stored table) with a broadcast hint if its rows, of ``row_bytes`` each (an SQL expression), are small enough together; else the join shuffles."""
    total = df.agg(F.sum(F.expr(row_bytes).cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def anti_join(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns as they are, whose doc_id is not in the stored column of ``ids``; rows without doc_id stay."""
    name = f"gone_{uuid.uuid4().hex}"  # no column of docs has it
    return docs.join(sized(ids.toDF(name)), F.col("doc_id") == F.col(name), "left_anti")


def small_batches(spark: SparkSession, rows: int = 512, size: str = "2m") -> None:
    """Bound the Arrow batches in rows and bytes, so that a batch of very long texts still fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that other columns can't clash with names that an operator makes."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """The stored doc_ids that several rows have; none if there are none. Ids alone are read."""
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    return None if again.isEmpty() else stored(again, "repeated-ids")


def unique_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with one row per document, null text as empty.

    Rows without doc_id have no identity and go. Rows that repeat a doc_id are
    one document: the smallest of their texts stays. Texts are shuffled only for
    repeated ids.
    """
    docs = only(docs, "doc_id", "text").where("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    again = repeated_ids(docs)
    if again is None:
        return docs
    again = sized(again)
    merged = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(again, "doc_id", "left_anti").unionByName(merged)


def identified_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((rid, text) of distinct rid, (doc_id, rid) of the rows whose doc_id is null or repeated, or none).

    A row with an id of its own goes by it; of the others each distinct text
    goes once, by its digest. So no row is lost, and texts are shuffled only for
    the others.
    """
    docs = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    again = repeated_ids(docs)
    if again is None and docs.where("doc_id is null").isEmpty():
        return docs.select(F.col("doc_id").cast("string").alias("rid"), "text"), None
    digest = F.concat(F.lit("t"), F.sha2("text", 256)).alias("rid")
    own, odd = docs.where("doc_id is not null"), docs.where("doc_id is null")
    if again is not None:
        odd = odd.unionByName(own.join(sized(again), "doc_id", "left_semi"))
        own = own.join(sized(again), "doc_id", "left_anti")
    texts = odd.select(digest, "text").groupBy("rid").agg(F.min("text").alias("text"))
    return own.select(F.col("doc_id").cast("string").alias("rid"), "text").unionByName(texts), odd.select("doc_id", digest)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a public bijection of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: 64-bit code of each byte for word hashes; A-Z have the codes of a-z.
_BYTE = mix64((np.arange(256) + 1 + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, words of each text) of the lower-cased words of UTF-8 texts; one pass of array operations."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    lengths = np.array([len(x) + 1 for x in raw], np.int64)
    ends = np.cumsum(lengths)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        return np.empty(0, np.uint64), start, np.zeros(len(texts), np.int64)
    inside = np.flatnonzero(word)
    at = np.cumsum(first[inside]) - 1
    offset = inside - start[at]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(offset.max()), _BASE)]), dtype=np.uint64)
        value = _BYTE[data[inside]] * power[offset]
        hashes = mix64(np.add.reduceat(value, np.flatnonzero(first[inside])))
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    begin = np.concatenate([[0], ends[:-1]])
    return hashes, start - np.repeat(begin, counts), counts


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, runs of each text); a text with fewer words, but any, is one run."""
    if not len(hashes):
        return hashes, counts * 0
    ends = np.cumsum(counts)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    doc = np.repeat(np.arange(len(counts)), counts)
    left = ends[doc] - np.arange(len(hashes))  # words from here to the end of the text
    total = np.zeros(len(hashes), np.uint64)
    factor = mix64(np.arange(1, k + 1).astype(np.uint64) << np.uint64(20)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += np.where(left > j, padded[j : j + len(hashes)], np.uint64(j)) * factor[j]
    first = np.zeros(len(hashes), bool)
    first[(ends - counts)[counts > 0]] = True
    keep = (left >= k) | (first & (left < k))
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return mix64(total[keep]), runs
