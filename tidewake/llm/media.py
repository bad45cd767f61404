"""Media columns: payloads in content-defined chunks, each stored once."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identified_rows, mix64, sized, small_batches, stored

FRAME = 192
#: Least, usual and largest chunk bytes.
LEAST, USUAL, LARGEST = 512, 2048, 16384
_GEAR = (mix64(np.arange(1, 257).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
ROWS = "rid string, n_bytes long, payload binary, chunks array<struct<digest:binary,length:int>>"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with blanks up to a positive multiple of FRAME, and the bytes before them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b" "), len(raw)


def cut_points(payloads: list[bytes]) -> list[list[int]]:
    """Chunk ends of each payload, by a gear hash that rolls over 32 bytes.

    The window never spans payloads where it matters: no chunk is shorter than
    LEAST bytes, which is more than the window.
    """
    data = np.frombuffer(b"".join(payloads), np.uint8)
    h = _GEAR[data]
    with np.errstate(over="ignore"):
        for k in (1, 2, 4, 8, 16):  # sums of h[i - j] << j over ever longer runs
            more = h.copy()
            more[k:] += h[:-k] << np.uint32(k)
            h = more
    hits = np.flatnonzero((h >> np.uint32(32 - USUAL.bit_length() + 1)) == 0) + 1
    out, begin = [], 0
    for p in payloads:
        end, last, ends = begin + len(p), begin, []
        for c in hits[np.searchsorted(hits, begin + LEAST) : np.searchsorted(hits, end)].tolist():
            while c - last > LARGEST:
                last += LARGEST
                ends.append(last - begin)
            if c - last >= LEAST:
                last = c
                ends.append(c - begin)
        while end - last > LARGEST:
            last += LARGEST
            ends.append(last - begin)
        if end > last:
            ends.append(end - begin)
        out.append(ends)
        begin = end
    return out


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, int, bytes, list[bytes]]]:
    made = [payload_of(x) for x in batch.column(1).to_pylist()]
    for rid, (p, n), ends in zip(batch.column(0).to_pylist(), made, cut_points([p for p, _ in made]), strict=True):
        yield rid, n, p, [p[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's payload digest, and its chunks' digests and lengths."""
    kind = pa.schema([("rid", pa.string()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("chunks", pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32())])))])
    for b in batches:
        rows = [{"rid": d, "n_bytes": n, "payload": hashlib.sha256(p).digest(), "chunks": [{"digest": hashlib.sha256(x).digest(), "length": len(x)} for x in parts]} for d, n, p, parts in _chunks(b)]
        yield pa.RecordBatch.from_pylist(rows, kind)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each payload's recipe, and the bytes of the chunks that it owns."""
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for (rid, n, p, parts), foreign in zip(_chunks(b), b.column(2).to_pylist(), strict=True):
            away = set(foreign or ())
            recipe = b"".join(hashlib.sha256(x).digest() + len(x).to_bytes(4, "little") for x in parts)
            for c, v in zip(out, (rid, n, recipe, sorted(away), b"".join([x for i, x in enumerate(parts) if i not in away])), strict=True):
                c.append(v)
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["rid", "n_bytes", "recipe", "away", "data"])


def _read(recipe: bytes, away: list[int], data: bytes, fetched: dict[int, bytes] | None) -> list[bytes]:
    """The chunks in order (with no ``fetched``, the own ones), each verified against its digest."""
    gone, at, parts = set(away), 0, []
    for i in range(len(recipe) // 36):
        digest, n = recipe[36 * i : 36 * i + 32], int.from_bytes(recipe[36 * i + 32 : 36 * i + 36], "little")
        if i in gone:
            x = fetched[i] if fetched is not None else None
        else:
            x, at = data[at : at + n], at + n
        if x is not None and hashlib.sha256(x).digest() != digest:
            raise ValueError("a chunk doesn't match its digest")
        parts.append(x)
    return parts


def feature_of(payload: bytes) -> str:
    """Mean, root mean square and mean step of the samples, and the share of frames that are blank."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    blank = (x.reshape(-1, FRAME) == 32).all(1).mean()
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};step={np.abs(np.diff(x)).mean():.4f};blank={blank:.4f}"


REPORT = "rid string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for rid, n, recipe, away, data, fetched in zip(*[c.to_pylist() for c in b.columns], strict=True):
            payload = b"".join(_read(recipe, away, data, {f["seq"]: f["data"] for f in fetched or ()}))
            rows.append((rid, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(recipe) + len(payload), hashlib.sha256(recipe + payload).hexdigest(), feature_of(payload), len(recipe) // 36))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in REPORT.split(", ")])


def store_media(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(store, foreign, copies) of (rid, text) with distinct rid: each distinct chunk is kept once, by the first payload and place that has it.

    store: rid, n_bytes, recipe (digest and length of each chunk in order), away
    (places of chunks kept elsewhere), data (own chunks in a row) of each
    distinct payload, under its least rid. copies: rid, n_bytes, rep, of rows
    whose payload is stored under ``rep``. foreign: rid, seq, digest, owner.
    Digests are joined; payloads are shuffled only where what rows learn from
    that join is more than a broadcast.
    """
    recipes = stored(rows.mapInArrow(_recipes, ROWS), "recipes")
    several = stored(recipes.groupBy("payload").agg(F.min("rid").alias("rep"), F.count("*").alias("n")).where("n > 1").select("payload", "rep"), "copied")
    copies = stored(recipes.select("rid", "n_bytes", "payload").join(sized(several, "64"), "payload").where("rid <> rep").select("rid", "n_bytes", "rep"), "copies")
    distinct = recipes.join(sized(copies.select("rid")), "rid", "left_anti")
    refs = distinct.select("rid", F.posexplode("chunks").alias("seq", "chunk")).select("rid", "seq", F.col("chunk.digest").alias("digest"))
    shared = refs.groupBy("digest").agg(F.min(F.struct("rid", "seq")).alias("first"), F.count("*").alias("uses")).where("uses > 1").select("digest", F.col("first.rid").alias("owner"), F.col("first.seq").alias("owner_seq"))
    foreign = stored(refs.join(shared, "digest").where("rid <> owner or seq <> owner_seq").select("rid", "seq", "digest", "owner"), "foreign")
    away = foreign.groupBy("rid").agg(F.sort_array(F.collect_list("seq")).alias("away"))
    plan = stored(away.select("rid", "away", F.lit(False).alias("copy")).unionByName(copies.select("rid", F.lit(None).cast("array<int>").alias("away"), F.lit(True).alias("copy"))), "plan")
    own = rows.join(sized(plan, "48 + 4 * coalesce(size(away), 0)"), "rid", "left").where("copy is null or not copy").select("rid", "text", "away")
    return stored(own.mapInArrow(_store, "rid string, n_bytes long, recipe binary, away array<int>, data binary"), "chunk-store"), foreign, copies


def media_report(docs: DataFrame) -> DataFrame:
    """Store the payloads of all documents, read them back verified, and compute features; one row for each input row.

    The stored form of a payload is its recipe followed by its chunks, whoever
    keeps them. Null ids and repeated ids are rows like others; equal texts have
    equal values; a null or empty text is one blank frame; a text of any length
    is one payload; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, odd = identified_rows(docs)
    store, foreign, copies = store_media(rows)
    owners = stored(foreign.select(F.col("owner").alias("rid")).distinct(), "owners")
    wanted = stored(foreign.select("digest").distinct(), "wanted")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(r[36 * i : 36 * i + 32], x) for r, a, d in zip(*[c.to_pylist() for c in b.columns], strict=True) for i, x in enumerate(_read(r, a, d, None)) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["digest", "data"])

    held = store.join(sized(owners), "rid", "left_semi").select("recipe", "away", "data").mapInArrow(own, "digest binary, data binary").join(sized(wanted, "64"), "digest", "left_semi")
    fetched = foreign.join(held, "digest").groupBy("rid").agg(F.collect_list(F.struct("seq", "data")).alias("fetched"))
    whole = store.where("size(away) = 0").withColumn("fetched", F.lit(None).cast("array<struct<seq:int,data:binary>>"))
    parts = store.where("size(away) > 0").join(fetched, "rid")
    names = ["rid", "n_bytes", "recipe", "away", "data", "fetched"]
    report = stored(whole.select(*names).unionByName(parts.select(*names)).mapInArrow(_report, REPORT), "report")
    again = copies.join(report.drop("n_bytes").withColumnRenamed("rid", "rep"), "rep").select(*report.columns)
    report = report.unionByName(again)
    out = [c for c in report.columns if c != "rid"]
    found = report.where("rid not like 't%'").select(F.col("rid").cast("long").alias("doc_id"), *out)
    return found if odd is None else found.unionByName(odd.join(report, "rid").select("doc_id", *out))
