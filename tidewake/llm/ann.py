"""Approximate nearest neighbours by a permutation index over pivot inverted files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, stored

#: Pivots are taken from this many rows at most (by hash order).
PIVOT_SAMPLE = 4096
BLOCK = 8192


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Spread pivots: each next one is the sample row farthest from those chosen."""
    chosen = [0]
    near = sample @ sample[0]
    for _ in range(min(n, len(sample)) - 1):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def clean(table: DataFrame, vector: str, key: str) -> DataFrame:
    """(vec_id, v): vectors null, zero, or with null or non-finite components go, and rows without id; of rows that repeat an id one stays."""
    v = F.col("v")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = only(table, key, vector).toDF("vec_id", "v").withColumn("v", v.cast("array<double>"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0) & ok).groupBy("vec_id").agg(F.min("v").alias("v"))


def permutations(m: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    scaled = m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.argsort(-(scaled @ pivots.T), axis=1, kind="stable")[:, :prefix]


def posted(perm: np.ndarray, pivots: int) -> np.ndarray:
    """The inverted files, one row a pivot: each vector's place of the pivot, or the length of the prefix where it has none."""
    out = np.full((pivots, len(perm)), perm.shape[1], np.uint8 if perm.shape[1] < 256 else np.int32)
    out[perm.T, np.arange(len(perm))] = np.arange(perm.shape[1])[:, None]
    return out


def gained(places: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How much below the largest footrule distance each vector is from a query whose nearest pivots are ``own``."""
    seen = np.maximum(places[own], np.arange(len(own), dtype=places.dtype)[:, None])
    return 2 * (len(own) ** 2 - seen.sum(axis=0, dtype=np.int32))


def largest(weight: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` largest, ties to the first, in rising order."""
    if n >= len(weight):
        return np.arange(len(weight))
    least = np.partition(weight, len(weight) - n)[len(weight) - n]
    above = weight > least
    above[np.flatnonzero(weight == least)[: n - int(above.sum())]] = True
    return np.flatnonzero(above)


def nearest(table: DataFrame, k: int = 20, query_modulus: int = 20, vector: str = "embedding", key: str = "vec_id", n_pivots: int = 256, prefix: int = 64, rerank: int = 1200, share: float = 0.15) -> DataFrame:
    """(query_id, rank, vec_id, score): ``k`` nearest by inner product of each row whose id ``query_modulus`` divides.

    Vectors are ordered lists of their ``prefix`` nearest pivots. Rows are dealt
    in blocks by a hash of the id; a block posts its rows in one inverted file a
    pivot, sums the footrule distance of each query over the query's postings
    (a pivot outside a prefix counts as ``prefix``), and takes the
    nearest ``share`` of the block, ``rerank`` at least and ties to smaller ids,
    to the exact measure. Permutations tell directions alone, so what a footrule
    distance falls short of the largest is weighed by the row's length. Queries go
    to blocks in chunks; each block keeps ``k`` a query. Vectors of another
    length than the pivots' take no part. Copies tie, and smaller ids come
    first. With no usable vector the result is empty.
    """
    spark = table.sparkSession
    rows = stored(clean(table, vector, key), "vectors")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(PIVOT_SAMPLE).select("v").toPandas()["v"]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = int(sample.map(len).mode()[0])
    dense = np.unique(np.array([x for x in sample if len(x) == width], float), axis=0)
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    pivots = choose_pivots(dense, n_pivots)
    prefix = min(prefix, len(pivots))
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-n // (query_modulus * 4096)))
    rows = rows.where(F.size("v") == width)
    base = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    queries = rows.where(F.pmod("vec_id", F.lit(query_modulus)) == 0).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(q) and len(b):
            b = b.sort_values("vec_id")
            vb, vq, ids = np.array(b["v"].tolist()), np.array(q["v"].tolist()), b["vec_id"].to_numpy()
            places = posted(permutations(vb, pivots, prefix), len(pivots))
            length = np.linalg.norm(vb, axis=1)
            for qid, v, own in zip(q["vec_id"], vq, permutations(vq, pivots, prefix), strict=True):
                gain = gained(places, own)
                mine = np.searchsorted(ids, qid)
                if mine < len(ids) and ids[mine] == qid:
                    gain[mine] = -1
                pick = largest(gain * length, max(rerank, int(np.ceil(share * len(b)))))
                pick = pick[gain[pick] >= 0]
                score = vb[pick] @ v
                best = np.lexsort((ids[pick], -score))[:k]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[pick][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = queries.groupBy("block", "chunk").cogroup(base.groupBy("block", "chunk")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
