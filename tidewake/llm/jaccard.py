"""Similarity join on word shingles through a count-vector R-tree."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import anti_join, shingle_hashes, sized, small_batches, stored, unique_documents, word_hashes
from .graphs import connected_components

#: Shingle groups: coordinates of a point in the tree, and of the finer point that bounds pairs again.
GROUPS, FINE = 64, 1024
#: Points of an R-tree leaf.
LEAF = 64
#: Points, and shingles, of a slice of a block; a tile joins two slices.
SLICE_POINTS, SLICE_SHINGLES = 4096, 2_000_000
#: Postings with more documents than this are all taken as equally frequent; any common order gives the same links.
MANY = 4096


def _sets(texts: list[str], k: int) -> list[np.ndarray]:
    hashes, _, counts = word_hashes(texts)
    flat, runs = shingle_hashes(hashes, counts, k)
    return [np.unique(x) for x in np.split(flat, np.cumsum(runs)[:-1])] if len(texts) else []


def least_shared(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares, inside the prefixes, with any set that it links with."""
    return np.maximum(1, -((-3 * n // 4) // 4))


def prefix_length(n: np.ndarray) -> np.ndarray:
    """A quarter of a set, which a link may miss, and another quarter, of which it then finds enough."""
    return n // 4 + np.maximum(1, -(-n // 4))


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, df, h) of the shingles in more than one prefix. batches: (h, doc_id, n) in order of h; df stops at MANY + 1."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def out(h: np.ndarray, d: np.ndarray, n: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        keep = df > 1
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (d, n, df.astype(np.int32), h)], names=["doc_id", "n", "df", "h"])

    def open_posting() -> Iterator[pa.RecordBatch]:
        if held:
            h, d, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            yield out(h, d, n, np.full(len(h), min(count, MANY + 1)))

    last = None
    for b in batches:
        h, d, n = (b.column(i).to_numpy() for i in range(3))
        if not len(h):
            continue
        if last is not None and h[0] != last:
            yield from open_posting()
            count = 0
        starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
        if len(starts) > 2:
            sizes = np.diff(starts)
            sizes[0] += count
            df = np.minimum(np.repeat(sizes, np.diff(starts)), MANY + 1)
            count += int(starts[1])
            held.append((h[: starts[1]], d[: starts[1]], n[: starts[1]]))
            yield from open_posting()
            yield out(*(x[starts[1] : starts[-2]] for x in (h, d, n, df)))
            count = 0
        tail = starts[-2]
        held.append((h[tail:], d[tail:], n[tail:]))
        count += len(h) - int(tail)
        last = h[-1]
        if count > MANY:  # its frequency is known, so that a posting of any length is passed on
            yield from open_posting()
    yield from open_posting()


def rare_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n, doc_id) of all but the most frequent shingles of each prefix. batches: (doc_id, n, df, h) in order of doc_id, the frequent first.

    Any linked pair shares ``least_shared`` shingles of its prefixes, so one is left of them when one fewer goes.
    """
    last, seen = None, 0
    for b in batches:
        d, n, _, h = (b.column(i).to_numpy() for i in range(4))
        if not len(d):
            continue
        new = np.concatenate([[d[0] != last], d[1:] != d[:-1]])
        at = np.arange(len(d)) - np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
        if not new[0]:
            at[d == d[0]] += seen
        last, seen = d[-1], int(at[-1]) + 1
        keep = at >= least_shared(n) - 1
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, n, d)], names=["h", "n", "doc_id"])


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of neighbours by size in a posting, where their sizes can link. batches: (h, n, doc_id) in that order."""
    last = None
    for b in batches:
        h, n, d = (b.column(i).to_numpy() for i in range(3))
        if not len(h):
            continue
        if last is not None:
            h, n, d = (np.concatenate([[x], y]) for x, y in zip(last, (h, n, d), strict=True))
        last = h[-1], n[-1], d[-1]
        near = (h[1:] == h[:-1]) & (4 * n[:-1] >= 3 * n[1:])
        pairs = np.unique(np.column_stack([np.minimum(d[1:], d[:-1])[near], np.maximum(d[1:], d[:-1])[near]]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def bounded_pairs(fine: np.ndarray, sizes: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """(a, candidates b) of points whose overlap can reach three sevenths of their sizes' sum, that is a similarity of 0.75.

    A packed R-tree: points sorted by size, then by their fullest groups, in
    leaves with their largest coordinates and smallest size. The summed minima
    of two leaves' coordinates bound the overlap of any of their points; those
    of two points bound theirs, and finer groups of the same hashes bound what
    is left. side: only pairs of side 0 with side 1.
    """
    vectors = fine.reshape(len(fine), GROUPS, FINE // GROUPS).sum(2, dtype=np.int32)
    order = np.lexsort((vectors.argmax(1), sizes))
    v, n = vectors[order], sizes[order].astype(np.int64)
    edges = np.arange(0, len(n), LEAF)
    top = np.maximum.reduceat(v, edges, axis=0)
    low, high = n[edges], n[np.minimum(edges + LEAF, len(n)) - 1]
    s = None if side is None else side[order]
    for a in range(len(edges)):
        near = np.flatnonzero((np.arange(len(edges)) >= a) & (4 * high[a] >= 3 * low))
        near = near[7 * np.minimum(top[near], top[a]).sum(1) >= 3 * (low[a] + low[near])]
        if not len(near):
            continue
        b = (edges[near][:, None] + np.arange(LEAF)).ravel()
        b = b[b < len(n)]
        for i in range(edges[a], min(edges[a] + LEAF, len(n))):
            c = b[np.searchsorted(b, i, "right") :]
            c = c[4 * n[i] >= 3 * n[c]]
            if s is not None:
                c = c[s[c] != s[i]]
            c = c[7 * np.minimum(v[c], v[i]).sum(1) >= 3 * (n[i] + n[c])]
            if len(c):
                c = c[7 * np.minimum(fine[order[c]], fine[order[i]]).sum(1, dtype=np.int64) >= 3 * (n[i] + n[c])]
            if len(c):
                yield int(order[i]), order[c]


class _Joined:
    """Labels of the points that links have joined so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: int, partners: np.ndarray) -> None:
        for u in np.unique(self.label[partners]):
            if u != self.label[a]:
                self.label[self.label == u] = self.label[a]

    def roots(self, ids: np.ndarray) -> np.ndarray:
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, ids)
        return least[self.label]


def _vector_tile(t: pd.DataFrame, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(b"".join(t["data"]), "<u2").reshape(len(t), FINE)
    joined = _Joined(len(t))
    for a, b in bounded_pairs(points, t["n"].to_numpy(), side):
        joined.link(a, b)
    return joined.roots(t["doc_id"].to_numpy()), np.zeros(len(t), np.int64)


def _set_tile(t: pd.DataFrame, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    sizes, copies = t["n"].to_numpy(), t["copies"].to_numpy()
    flat = np.frombuffer(b"".join(t["data"]), "<u8")
    at = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(t)), sizes)
    points = np.bincount(doc * FINE + (flat >> np.uint64(54)).astype(np.int64), minlength=len(t) * FINE).reshape(len(t), FINE).astype(np.uint16)
    _, local = np.unique(flat, return_inverse=True)
    mark = np.zeros(int(local.max()) + 1 if len(local) else 0, np.int32)
    joined, links = _Joined(len(t)), np.zeros(len(t), np.int64)
    for a, b in bounded_pairs(points, sizes, side):
        own = local[at[a] : at[a + 1]]
        mark[own] = 1
        rows = np.concatenate([local[at[x] : at[x + 1]] for x in b])
        shared = np.add.reduceat(mark[rows], np.concatenate([[0], np.cumsum(sizes[b])[:-1]]))
        mark[own] = 0
        b = b[7 * shared >= 3 * (sizes[a] + sizes[b])]
        if len(b):
            links[a] += copies[b].sum()
            links[b] += copies[a]
            joined.link(a, b)
    return joined.roots(t["doc_id"].to_numpy()), links


def tile_join(rows: DataFrame, weight: str, capacity: int, judge: Callable) -> DataFrame:
    """(doc_id, root, links) over tiles of each block. rows: block, doc_id, n, copies, data.

    A block within ``capacity`` is one tile. A larger one is cut into bands of
    sizes, so that sizes that can link are two bands apart at most, and these by
    hash into slices within capacity; each pair of slices that can hold a link
    is a tile of its own, in a task of bounded memory. root: least document that
    links of the tile join a document to.
    """
    totals = stored(rows.groupBy("block").agg((F.sum(F.expr(weight)) > capacity).alias("large")), "totals")
    band = F.when(F.col("large"), F.floor(F.log("n") / float(np.log(4 / 3) / 2))).otherwise(0).cast("int")
    banded = rows.join(sized(totals), "block").withColumn("band", band)
    bands = stored(banded.groupBy("block", "band").agg(F.ceil(F.sum(F.expr(weight)) / capacity).cast("int").alias("subs")), "bands")
    slices = bands.select(F.col("block").alias("b"), F.col("band").alias("band2"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub2"))
    own = banded.join(sized(bands), ["block", "band"]).withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.col("subs")).cast("int"))
    dealt = own.join(sized(stored(slices, "slices")), (F.col("block") == F.col("b")) & (F.abs(F.col("band") - F.col("band2")) <= 2))
    one, two = F.col("band") * 1_000_000 + F.col("sub"), F.col("band2") * 1_000_000 + F.col("sub2")
    tiles = dealt.select("block", F.least(one, two).alias("i"), F.greatest(one, two).alias("j"), one.alias("own"), "doc_id", "n", "copies", "data").repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                t = pd.concat(held, ignore_index=True)
                held.clear()
                if len(t) > 1:
                    side = None if key[1] == key[2] else (t["own"] == key[2]).to_numpy()
                    root, links = judge(t, side)
                    yield pa.RecordBatch.from_arrays([pa.array(t["doc_id"].to_numpy()), pa.array(root), pa.array(links)], names=["doc_id", "root", "links"])

        for batch in batches:
            for k, part in batch.to_pandas().groupby(["block", "i", "j"], sort=False):
                if k != key:
                    yield from done()
                    key = k
                held.append(part)
        yield from done()

    return tiles.mapInArrow(run, "doc_id long, root long, links long")


def jaccard_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of documents linked at a similarity of 0.75 or more.

    Exact on 64-bit shingle hashes. Equal sets are one point, its least
    document. Two sets that link miss a quarter of their shingles at most, so
    the first halves by hash share about a fifth of their shingles or more, and
    the rarest of each half, all but that fifth, share one: documents meet in a
    block through rare shingles, however common their passages are. Within
    blocks, an R-tree over count vectors finds the pairs that can still link;
    joined, they are smaller blocks, in which pairs that the bound leaves are
    verified on whole sets. n_links counts the other documents that a document
    links with, copies too. Null ids go and repeated ids are one document (see
    ``unique_documents``); texts without words link with nothing; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark, size="1m")
    docs = unique_documents(docs)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _sets(b.column(1).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in own], pa.binary())], names=["doc_id", "n", "digest"])

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _sets(b.column(1).to_pylist(), k)
            n = np.array([len(x) for x in own], np.int64)
            p = np.where(n > 0, prefix_length(n), 0)
            flat = np.concatenate([*[x[:y] for x, y in zip(own, p, strict=True)], np.empty(0, np.uint64)]).view(np.int64)
            ids = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(ids, p)), pa.array(np.repeat(n, p))], names=["h", "doc_id", "n"])

    sets = stored(docs.mapInArrow(digests, "doc_id long, n long, digest binary"), "digests")
    classes = stored(sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n")), "classes")
    several = classes.where("copies > 1").select("digest", F.col("doc_id").alias("rep"))
    copies = stored(sets.join(sized(several), "digest").where("doc_id <> rep").select("doc_id", "rep"), "copies")
    classes = classes.select("doc_id", "copies", "n")
    docs = docs.join(sized(copies.select("doc_id")), "doc_id", "left_anti")
    seeds = docs.mapInArrow(halves, "h long, doc_id long, n long")
    small_batches(spark, 65536)
    shared = seeds.repartition("h").sortWithinPartitions("h").mapInArrow(frequencies, "doc_id long, n long, df int, h long")
    rare = shared.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("df"), F.desc("h")).mapInArrow(rare_part, "h long, n long, doc_id long")
    links = rare.repartition("h").sortWithinPartitions("h", "n", "doc_id").mapInArrow(chained, "a long, b long").distinct()
    blocks = stored(connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("block")), "blocks")
    small_batches(spark, size="1m")

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = [np.bincount((x >> np.uint64(54)).astype(np.int64), minlength=FINE).astype("<u2").tobytes() for x in _sets(b.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(groups, pa.binary())], names=["doc_id", "data"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<u8").tobytes() for x in _sets(b.column(1).to_pylist(), k)], pa.binary())], names=["doc_id", "data"])

    chosen = stored(classes.join(sized(blocks), "doc_id"), "chosen")
    vectors = docs.join(sized(chosen.select("doc_id")), "doc_id", "left_semi").mapInArrow(points, "doc_id long, data binary")
    coarse = tile_join(chosen.join(stored(vectors, "points"), "doc_id"), "1", SLICE_POINTS, _vector_tile)
    finer = stored(connected_components(coarse.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("doc_id"), F.col("component").alias("block")), "finer")
    lists = docs.join(sized(finer.select("doc_id")), "doc_id", "left_semi").mapInArrow(whole, "doc_id long, data binary")
    rows = chosen.drop("block").join(sized(finer), "doc_id").join(stored(lists, "sets"), "doc_id")
    linked = stored(tile_join(rows, "n", SLICE_SHINGLES, _set_tile), "linked")
    component = connected_components(linked.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("doc_id").agg(F.sum("links").alias("links"))
    joined = counts.join(component.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    of_class = classes.join(joined, "doc_id", "left").where("copies > 1 or component is not null")
    told = stored(of_class.select(F.col("doc_id").alias("rep"), F.coalesce("component", "doc_id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "told")
    found = sets.select("doc_id", F.col("n").alias("n_shingles")).join(sized(copies), "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(sized(told), "rep", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of each component, with all their columns; rows that repeat an id stay together, rows without id stay."""
    gone = stored(jaccard_components(docs).where("component_id <> doc_id").select("doc_id"), "near-copies")
    return anti_join(docs, gone)
