"""Hierarchical multi-length packing of token sequences."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, small_batches

CONTEXT = 4096
TIERS = (512, 1024, 2048, 4096)
#: Tokens that a task packs at a time.
POOL = 1 << 20
#: Sequences of a step group.
STEP = 8
PIECES = "doc_id long, start long, length long, piece_ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def tier_of(n: int) -> int:
    return next((t for t in TIERS if n <= t), CONTEXT)


def pack_lengths(items: list[tuple[int, int, int]], final: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """items: (length, document, start). Gives full sequences of (document, start, length), and the items that fill none.

    Whole windows are cut off long documents. What is left is routed to the
    smallest tier that holds it; from the longest tier down, an item opens a
    window of its tier, which takes the longest items of shorter tiers that fit
    and, when none fits, the head of the shortest one. With ``final``, the rest
    is cut into sequences of powers of two, which need no padding.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for n, d, s in items:
        for _ in range(n // CONTEXT):
            sequences.append([(d, s, CONTEXT)])
            s += CONTEXT
        if n % CONTEXT:
            rest.append((n % CONTEXT, d, s))
    rest.sort()
    left: list[tuple[int, int, int]] = []
    while rest:
        n, d, s = rest.pop()
        window, gap = [(d, s, n)], tier_of(n) - n
        while gap and rest:
            at = bisect_right(rest, (gap, 1 << 62, 0)) - 1
            n2, d2, s2 = rest.pop(max(at, 0))
            take = min(n2, gap)
            window.append((d2, s2, take))
            gap -= take
            if n2 > take:
                insort(rest, (n2 - take, d2, s2 + take))
        if gap:
            left.extend((n3, d3, s3) for d3, s3, n3 in window)
        else:
            sequences.append(window)
    if final:
        total = sum(x[0] for x in left)
        while total:
            size = min(CONTEXT, 1 << (total.bit_length() - 1))
            window, gap = [], size
            while gap:
                n, d, s = left.pop()
                take = min(n, gap)
                window.append((d, s, take))
                gap -= take
                if n > take:
                    left.append((n - take, d, s + take))
            sequences.append(window)
            total -= size
    return sequences, left


def step_groups(sequences: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """A group for each sequence, of one tier alone; dealt in turns by falling attention cost, so that a tier's groups of a pool weigh about the same."""
    tiers = np.array([tier_of(sum(x[2] for x in s)) for s in sequences])
    cost = np.array([sum(x[2] ** 2 for x in s) for s in sequences])
    out, before = np.empty(len(sequences), np.int64), 0
    for t in TIERS:
        own = np.flatnonzero(tiers == t)
        groups = -(-len(own) // STEP)
        turn, place = np.divmod(np.arange(len(own)), max(1, groups))
        out[own[np.argsort(-cost[own], kind="stable")]] = before + np.where(turn % 2, groups - 1 - place, place)
        before += groups
    return out


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Pieces of all documents (null text: empty, so its end id alone), packed by each task for the rows it reads.

    No shuffle: a task keeps a pool of about a million tokens, and what fills no
    window goes on to its next pool. Each row is packed on its own: null ids and
    repeated rows too. A text of any length is cut into windows, the rest of it
    packed with others'. Equal lengths keep the order of rows. An empty table
    gives no rows.
    """
    small_batches(docs.sparkSession, size="1m")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .encoders import encoder

        base, coder, end = TaskContext.get().partitionId() << 40, encoder(vocabulary, "word"), np.uint32(end_id).tobytes()
        ids: dict[int, tuple[int | None, bytes]] = {}
        left: list[tuple[int, int, int]] = []
        new: list[tuple[int, int, int]] = []
        made = groups = pooled = count = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal left, new, made, groups, pooled
            sequences, left = pack_lengths(left + new, final)
            new, pooled = [], 0
            dealt = step_groups(sequences)
            rows: list[tuple] = []
            for k, (window, group) in enumerate(zip(sequences, dealt, strict=True)):
                offset, tier = 0, tier_of(sum(x[2] for x in window))
                for d, s, n in window:
                    doc, raw = ids[d]
                    rows.append((doc, s, n, raw[4 * s : 4 * (s + n)], len(raw) // 4, base + made + k, offset, tier, base + groups + int(group)))
                    offset += n
            made += len(sequences)
            groups += int(dealt.max()) + 1 if len(dealt) else 0
            keep = {d for _, d, _ in left}
            for d in [d for d in ids if d not in keep]:
                del ids[d]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), coder.encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                ids[count] = (doc, raw + end)
                new.append((len(raw) // 4 + 1, count, 0))
                pooled += len(raw) // 4 + 1
                count += 1
                if pooled >= POOL:
                    yield from flush(False)
        yield from flush(True)

    return only(docs, "doc_id", "text").mapInArrow(pack, PIECES)


def packing_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The pieces with a digest in place of their ids."""
    return pack_documents(docs, vocabulary).select("doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
