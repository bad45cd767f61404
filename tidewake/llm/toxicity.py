"""Toxicity by a classifier chain of linear models over hashed text features."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, only, small_batches, stored

#: Labelled rows that the models learn from, about and at most in the mean (taken by a hash of doc_id).
FIT_ROWS = 12_000
BITS = 18
FOLDS = 5
#: Kinds that labelled toxic rows are parted into.
KINDS = 2
CHAIN = ("low_quality", *[f"kind_{k + 1}" for k in range(KINDS)], "toxic")
#: Standard deviations by which a feature's share of a category must stand out, else it is noise that long texts add up.
STANDS_OUT = 4.0
_LETTERS = re.compile(r"[^\W\d_]+")


class Features:
    """Feature ids of a text: each distinct word, and its first four and five letters, hashed."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> tuple[int, ...]:
        import zlib

        mask = (1 << BITS) - 1
        return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in {"w" + w, "p" + w[:4], "p" + w[:5]})

    def of(self, text: str) -> np.ndarray:
        if len(self.known) > 100_000:
            self.known.clear()
        out: set[int] = set()
        for w in set(_LETTERS.findall(text.translate(LOWER))):
            if (got := self.known.get(w)) is None:
                got = self.known[w] = self.word(w)
            out.update(got)
        return np.fromiter(out, np.int32, len(out))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Sets of features of many texts, end to end."""

    def __init__(self, lists: list[np.ndarray]):
        self.size = np.array([len(x) for x in lists], np.int64)
        self.flat = np.concatenate([*lists, np.empty(0, np.int32)])
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def __len__(self) -> int:
        return len(self.size)

    def some(self, rows: np.ndarray) -> Rows:
        return Rows([self.flat[self.at[i] : self.at[i + 1]] for i in rows])

    def within(self, features: np.ndarray) -> Rows:
        """Only ``features`` (sorted), by their places among them."""
        place = np.minimum(np.searchsorted(features, self.flat), max(0, len(features) - 1))
        keep = features[place] == self.flat if len(features) else np.zeros(len(self.flat), bool)
        out = Rows([])
        out.size = np.add.reduceat(np.append(keep, False), self.at[:-1]) * (self.size > 0) if len(self) else self.size
        out.flat, out.at = place[keep], np.concatenate([[0], np.cumsum(out.size)])
        return out


class Linear:
    """Logistic regression over the features that stand out, and a few dense inputs, by Adagrad on mini-batches; seeded."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, dense: int):
        self.features, self.w, self.dense = features, weights, dense

    def raw(self, rows: Rows, extra: np.ndarray) -> np.ndarray:
        n = len(self.features)
        sums = np.concatenate([[0], np.cumsum(self.w[rows.flat], dtype=np.float64)])
        return (sums[rows.at[1:]] - sums[rows.at[:-1]]) + extra @ self.w[n : n + self.dense] + self.w[-1]

    def score(self, rows: Rows, extra: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(rows.within(self.features), extra))

    @classmethod
    def fit(cls, rows: Rows, extra: np.ndarray, y: np.ndarray, epochs: int = 6) -> Linear:
        own, share = y[np.repeat(np.arange(len(y)), rows.size)], y.mean()
        n = np.bincount(rows.flat, minlength=1 << BITS)
        z = (np.bincount(rows.flat, own, 1 << BITS) - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
        features = np.flatnonzero(np.abs(z) >= STANDS_OUT)
        if not len(features):  # too few rows to tell
            features = np.flatnonzero(n)
        rows, m = rows.within(features), len(features)
        out = cls(features.astype(np.int32), np.zeros(m + extra.shape[1] + 1, np.float32), extra.shape[1])
        rng, square = np.random.default_rng(0), np.full(len(out.w), 1e-6, np.float32)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
                some = rows.some(part)
                err = (_sigmoid(out.raw(some, extra[part])) - y[part]) / len(part)
                g = np.bincount(some.flat, np.repeat(err, some.size), len(out.w)).astype(np.float32)
                g[m : m + out.dense], g[-1] = err @ extra[part], err.sum()
                g += 1e-6 * out.w
                square += g * g
                out.w -= 0.2 * g / np.sqrt(square)
        return out


def kinds_of(rows: Rows, toxic: np.ndarray) -> np.ndarray:
    """A kind for each toxic row (-1 for others): spherical k-means over the features that stand out among toxic rows, from rows far apart."""
    out, mine = np.full(len(rows), -1), np.flatnonzero(toxic)
    if not len(mine):
        return out
    features = Linear.fit(rows, np.zeros((len(rows), 0)), toxic.astype(float), epochs=0).features[:4096]
    some = rows.some(mine).within(features)
    x = np.zeros((len(mine), len(features)), np.float32)
    x[np.repeat(np.arange(len(mine)), some.size), some.flat] = 1
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = [x[x.sum(1).argmax()]]
    while len(centre) < KINDS:
        centre.append(x[(x @ np.array(centre).T).max(1).argmin()])
    centre = np.array(centre)
    for _ in range(8):
        near = (x @ centre.T).argmax(1)
        centre = np.array([x[near == k].sum(0) if (near == k).any() else centre[k] for k in range(KINDS)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    out[mine] = near
    return out


def fit_chain(rows: Rows, targets: np.ndarray) -> tuple[list[Linear], float]:
    """One model a category, in order, and the threshold of the last.

    A later model sees earlier categories' probabilities, which for its training
    rows come out of fold. The threshold parts the last one's probabilities, out
    of fold too, so that the shares of toxic and of other rows told right add up
    to the most; of equals the nearest to a half.
    """
    fold = np.arange(len(rows)) % FOLDS
    extra, models = np.zeros((len(rows), 0)), []
    for k in range(targets.shape[1]):
        models.append(Linear.fit(rows, extra, targets[:, k]))
        held = np.full(len(rows), targets[:, k].mean() if len(rows) else 0.0)
        for f in range(FOLDS):
            fit, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(fit) and len(out):
                held[out] = Linear.fit(rows.some(fit), extra[fit], targets[fit, k]).score(rows.some(out), extra[out])
        extra = np.column_stack([extra, held])
    last, y = extra[:, -1], targets[:, -1] > 0
    grid = sorted(np.arange(1, 100) / 100, key=lambda t: abs(t - 0.5))
    right = [(last[y] >= t).mean() + (last[~y] < t).mean() if y.any() and (~y).any() else 0.0 for t in grid]
    return models, float(grid[int(np.argmax(np.round(right, 4)))])


def fit_models(docs: DataFrame, labels: DataFrame) -> tuple[list[Linear], float]:
    """The chain and its threshold, fitted in one task on the features of about ``FIT_ROWS`` labelled rows at most."""
    labels = only(labels, "doc_id", "quality", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    share = min(1.0, FIT_ROWS / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([f.of(x or "").astype("<i4").tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "toxic", "quality", "ids"])

    taught = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), F.col("quality").cast("int").alias("quality"))
    taught = stored(taught.mapInArrow(featurize, "doc_id long, toxic int, quality int, ids binary").groupBy("doc_id").agg(F.min(F.struct("ids", "toxic", "quality")).alias("r")).select("doc_id", "r.*"), "taught")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((d, t > 0, q is not None and q == 0, i) for b in batches for d, i, t, q in zip(*[c.to_pylist() for c in b.columns], strict=True))
        toxic, low = (np.array([r[k] for r in held], bool) for k in (1, 2))
        if not toxic.any():
            return
        counts = np.zeros((3, 1 << BITS), np.float32)  # of all, toxic and low rows with a feature
        for _, t, q, i in held:
            ids = np.frombuffer(i, "<i4")
            counts[0, ids] += 1
            counts[1, ids] += t
            counts[2, ids] += q
        may = [np.abs(counts[k] - counts[0] * y.mean()) >= (STANDS_OUT - 1) * np.sqrt(counts[0] * y.mean() * (1 - y.mean())) for k, y in ((1, toxic), (2, low))]
        may = (may[0] | may[1]) & (counts[0] > 0)
        may = may if may.any() else counts[0] > 0
        rows = Rows([ids[may[ids]] for ids in (np.frombuffer(r[3], "<i4") for r in held)])
        del held, counts
        kinds = kinds_of(rows, toxic)
        models, threshold = fit_chain(rows, np.column_stack([low, *[kinds == k for k in range(KINDS)], toxic]).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([m.features.tobytes() for m in models], pa.binary()), pa.array([m.w.tobytes() for m in models], pa.binary()), pa.array([threshold] * len(models))], names=["features", "weights", "threshold"])

    told = taught.coalesce(1).mapInArrow(fit, "features binary, weights binary, threshold double").collect()
    models = [Linear(np.frombuffer(r.features, np.int32), np.frombuffer(r.weights, np.float32), k) for k, r in enumerate(told)]
    return models, told[0].threshold if told else 1.0


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """doc_id, the probability of each category in chain order, and ``toxic`` (probability of the last reaches ``threshold``, or the fitted one).

    The chain is low quality, kinds of toxic rows (found by clustering the
    labelled ones), toxic. It learns from about ``FIT_ROWS`` labelled documents
    at most; every document is scored over its whole text, one row for each
    input row, repeated ones too. Null or empty texts have no features and score
    the base rate. Labels that are null or without a document teach nothing; of
    labels or texts that repeat a doc_id one counts (the largest label). Without
    toxic labels nothing is toxic; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = only(docs, "doc_id", "text")
    models, fitted = fit_models(rows, labels)
    limit = fitted if threshold is None else threshold

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in batches:
            own = Rows([f.of(x or "") for x in b.column(1).to_pylist()])
            extra = np.zeros((len(own), 0))
            for m in models:
                extra = np.column_stack([extra, m.score(own, extra)])
            if not models:
                extra = np.zeros((len(own), len(CHAIN)))
            toxic = (extra[:, -1] >= limit) & bool(models)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(extra[:, k]) for k in range(len(CHAIN))], pa.array(toxic)], names=["doc_id", *[f"p_{n}" for n in CHAIN], "toxic"])

    return rows.mapInArrow(score, "doc_id long, " + "".join(f"p_{n} double, " for n in CHAIN) + "toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The documents, with all their columns, whose row is not judged toxic.

    Rows of one doc_id are judged together: one toxic text rejects it; rows
    without doc_id are kept, whatever their text. An empty table stays empty.
    """
    from .common import anti_join

    bad = stored(score_toxicity(docs, labels, threshold).where("toxic and doc_id is not null").select("doc_id").distinct(), "toxic")
    return anti_join(docs, bad)
