"""Quality by positive-unlabelled learning: trusted good texts, web text without labels, and an estimated share of good ones.

The classifier is a small network over the shape of a text. It minimises the
non-negative unbiased risk (Kiryo and others, 2017): with p the class prior,
p * E_good[l(g)] + max(0, E_web[l(-g)] - p * E_good[l(-g)]). The prior is the best
bin estimate (Garg and others, 2021) out of good and web texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, shingle_hashes, small_batches, stored, word_hashes

#: Trusted good texts, and texts without label, that the model learns from, about and at most in the mean (taken by hashes of doc_id).
FIT_ROWS = 10_000
#: Probability from which a text is predicted good.
THRESHOLD = 0.3
HIDDEN = 24
EPOCHS = 40
_KINDS = 16
_CLASS = np.full(256, 13)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\x0b\x0c\r", b".", b",", b"!", b"?", b";:", b"'\"`", b"()[]{}<>", b"|/\\")):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 14
_CLASS[[c for c in (*range(32), 127) if not 9 <= c <= 13]] = 15
WIDTH = _KINDS * _KINDS + 9


def _runs(value: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, occurrences of the commonest) of each text's values; both 0 without values."""
    distinct, most = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if len(value):
        doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
        key = np.sort(doc << np.uint64(48) | value >> np.uint64(16))
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        of, size = (key[begin] >> np.uint64(48)).astype(np.int64), np.diff(np.append(begin, len(key)))
        distinct = np.bincount(of, minlength=len(counts))
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        most[of[first]] = np.maximum.reduceat(size, first)
    return distinct, most


def features(texts: list[str | None]) -> np.ndarray:
    """A row for each text: roots of the shares of pairs of neighbouring kinds of byte, and how its words repeat, how long they are and how many."""
    texts = [x or "" for x in texts]
    n = len(texts)
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    size = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    pairs = np.bincount((doc[1:] * _KINDS + kind[:-1])[doc[1:] == doc[:-1]] * _KINDS + kind[1:][doc[1:] == doc[:-1]], minlength=n * _KINDS * _KINDS).reshape(n, -1) if n else np.zeros((0, _KINDS * _KINDS))
    hashes, _, counts = word_hashes(texts)
    own = np.repeat(np.arange(n), counts)
    again = np.bincount(own[1:][(hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])], minlength=n) if n else counts
    runs, sizes = shingle_hashes(hashes, counts, 3)
    distinct, most = _runs(hashes, counts)
    phrases, commonest = _runs(runs, sizes)
    letters = np.bincount(doc[~np.isin(kind, (3, 4))], minlength=n)
    per = lambda a, b: a / np.maximum(b, 1)
    rest = [np.log1p(size), np.log1p(counts), per(distinct, counts), per(most, counts), per(again, counts), per(phrases, sizes), per(commonest, sizes), np.log1p(per(letters, counts)), np.log1p(distinct) - np.log1p(counts) * 0.8]
    return np.column_stack([np.sqrt(pairs / np.maximum(size - 1, 1)[:, None]), *rest]).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Network:
    """One hidden layer of tanh over standardised features; its output is the log odds of a good text."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: list[np.ndarray]):
        self.mean, self.spread, self.weights = mean, spread, weights

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6).astype(np.float32)

    def layers(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.weights
        h = np.tanh(z @ a + b)
        return h, h @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, to nine places: the last bits of a product depend on the rows beside it."""
        h = np.tanh(self.inputs(x).astype(np.float64) @ self.weights[0] + self.weights[1])
        return np.round(_sigmoid(h @ self.weights[2] + self.weights[3][0]), 9)

    def gradient(self, z: np.ndarray, dg: np.ndarray) -> list[np.ndarray]:
        h, _ = self.layers(z)
        back = np.outer(dg, self.weights[2]) * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ dg, np.array([dg.sum()])]

    @classmethod
    def start(cls, x: np.ndarray) -> Network:
        rng = np.random.default_rng(0)
        spread = x.std(0)
        return cls(x.mean(0), np.where(spread > 1e-6, spread, 1).astype(np.float32), [w.astype(np.float32) for w in (rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1))])


def risk(good: np.ndarray, web: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(non-negative risk, its slopes by the outputs ``good`` and ``web``) with the logistic loss.

    Where the part of the bad class falls below 0, the slopes climb out of it again.
    """
    loss = lambda g: np.logaddexp(0, -g)
    bad = loss(-web).mean() - prior * loss(-good).mean()
    of_good, of_web = prior * _sigmoid(good) / len(good), _sigmoid(web) / len(web)
    if bad < 0:
        return float(prior * loss(good).mean()), of_good, -of_web
    return float(prior * loss(good).mean() + bad), -prior * _sigmoid(-good) / len(good) - of_good, of_web


def best_bin_prior(good: np.ndarray, web: np.ndarray, wrong: float = 0.1) -> float:
    """The share of good texts in ``web``, by scores that tell the two apart: the least ratio of the shares above a threshold, with a margin for chance."""
    if not len(good) or not len(web):
        return 0.5
    at = np.sort(good)
    above = 1 - np.arange(len(at)) / len(at)
    web_above = 1 - np.searchsorted(np.sort(web), at, "left") / len(web)
    slack = np.sqrt(np.log(4 / wrong) / 2 / len(good)) + np.sqrt(np.log(4 / wrong) / 2 / len(web))
    best = np.argmin((web_above + slack) / above)
    return float(np.clip(web_above[best] / above[best], 0.01, 0.99))


def _trained(good: np.ndarray, web: np.ndarray, prior: float | None, epochs: int) -> Network:
    """A network by Adam on mini-batches; without prior it tells good from web texts."""
    out = Network.start(web)
    z_good, z_web = out.inputs(good), out.inputs(web)
    rng, step = np.random.default_rng(1), 0
    first, second = [np.zeros_like(w) for w in out.weights], [np.zeros_like(w) for w in out.weights]
    for epoch in range(epochs):
        rate = 0.005 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        parts = max(1, len(z_web) // 256)
        for a, b in zip(np.array_split(rng.permutation(len(z_good)), parts), np.array_split(rng.permutation(len(z_web)), parts), strict=True):
            if not len(a) or not len(b):
                continue
            g, w = out.layers(z_good[a])[1], out.layers(z_web[b])[1]
            dg, dw = risk(g, w, prior)[1:] if prior is not None else (-_sigmoid(-g) / len(g), _sigmoid(w) / len(w))
            step += 1
            for k, (x, y) in enumerate(zip(out.gradient(z_good[a], dg), out.gradient(z_web[b], dw), strict=True)):
                slope = x + y + 1e-4 * out.weights[k]
                first[k] += 0.1 * (slope - first[k])
                second[k] += 0.001 * (slope * slope - second[k])
                out.weights[k] = (out.weights[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return out


def learn(good: np.ndarray, web: np.ndarray, epochs: int = EPOCHS) -> tuple[Network, float]:
    """(the classifier, the class prior): the prior from scores out of fold, by halves."""
    told, held = [], []
    for k in (0, 1):
        if len(good) > 1 and len(web) > 1:
            half = _trained(good[k::2], web[k::2], None, max(1, epochs // 4))
            told.append(half.score(good[1 - k :: 2]))
            held.append(half.score(web[1 - k :: 2]))
    prior = float(np.mean([best_bin_prior(a, b) for a, b in zip(told, held, strict=True)])) if told else 0.5
    return _trained(good, web, prior, epochs), prior


def fit_quality(docs: DataFrame, labels: DataFrame) -> tuple[Network, float] | None:
    """The model and the prior, learned in one task from about ``FIT_ROWS`` good and as many unlabelled rows at most; none without trusted good ones.

    Rows whose crc32 of doc_id is divisible by 5 teach nothing; neither do rows
    without doc_id. A label counts as good if every label of its doc_id says 1.
    Of rows that repeat a doc_id one counts.
    """
    taught = lambda df: df.where("doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    good = taught(only(labels, "doc_id", "quality").where("quality is not null")).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    part = lambda rows, seed: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < int(min(1.0, FIT_ROWS / max(1, rows)) * (1 << 20))
    docs = taught(docs)
    chosen = good.where(part(good.count(), 1)).withColumn("good", F.lit(True))
    rows = docs.join(F.broadcast(chosen), "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"), part(docs.count(), 2).alias("web")).where("good or web")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "good", "web", "x"])

    held = rows.mapInArrow(featurize, "doc_id long, good boolean, web boolean, x binary").groupBy("doc_id").agg(F.min(F.struct("x", "good", "web")).alias("r")).select("doc_id", "r.*")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        side = lambda k: np.frombuffer(b"".join(r[1] for r in rows if r[k]), np.float32).reshape(-1, WIDTH)
        good, web = side(2), side(3)
        if len(good) and len(web):
            model, prior = learn(good, web)
            arrays = [model.mean, model.spread, *model.weights]
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(a, np.float32).tobytes() for a in arrays], pa.binary()), pa.array([prior] * len(arrays))], names=["w", "prior"])

    told = stored(held, "quality").coalesce(1).mapInArrow(fit, "w binary, prior double").collect()
    if not told:
        return None
    mean, spread, a, b, c, d = (np.frombuffer(r.w, np.float32) for r in told)
    return Network(mean, spread, [a.reshape(-1, HIDDEN), b, c, d]), told[0].prior


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: each row's probability of a good text, over its whole text, and 1 from ``THRESHOLD`` on.

    The model sees texts alone. Null texts score as empty ones; repeated rows
    score alike; a row without doc_id counts as not held out. Without trusted good
    labels every row scores a half. Other columns take no part; an empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = only(docs, "doc_id", "text")
    learned = fit_quality(rows, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(learned[0].score(x) if learned else np.full(len(x), 0.5))], names=["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return rows.mapInArrow(score, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
