"""Log-likelihood of whole documents by a gated recurrent model with class-factored outputs."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, small_batches, stored

#: Output classes, and members of a class: frequent words, and one member for all other words of the class.
CLASSES, MEMBERS = 32, 32
#: Words with an output of their own; the last one is the end of a document. Behind them come the others of each class.
OWN = CLASSES * (MEMBERS - 1)
END, START, NAMES = OWN - 1, OWN + CLASSES, OWN + CLASSES
HIDDEN, WINDOW, STRETCH = 16, 16, 512
#: Words whose counts workers hold, at most; counts of the others are joined.
HELD_WORDS = 150_000
#: Partitions that sums of weights are gathered in.
SUMS = 8
ADD = 0.1

CLASS_OF = np.concatenate([np.arange(OWN) % CLASSES, np.arange(CLASSES)])
MEMBER_OF = np.concatenate([np.arange(OWN) // CLASSES, np.full(CLASSES, MEMBERS - 1)])


def others(word: bytes) -> int:
    """The name that a word without an output of its own goes by: the others of a class chosen by its last two bytes."""
    return OWN + zlib.crc32(word[-2:]) % CLASSES


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _log_softmax(y: np.ndarray) -> np.ndarray:
    y = y - y.max(-1, keepdims=True)
    return y - np.log(np.exp(y).sum(-1, keepdims=True))


class GatedModel:
    """A gated recurrent unit over names. With its output weights at zero it is the unigram model of names."""

    def __init__(self, mass: np.ndarray):
        rng = np.random.default_rng(0)
        table = np.full((CLASSES, MEMBERS), 1e-9)
        table[CLASS_OF, MEMBER_OF] = np.maximum(mass, 1e-9)
        whole = table.sum(1)
        self.p = {
            "x": rng.normal(0, 0.1, (NAMES + 1, 3 * HIDDEN)), "h": rng.normal(0, 0.1, (HIDDEN, 3 * HIDDEN)), "c": np.zeros((HIDDEN, CLASSES)), "cb": np.log(whole / whole.sum()),
            "m": np.zeros((CLASSES, HIDDEN, MEMBERS)), "mb": np.log(table / whole[:, None]),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        self.step = 0

    def states(self, inputs: np.ndarray, keep: np.ndarray, h: np.ndarray) -> list[tuple]:
        """Steps of a window: the state before and after each, and what its gradient needs."""
        x, u, n = self.p["x"][inputs], self.p["h"], HIDDEN
        out = []
        for t in range(len(inputs)):
            h = h * keep[t][:, None]
            a, b = x[t], h @ u
            zr = 1 / (1 + np.exp(-(a[:, : 2 * n] + b[:, : 2 * n])))
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(a[:, 2 * n :] + r * b[:, 2 * n :])
            new = c + z * (h - c)
            out.append((h, z, r, c, b[:, 2 * n :], new))
            h = new
        return out

    def outputs(self, top: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(log probability of each target, gradient of the states): the class by one softmax, the member by its class's own."""
        cls, member, row = CLASS_OF[target], MEMBER_OF[target], np.arange(len(target))
        y = _log_softmax(top @ self.p["c"] + self.p["cb"])
        log, back = y[row, cls].astype(np.float64), None
        if grads is not None:
            d = np.exp(y)
            d[row, cls] -= 1
            d /= len(row)
            grads["c"], grads["cb"], back = top.T @ d, d.sum(0), d @ self.p["c"].T
            grads["m"], grads["mb"] = np.zeros_like(self.p["m"]), np.zeros_like(self.p["mb"])
        order = np.argsort(cls, kind="stable")
        edge = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            at = order[edge[k] : edge[k + 1]]
            if not len(at):
                continue
            y = _log_softmax(top[at] @ self.p["m"][k] + self.p["mb"][k])
            log[at] += y[np.arange(len(at)), member[at]]
            if grads is not None:
                d = np.exp(y)
                d[np.arange(len(at)), member[at]] -= 1
                d /= len(row)
                grads["m"][k], grads["mb"][k] = top[at].T @ d, d.sum(0)
                back[at] += d @ self.p["m"][k].T
        return log, back

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, keep: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of a window's mean loss, cut off at its first step, and the state it ends with."""
        steps = self.states(inputs, keep, h)
        g: dict[str, np.ndarray] = {}
        _, back = self.outputs(np.stack([s[5] for s in steps])[valid], targets[valid], g)
        outer = np.zeros((*inputs.shape, HIDDEN), np.float32)
        outer[valid] = back
        g["h"], dh, das = np.zeros_like(self.p["h"]), np.zeros_like(h), np.empty((*inputs.shape, 3 * HIDDEN), np.float32)
        for i in range(len(steps) - 1, -1, -1):
            old, z, r, c, bc, _ = steps[i]
            dh = dh + outer[i]
            dc = dh * (1 - z) * (1 - c * c)
            da = np.concatenate([dh * (old - c) * z * (1 - z), dc * bc * r * (1 - r), dc], 1)
            das[i] = da
            da[:, 2 * HIDDEN :] *= r
            g["h"] += old.T @ da
            dh = (dh * z + da @ self.p["h"].T) * keep[i][:, None]
        flat = inputs.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        g["x"] = np.zeros_like(self.p["x"])
        g["x"][flat[order][first]] = np.add.reduceat(das.reshape(-1, 3 * HIDDEN)[order], first)
        return g, steps[-1][5]

    def fit(self, documents: list[np.ndarray]) -> GatedModel:
        """One pass of backpropagation truncated to windows; the state, not the gradient, goes on from window to window. Adam.

        Long documents are learned from in stretches, so that lanes are of one
        length and no window holds a single document alone.
        """
        h = None
        documents = [x[k : k + STRETCH] for x in documents for k in range(0, len(x), STRETCH)]
        for inputs, targets, keep, _, valid in lanes_of(documents, int(np.clip(sum(map(len, documents)) // (WINDOW * 64), 4, 256)), WINDOW):
            g, h = self.gradients(inputs, targets, keep, valid, np.zeros((inputs.shape[1], HIDDEN), np.float32) if h is None else h[: inputs.shape[1]])
            self.step += 1
            rate = 0.01 / (1 - 0.9**self.step) * np.sqrt(1 - 0.999**self.step)
            for k, v in g.items():
                m, s = self.moments[k]
                np.clip(v, -1, 1, out=v)
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                self.p[k] -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
        return self

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Sum of log10 probabilities of each document's names; the state is carried across windows to its end."""
        out, h = np.zeros(len(documents)), None
        total, longest = sum(map(len, documents)), max(map(len, documents), default=0)
        for inputs, targets, keep, doc, valid in lanes_of(documents, int(np.clip(total // max(longest, 512), 32, 512)), 64):
            steps = self.states(inputs, keep, np.zeros((inputs.shape[1], HIDDEN), np.float32) if h is None else h[: inputs.shape[1]])
            h = steps[-1][5]
            log, _ = self.outputs(np.stack([s[5] for s in steps])[valid], targets[valid])
            out += np.bincount(doc[valid], log, len(documents))
        return out / np.log(10)

    def packed(self) -> bytes:
        return b"".join(self.p[k].tobytes() for k in sorted(self.p))

    def unpack(self, flat: np.ndarray) -> GatedModel:
        at = 0
        for k in sorted(self.p):
            self.p[k] = flat[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size
        return self


def lanes_of(documents: list[np.ndarray], lanes: int, window: int) -> Iterator[tuple]:
    """Windows (inputs, targets, keep, document, valid), each ``window`` by lanes: documents run behind one another in lanes, long ones first; lanes end in falling order of length."""
    import heapq

    order = sorted((i for i in range(len(documents)) if len(documents[i])), key=lambda i: -len(documents[i]))
    queue: list[list[int]] = [[] for _ in range(min(lanes, len(order)))]
    load, heap = [0] * len(queue), [(0, k) for k in range(len(queue))]
    for i in order:
        n, k = heapq.heappop(heap)
        queue[k].append(i)
        load[k] = n + len(documents[i])
        heapq.heappush(heap, (load[k], k))
    ranked = sorted(range(len(queue)), key=lambda k: -load[k])
    if not ranked:
        return
    steps = -(-max(load) // window) * window
    targets, doc = np.full((len(ranked), steps), -1, np.int32), np.full((len(ranked), steps), -1, np.int32)
    for j, k in enumerate(ranked):
        targets[j, : load[k]] = np.concatenate([documents[i] for i in queue[k]])
        doc[j, : load[k]] = np.repeat(np.array(queue[k], np.int32), [len(documents[i]) for i in queue[k]])
    same = np.zeros(doc.shape, bool)
    same[:, 1:] = doc[:, 1:] == doc[:, :-1]
    inputs = np.full(doc.shape, START, np.int32)
    inputs[:, 1:][same[:, 1:]] = targets[:, :-1][same[:, 1:]]
    inputs[inputs < 0] = START
    size = np.array([load[k] for k in ranked])
    for at in range(0, steps, window):
        live = int((size > at).sum())
        part = (slice(0, live), slice(at, at + window))
        valid = doc[part].T >= 0
        yield inputs[part].T, targets[part].T, same[part].T.astype(np.float32), doc[part].T, valid


class _Names(dict):
    """Place of a word in the held counts; any other word is noted, and stands for the others of its class as a negative number."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.rare: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.rare.append(word)
        return -others(word)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some megabytes, but whole rows."""
    size = max(1, batch.num_rows * (12 << 20) // max(1, batch.nbytes))
    for k in range(0, batch.num_rows, size):
        yield batch.slice(k, size)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row over its whole text.

    The net reads and predicts names: frequent words and, of each class, all
    other words together. A word's probability is that of its class, from the
    net's state, times that of its name within the class, from the state too;
    another word also takes its share of the training counts of the others of
    its class (0.1 added to each; words never seen in training are one more).
    Every task trains on all training rows that it reads, from the same start;
    the weights are averaged by tokens. Documents whose id's crc32 ends in 0 are
    held out of counts and training. A null id counts as an empty one; null and
    empty texts are one end. Repeated rows are scored, and counted, each time.
    With no training rows both scores rest on 0.1 alone; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    small_batches(spark, 4096, "12m")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    rows = only(docs, "doc_id", "text").withColumn("held_out", held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(words.keys()), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "c"])
            words.clear()
            return out

        for b in batches:
            for x in b.column(0).to_pylist():
                words.update(words_of(x))
                if len(words) > 300_000:
                    yield told()
        yield told()

    train = rows.where("not held_out")
    vocabulary = stored(train.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    ends = train.count()
    total, types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, types = total + ends, types + (ends > 0)
    # Words are taken from a count on, so that no task sends more than are held.
    level = F.floor(F.log2("c") * 16).cast("int")
    steps, kept, least = vocabulary.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect(), 0, 1 << 30
    for r in steps:
        kept += r["count"]
        if kept > HELD_WORDS:
            break
        least = r["level"]
    top = sorted(vocabulary.where(level >= least).collect(), key=lambda r: (-r.c, r.word))
    words, counts = [bytes(r.word) for r in top], np.array([r.c for r in top], float)
    own = {w: k for k, w in enumerate(words[:END])}

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CLASSES)
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w not in own:
                    sums[others(w) - OWN] += c + ADD
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(sums)], names=["k", "mass"])

    mass = np.zeros(NAMES)
    mass[OWN:] = ADD
    for r in vocabulary.mapInArrow(masses, "k long, mass double").groupBy("k").agg(F.sum("mass").alias("mass")).collect():
        mass[OWN + r.k] += r.mass
    mass[: len(own)] = counts[: len(own)] + ADD
    mass[END] = ends + ADD
    names = np.array([own.get(w, others(w)) for w in words], np.int32)
    shared = spark.sparkContext.broadcast((words, names, np.log10(counts + ADD), mass))
    del top, words

    def sequences(part: pa.RecordBatch, known: _Names, names: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[list[bytes]]]:
        """Of each text: names with the end, places in the held counts, and words that aren't held."""
        places, rare = [], []
        for text in part.column(0).to_pylist():
            places.append(list(map(known.__getitem__, words_of(text))))
            rare.append(known.rare)
            known.rare = []
        flat = np.fromiter(chain.from_iterable(places), np.int32, sum(map(len, places)))
        cut = np.cumsum([len(x) for x in places])[:-1]
        named = np.where(flat >= 0, names[np.maximum(flat, 0)] if len(names) else 0, -flat)
        return [np.append(x, END) for x in np.split(named, cut)], np.split(flat, cut), rare

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, names, _, mass = shared.value
        model, known, tokens = GatedModel(mass), _Names(words), 0
        for whole in batches:
            for part in _parts(whole):
                texts, _, _ = sequences(part, known, names)
                model.fit(texts)
                tokens += sum(map(len, texts))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS]), pa.array([float(tokens)]), pa.array([model.packed()], pa.binary())], names=["slot", "tokens", "weights"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, flat = 0.0, None
        for b in batches:
            for n, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(w, np.float32) * n
                tokens, flat = tokens + n, x if flat is None else flat + x
        if flat is not None:
            yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([flat.astype(np.float64).tobytes()], pa.binary())], names=["tokens", "weights"])

    learned = train.select("text").mapInArrow(learn, "slot long, tokens double, weights binary").repartition(SUMS, "slot").mapInArrow(add, "tokens double, weights binary").collect()
    model = GatedModel(mass)
    if learned:
        model.unpack(sum(np.frombuffer(r.weights) for r in learned) / sum(r.tokens for r in learned))
    weights = spark.sparkContext.broadcast(model.packed())
    del learned

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, names, logs, mass = shared.value
        model, known, log_mass = GatedModel(mass).unpack(np.frombuffer(weights.value, np.float32)), _Names(words), np.log10(mass)
        row = TaskContext.get().partitionId() << 36
        for whole in batches:
            for b in _parts(whole):
                texts, places, rare = sequences(b, known, names)
                base = [float(logs[p[p >= 0]].sum() + log_mass[END]) for p in places]
                seen = [len(t) - len(r) - (ends == 0) for t, r in zip(texts, rare, strict=True)]
                got = model.score(texts) - np.array([log_mass[t].sum() for t in texts])
                away = [[{"word": w, "n": n} for w, n in Counter(r).items()] for r in rare]
                out = [pa.array(row + np.arange(b.num_rows)), b.column(1), b.column(2), pa.array([len(t) for t in texts], pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64()), pa.array(got, pa.float64()), pa.array(away, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())])))]
                row += b.num_rows
                yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "held_out", "n_tokens", "seen", "base", "gain", "rare"])

    first = stored(rows.select("text", "doc_id", "held_out").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, seen long, base double, gain double, rare array<struct<word:binary,n:int>>"), "scores")
    tail = first.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    log = F.log10(F.coalesce(F.col("c"), F.lit(0)) + ADD) * F.col("n")
    tail = tail.join(vocabulary, "word", "left").groupBy("row").agg(F.sum(log).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("found"))
    logs = F.col("base") + F.coalesce("more", F.lit(0.0))
    floor = float(np.log10(total + ADD * (types + 1)))
    return first.drop("rare").join(tail, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * floor).alias("base_score"), (logs + F.col("gain")).alias("score"))
