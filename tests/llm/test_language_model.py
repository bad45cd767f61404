"""The gated model against a plain forward pass, finite differences, and the sum of its probabilities."""

import math
from collections import Counter

import numpy as np
import zlib


def _model():
    from tidewake.llm.language_model import NAMES, GatedModel

    rng = np.random.default_rng(1)
    m = GatedModel(rng.random(NAMES) + 0.1)
    m.p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in m.p.items()}
    return m


def _plain(m, names):
    """Probabilities of all names at each step, one step at a time."""
    from tidewake.llm.language_model import CLASS_OF, HIDDEN, MEMBER_OF, NAMES, START

    def softmax(y):
        e = np.exp(y - y.max())
        return e / e.sum()

    h, last, out, p = np.zeros(HIDDEN), START, [], m.p
    for t in names:
        a, b = p["x"][last], h @ p["h"]
        z, r = (1 / (1 + np.exp(-(a + b)[k * HIDDEN : (k + 1) * HIDDEN])) for k in (0, 1))
        h = z * h + (1 - z) * np.tanh(a[2 * HIDDEN :] + r * b[2 * HIDDEN :])
        cls = softmax(h @ p["c"] + p["cb"])
        out.append(np.array([cls[CLASS_OF[n]] * softmax(h @ p["m"][CLASS_OF[n]] + p["mb"][CLASS_OF[n]])[MEMBER_OF[n]] for n in range(NAMES)]))
        last = t
    return out


def test_scores_equal_a_plain_pass_and_probabilities_sum_to_one():
    from tidewake.llm.language_model import END, NAMES

    rng, m = np.random.default_rng(2), _model()
    docs = [np.append(rng.integers(0, NAMES, n), END) for n in (0, 3, 150, 7)]
    for d, got in zip(docs, m.score(docs), strict=True):
        steps = _plain(m, d)
        assert all(abs(x.sum() - 1) < 1e-6 for x in steps)
        assert abs(sum(math.log10(x[t]) for x, t in zip(steps, d, strict=True)) - got) < 1e-4


def test_gradients_equal_finite_differences():
    from tidewake.llm.language_model import END, HIDDEN, NAMES, lanes_of

    rng, m = np.random.default_rng(3), _model()
    docs = [np.append(rng.integers(0, NAMES, n), END) for n in (9, 4, 6)]
    inputs, targets, keep, _, valid = next(lanes_of(docs, 2, 16))
    h = np.zeros((inputs.shape[1], HIDDEN))
    g, _ = m.gradients(inputs, targets, keep, valid, h)

    def loss():
        top = np.stack([s[5] for s in m.states(inputs, keep, h)])[valid]
        return -m.outputs(top, targets[valid])[0].mean()

    for k, v in g.items():
        for at in [np.unravel_index(np.abs(v).argmax(), v.shape), *[tuple(rng.integers(0, n) for n in v.shape) for _ in range(3)]]:
            old = m.p[k][at]
            m.p[k][at] = old + 1e-5
            up = loss()
            m.p[k][at] = old - 1e-5
            down = loss()
            m.p[k][at] = old
            assert abs((up - down) / 2e-5 - v[at]) < 1e-5, (k, at)


def test_every_row_is_scored_and_training_rows_alone_are_learned_from(spark):
    from tidewake.llm.language_model import score_documents

    rng = np.random.default_rng(4)
    base = [" ".join("abcdefgh"[(k + j) % 8] for j in range(60)) for k in range(8)]
    texts = [None, "", "one", "İstanbul\x0bA b", "x" * 30_000, " ".join(["rare%d" % i for i in range(3000)]), *[base[int(rng.integers(8))] for _ in range(300)]]
    rows = [(i, t, i * 2) for i, t in enumerate(texts)] + [(7, base[0], 0), (7, "other text", 1), (None, "no id", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long").repartition(3)
    got = score_documents(df).collect()
    assert len(got) == len(rows)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    split = lambda t: (t or "").encode().lower().split()
    counts = Counter(w for d, t, _ in rows if not held(d) for w in [*split(t), None])
    total, types = sum(counts.values()), len(counts)
    plain = lambda t: sum(math.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (types + 1))) for w in [*split(t), None])
    want = sorted((str(d), held(d), len(split(t)) + 1, sum(w in counts for w in [*split(t), None]), round(plain(t), 4)) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == total for r in got)
    inside = [r for r in got if r.n_tokens == 61 and r.held_out]
    assert inside and sum(r.score - r.base_score for r in inside) > 0
    assert score_documents(df.limit(0)).count() == 0


def test_the_net_tells_apart_a_thousand_words_and_keeps_its_state():
    """Sizes that were halved for a budget."""
    from tidewake.llm.language_model import CLASS_OF, HIDDEN, MEMBER_OF, NAMES, OWN

    assert OWN == 992 and HIDDEN == 16
    assert len(set(zip(CLASS_OF.tolist(), MEMBER_OF.tolist(), strict=True))) == NAMES
