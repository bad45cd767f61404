"""Positive-unlabelled quality: the risk and its slopes, the prior, features by plain loops, held-out labels, odd tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm.quality import _KINDS, best_bin_prior, features, learn, risk, score_quality

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("shift", [0.0, 4.0])
def test_slopes_of_the_risk(shift):
    rng = np.random.default_rng(1)
    good, web = rng.normal(shift, 1, 7), rng.normal(0, 1, 5)
    value, dg, dw = risk(good, web, 0.6)
    loss = lambda g: np.logaddexp(0, -g)
    bad = loss(-web).mean() - 0.6 * loss(-good).mean()
    assert (bad < 0) == (shift > 0) and value == pytest.approx(0.6 * loss(good).mean() + max(0, bad))
    aim = lambda g, w: (loss(-w).mean() - 0.6 * loss(-g).mean()) * (-1 if bad < 0 else 1) + (0 if bad < 0 else 0.6 * loss(g).mean())
    for k in range(7):
        step = np.eye(7)[k] * 1e-5
        assert dg[k] == pytest.approx((aim(good + step, web) - aim(good - step, web)) / 2e-5, abs=1e-6)
    for k in range(5):
        step = np.eye(5)[k] * 1e-5
        assert dw[k] == pytest.approx((aim(good, web + step) - aim(good, web - step)) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_and_classifier_of_a_known_mixture(share):
    rng = np.random.default_rng(2)
    web_is_good = rng.random(6000) < share
    good, web = rng.normal(1.5, 1, (4000, 4)), np.where(web_is_good[:, None], 1.5, -1.5) + rng.normal(0, 1, (6000, 4))
    model, prior = learn(good.astype(np.float32), web.astype(np.float32), epochs=16)
    assert prior == pytest.approx(share, abs=0.06)
    assert ((model.score(web) >= 0.5) == web_is_good).mean() > 0.97
    assert best_bin_prior(np.array([]), np.array([1.0])) == 0.5


def test_features_by_plain_loops():
    from tidewake.llm.quality import _CLASS

    texts = ["The the THE cat, 12!", "", None, "é|é one one one two", "a"]
    got = features(texts)
    for row, text in zip(got, texts, strict=True):
        raw, words = (text or "").encode(), (text or "").lower().split()
        want = np.zeros(_KINDS * _KINDS)
        for a, b in zip(raw, raw[1:], strict=False):
            want[_CLASS[a] * _KINDS + _CLASS[b]] += 1
        assert np.allclose(row[: len(want)], np.sqrt(want / max(1, len(raw) - 1)), atol=1e-6)
        n = max(1, len(words))
        rest = [np.log1p(len(raw)), np.log1p(len(words)), len(set(words)) / n, max([words.count(w) for w in words], default=0) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n]
        assert np.allclose(row[len(want) : len(want) + 5], rest, atol=1e-6)
    assert features([]).shape == (0, got.shape[1])


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = score_quality(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.where("held_out").join(labels.where("quality is not null"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert np.mean(np.array(good) >= 0.3) > 0.97 and np.mean(np.array(bad) < 0.3) > 0.9


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [sorted(map(tuple, score_quality(docs, x).collect())) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "Some words here."), (1, "Some words here."), (2, None), (None, "x"), (None, None), (3, ""), (4, "word " * 100_000)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (2, 1, None), (9, 1, 0), (None, 1, 1), (3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = score_quality(docs.withColumns({"good": F.lit(1), "web": F.lit(2), "score": F.lit(3), "x": F.lit(4), "quality": F.lit(0)}), labels.withColumn("good", F.lit(0))).collect()
    assert len(got) == 7 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert not any(r.held_out for r in got if r.doc_id is None)
    unlabelled = score_quality(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in unlabelled} == {(0.5, 1)}
    assert score_quality(docs.limit(0), labels).count() == 0
