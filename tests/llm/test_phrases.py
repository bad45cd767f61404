"""Collocations by stripes against plain counting and SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import differences
from pyspark.sql import functions as F

from tidewake.llm import phrases
from tidewake.llm.phrases import COLLOCATIONS_SQL, Words, candidates, collocations

SCHEMA = "doc_id long, lang string, text string"


def expected(rows, least, top=2000):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    covered = {(lang, w[i:j]) for (lang, w), a in cand.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and cand[lang, w[i:j]] <= a}
    out = []
    for (lang, w), a in cand.items():
        if (lang, w) not in covered:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    rank = Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            yield (lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score)


@pytest.fixture
def rows():
    rng = random.Random(3)
    vocabulary = ["of", "the", "New", "york", "Éa", "a", "b!c", "x\ty"]
    out = [(i, rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", "\x0b", "\xa0"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    out += [(1000 + i, "en", "to be or not to be now") for i in range(110)] + [(2000, "en", None), (2001, None, ""), (2002, "en", "a " * 5000), (2003, "en", "z" * 200_000), (None, "en", "of the of the"), (None, "en", "of the of the"), (5, "", "the end")]
    return out


def test_equals_plain_counting(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = collocations(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = list(expected(rows, 100))
    assert len({len(w[2].split(" ")) for w in want}) == 4
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted(map(tuple, collocations(docs, top=7).collect())) == sorted(expected(rows, 100, 7))


def test_bounded_buffers_hot_prefixes_and_a_full_filter(spark, rows, monkeypatch):
    """Small buffers, every prefix in segments and a filter that passes nearly everything change no row."""
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(map(tuple, collocations(docs).collect()))
    for name, value in (("HELD", 64), ("HOT_SHARE", 0.0), ("FILTER_BITS", 9)):
        monkeypatch.setattr(phrases, name, value)
    assert sorted(map(tuple, collocations(docs).collect())) == want


def test_totals_of_stripes_are_the_prefixes_own(spark, rows):
    levels, _ = candidates(spark.createDataFrame(rows, SCHEMA))
    own = {r.key: r.f for r in levels[1].collect()}
    assert levels[2].count() and all(own[r.p] == r.firsts[-1] and own[r.s] == r.lasts[-1] for r in levels[2].collect())


def test_empty_tables_and_other_columns(spark, rows):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, "en", "once only")], SCHEMA)).count() == 0
    docs = spark.createDataFrame(rows, SCHEMA)
    more = docs.withColumns({c: F.lit("x") for c in ("key", "phrase", "f", "n", "p", "s", "last", "word")})
    assert sorted(map(tuple, collocations(more).collect())) == sorted(map(tuple, collocations(docs).collect()))


def test_words():
    w = Words(["One, two\tTHREE", None, "é one"], ["en", "en", "fr"])
    assert [w.data[s:e].decode() for s, e in zip(w.start, w.end, strict=True)] == ["one", "two", "three", "é", "one"]
    assert w.doc.tolist() == [0, 0, 0, 2, 2] and w.key[0] != w.key[4]
    keys, whole = w.phrases(2)
    assert whole.tolist() == [False, True, False, True] and len(np.unique(keys)) == 4


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = collocations(spark.read.parquet(f"{sf}/documents.parquet"))
    assert got.count() > 50 and differences(got, COLLOCATIONS_SQL, sf) == []
