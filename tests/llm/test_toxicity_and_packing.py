"""Held-out accuracy of the classifier chain, its edges, and brute-force properties of packed sequences."""

import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pytest


def test_chain_on_held_out_labels(spark):
    """Long texts with one telling word among thousands, in the given tables."""
    from tidewake.llm.toxicity import score_toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    held = labels.where("doc_id % 3 = 0")
    got = score_toxicity(docs.join(held.select("doc_id"), "doc_id", "left_semi").unionByName(docs.join(labels.where("doc_id % 3 <> 0").select("doc_id"), "doc_id", "left_semi")), labels.where("doc_id % 3 <> 0"))
    rows = got.join(held.select("doc_id", held.toxic.alias("label")), "doc_id").select("toxic", "label").collect()
    bad, good = [r.toxic for r in rows if r.label], [r.toxic for r in rows if not r.label]
    assert np.mean(bad) >= 0.88 and np.mean(good) <= 0.03  # about a tenth of the toxic labels have nothing in their text


def test_chain_edges(spark):
    from tidewake.llm.toxicity import drop_toxic, score_toxicity

    rows = [(i, f"plain words here {i}" + (" vilest" if i % 4 == 0 else ""), 1.0, "x") for i in range(200)]
    rows += [(4, "plain words again", 2.0, "y"), (None, "vilest vilest", 3.0, "z"), (1000, "w" * 200_000, 0.0, ""), (1001, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic double, tw_gone string")
    labels = spark.createDataFrame([*[(i, None, int(i % 4 == 0), "extra") for i in range(160)], (8, 1, 1, "again")], "doc_id long, quality int, toxic int, text string")
    got = score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.p_toxic <= 1 for r in got)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = Counter(r.doc_id for r in kept.collect())
    assert left[4] == 0 and left[None] == 1 and left[1000] == left[1001] == 1 and not any(left[i] for i in range(160, 200, 4)) and left[161] == 1
    assert drop_toxic(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("final", [True, False])
def test_sequences_are_full(final):
    from tidewake.llm.packing import CONTEXT, pack_lengths

    rng = np.random.default_rng(5)
    items = [(int(n), d, 0) for d, n in enumerate([*rng.integers(1, 600, 300), *rng.integers(1, 9000, 40), 4096, 8192, 1, 1, 1])]
    sequences, left = pack_lengths(items, final)
    sizes = [sum(x[2] for x in s) for s in sequences]
    assert all(n <= CONTEXT and n & (n - 1) == 0 for n in sizes) and (not final or not left)
    spans = sorted([x for s in sequences for x in s] + [(d, s, n) for n, d, s in left])
    for d, own in itertools.groupby(spans, key=lambda x: x[0]):
        at = 0
        for _, s, n in own:
            assert s == at and n > 0
            at += n
        assert at == items[d][0]


def test_step_groups_hold_one_tier_and_balance():
    from tidewake.llm.packing import STEP, step_groups, tier_of

    rng = np.random.default_rng(6)
    sequences = [[(0, 0, int(n))] if rng.random() < 0.5 else [(0, 0, int(n) // 2), (1, 0, int(n) - int(n) // 2)] for n in rng.choice([512, 1024, 2048, 4096], 400)]
    groups = step_groups(sequences)
    for g in set(groups.tolist()):
        own = [sequences[i] for i in np.flatnonzero(groups == g)]
        assert len(own) <= STEP and len({tier_of(sum(x[2] for x in s)) for s in own}) == 1
    whole = {}
    for g in set(groups.tolist()):
        own = [sequences[i] for i in np.flatnonzero(groups == g)]
        if len(own) == STEP:
            whole.setdefault(sum(x[2] for x in own[0]), []).append(sum(x[2] ** 2 for s in own for x in s))
    assert all(max(c) <= 1.3 * min(c) for c in whole.values() if c)


def test_odd_texts_have_the_library_s_ids():
    from tokenizers import Tokenizer

    from tidewake.llm.encoders import WordEncoder

    rng = np.random.default_rng(7)
    bits = ["İ!", "é", "É.", "ß?", "the", "The.", "\n", "\n\n", " ", "  ", "\t", "<|endoftext|>", "can't", "I'LL!", "ŉ.", "á.", "日本", "x1.", "1.", "%%%", "ǅ.", "ſ.", "K.", "\x1c", "🙂", "ͅ!", "Σ.", "|", "-", "a" * 300]
    texts = ["".join(bits[int(rng.integers(len(bits)))] + " " * int(rng.random() < 0.5) for _ in range(int(rng.integers(0, 14)))) for _ in range(3000)]
    for name, kind in (("byte_bpe_50k.json", "space-led"), ("word_bpe_49k.json", "word")):
        path = public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        for t, got in zip(texts, WordEncoder(path, kind).encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_store_is_bounded_in_bytes(monkeypatch):
    from tidewake.llm import encoders

    monkeypatch.setattr(encoders, "KEEP_BYTES", 100_000)
    coder = encoders.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), "word")
    for k in range(20):
        coder.encode([" ".join(f"w{k}x{i}" for i in range(500)) + " " + "long" * 5000])
        assert coder.used < 100_000 + 500 * 300 and max(map(len, coder.store)) <= encoders.LONGEST
