"""The training-data operators against brute force, libraries and exact round trips, on small tables with awkward rows."""

import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i}" for i in range(6000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    "The quick brown fox jumps over the lazy dog again and again.", "the quick brown fox jumps over the lazy dog again and again.", "The quick brown fox jumps over the lazy dog again and again today.",
    "", None, "one", "one", "  two   spaces \n\n and\ttabs  ", "é日本 🙂 <|endoftext|> mark▁inside", LONG, LONG, LONG + " tail", "head a b c " + PASSAGE + " x y z", "other " + PASSAGE + " end", "you idiot " * 5,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def _ids(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in TEXTS]


def test_token_files_round_trip(docs, empty):
    from tidewake.llm.token_files import token_file_report

    path, start = public_tokenizers.path("byte_bpe_50k.json"), 0
    got = sorted(token_file_report(docs, path).collect(), key=lambda r: r.doc_id)
    for r, want in zip(got, _ids("byte_bpe_50k.json"), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert token_file_report(empty, path).count() == 0


def test_packing_covers_each_id_once(docs, empty):
    from tidewake.llm.packing import packing_report

    path = public_tokenizers.path("word_bpe_49k.json")
    rows, want = packing_report(docs, path).collect(), _ids("word_bpe_49k.json")
    for d, w in enumerate(want):
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
        assert sum(r.length for r in own) == len(w) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(w[r.start : r.start + r.length].tobytes()) for r in own)
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in g:
            assert r.offset == at
            at += r.length
        assert at & (at - 1) == 0 and at <= 4096
    assert packing_report(empty, path).count() == 0


def test_media_payloads(docs, empty, spark):
    import hashlib

    from tidewake.llm.media import media_report, payload_of

    extra = docs.unionByName(docs.where("doc_id < 3")).withColumn("payload_bytes", docs.n_chars)
    rows = media_report(extra).collect()
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(TEXTS) and len(rows) == extra.count()
    for d, t in enumerate(TEXTS):
        p, n = payload_of(t)
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256) == (n, len(p), hashlib.sha256(p).hexdigest())
        assert got[d].tail_crc32 == zlib.crc32(p[-16:]) and len(p) % 192 == 0
    assert got[9].media_sha256 == got[10].media_sha256
    assert media_report(empty).count() == 0


def test_media_rows_chunks_and_features(spark):
    """No row is lost; shared chunks are kept once and payloads still read back whole; features by plain loops."""
    import hashlib

    from tidewake.llm.common import identified_rows, stored
    from tidewake.llm.media import FRAME, LARGEST, LEAST, cut_points, media_report, payload_of, store_media

    rng = np.random.default_rng(3)
    block = bytes(rng.integers(97, 122, 60_000).astype(np.uint8)).decode()
    texts = [(1, block), (1, block + " changed"), (None, "no id"), (None, None), (2, "head " + block), (3, block), (4, "a"), (5, "a "), (6, "x" * 90_000), (None, block)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, seq int").repartition(3)
    got = media_report(docs).collect()
    want = []
    for i, t in texts:
        p, n = payload_of(t)
        x = np.frombuffer(p, np.uint8).astype(float)
        blank = np.mean([set(p[k : k + FRAME]) == {32} for k in range(0, len(p), FRAME)])
        feature = f"mean={sum(x) / len(x):.4f};rms={np.sqrt(sum(x * x) / len(x)):.4f};step={np.abs(x[1:] - x[:-1]).mean():.4f};blank={blank:.4f}"
        cut = [0, *cut_points([p])[0]]
        assert cut[-1] == len(p) and all(LEAST <= b - a <= LARGEST for a, b in zip(cut[:-2], cut[1:-1], strict=True))
        recipe = b"".join(hashlib.sha256(p[a:b]).digest() + (b - a).to_bytes(4, "little") for a, b in zip(cut[:-1], cut[1:], strict=True))
        want.append((i or -1, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(recipe) + len(p), hashlib.sha256(recipe + p).hexdigest(), feature))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got) == sorted(want)
    store, _, _ = store_media(stored(identified_rows(docs)[0], "rows"))
    assert sum(len(r.data) for r in store.collect()) < 60_000 + 90_000 + 3 * LARGEST


def test_pieces_equal_the_library(docs, empty):
    import sentencepiece

    from tidewake.llm.pieces import encode_pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in encode_pieces(docs, path).collect():
        text = TEXTS[r.doc_id] or ""
        assert np.frombuffer(r.piece_ids, "<u4").tolist() == lib.encode(text)
        assert r.decoded == text.replace("▁", " ")
    assert encode_pieces(empty, path).count() == 0


def test_trie_counts_equal_plain_dynamic_programming(docs, empty):
    import sentencepiece

    from tidewake.llm.piece_counts import _pretokens, token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = {lib.id_to_piece(i): lib.get_score(i) for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
    worst = min(plain.values()) - 10

    def count(w):
        best = [(0.0, 0)] + [(-np.inf, 0)] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(e - 1, max(-1, e - 17), -1):
                score, n = plain.get(w[s:e]), 1
                if score is None and e - s == 1:
                    score, n = worst, len(w[s:e].encode())
                if score is not None and best[s][0] + score >= best[e][0]:
                    best[e] = (best[s][0] + score, best[s][1] + n)
        return best[-1][1]

    for r in token_counts(docs, path).collect():
        assert r.n_tokens == sum(map(count, _pretokens(TEXTS[r.doc_id] or "")))
    assert token_counts(empty, path).count() == 0


def test_jaccard_links_equal_all_pairs(docs, empty):
    from tidewake.llm.jaccard import jaccard_components

    sets = []
    for t in TEXTS:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [{b for b in range(len(sets)) if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])} for a in range(len(sets))]
    root = list(range(len(sets)))
    for _ in sets:
        root = [min([root[a], *[root[b] for b in links[a]]]) for a in range(len(sets))]
    for r in jaccard_components(docs).collect():
        assert (r.n_shingles, r.component_id, r.n_links) == (len(sets[r.doc_id]), root[r.doc_id], len(links[r.doc_id]))
    assert jaccard_components(empty).count() == 0


def test_repeated_passages_are_found_and_cut(docs, empty):
    from tidewake.llm.passages import cut_repeats, repeated_passages

    found = {(r.doc_id, r.source_doc_id): r for r in repeated_passages(docs).collect()}
    assert set(found) == {(10, 9), (11, 9), (13, 12)}
    assert (found[13, 12].start_word, found[13, 12].end_word) == (1, 61)
    cut = {r.doc_id: r for r in cut_repeats(docs).collect()}
    assert cut[13].text == "other end" and cut[11].text == "tail" and cut[10].text == "" and cut[12].text == TEXTS[12]
    assert cut[4].text is None and len(cut) == len(TEXTS)
    assert repeated_passages(empty).count() == 0


@pytest.mark.parametrize(("size", "between"), [(300, 400), (300, 150), (60, 100), (60, 180)])
def test_own_words_between_passages_part_them(spark, size, between):
    from tidewake.llm.passages import cut_repeats, repeated_passages

    run = lambda s, n: [f"{s}{i}" for i in range(n)]
    texts = [" ".join([*run(f"h{d}", 20), *run("p", size), *run(f"m{d}", between), *run("q", size), *run(f"t{d}", 20)]) for d in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r.doc_id, r.start_word, r.end_word, r.source_doc_id, r.source_start, r.source_end) for r in repeated_passages(docs).collect())
    spans = [(20, 20 + size), (20 + size + between, 20 + 2 * size + between)]
    assert found == [(1, s, e, 0, s, e) for s, e in spans]
    assert {r.doc_id: r.text for r in cut_repeats(docs).collect()}[1].split() == [*run("h1", 20), *run("m1", between), *run("t1", 20)]


def test_passage_whose_parts_occur_first_elsewhere(spark):
    from tidewake.llm.passages import repeated_passages

    run = lambda s, a, b: [f"{s}{i}" for i in range(a, b)]
    parts = {d: run("p", a, b) for d, a, b in ((3, 0, 30), (4, 15, 45), (5, 30, 60), (10, 0, 60), (12, 0, 45), (20, 0, 60))}
    texts = {d: " ".join([*run(f"h{d}", 0, 40), *w, *run(f"t{d}", 0, 40)]) for d, w in parts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = [(r.doc_id, r.start_word, r.end_word, r.source_doc_id, r.source_start, r.source_end, r.identity) for r in repeated_passages(docs).collect()]
    assert found == [(20, 40, 100, 10, 40, 100, 1.0)]


def test_fuzzy_passages_are_found(spark):
    from tidewake.llm.passages import repeated_passages

    run = lambda s, n: [f"{s}{i}" for i in range(n)]
    rng, rows, want = np.random.default_rng(0), [], set()
    for k in range(60):
        p, size = run(f"p{k}x", 120), 60 if k % 2 else 120
        every, share = ((8, 0), (0, 0.1), (0, 0.15))[k % 3]
        q = [f"z{k}x{i}" if (i % every == 3 if every else rng.random() < share) else w for i, w in enumerate(p[:size])]
        rows += [(k, " ".join([*run(f"a{k}x", 50), *p[:size], *run(f"b{k}x", 50)])), (100 + k, " ".join([*run(f"c{k}x", 40), *q, *run(f"d{k}x", 50)]))]
        want.add((100 + k, k))
    found = {(r.doc_id, r.source_doc_id): r for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) <= want and len(found) >= 57
    assert all(35 <= r.start_word and r.end_word <= 165 and r.identity >= 0.75 for r in found.values())


def test_toxicity_learns_labels(spark, empty):
    from tidewake.llm.toxicity import drop_toxic, score_toxicity

    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*rng.choice(words, 40), *(["idiot", "scum"] if i % 7 == 0 else [])])) for i in range(600)]
    docs = spark.createDataFrame([*rows, (600, None), (601, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, 1, int(i % 7 == 0)) for i in range(300)], (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in score_toxicity(docs, labels).collect()}
    assert np.mean([got[i] == (i % 7 == 0) for i in range(300, 600)]) > 0.98
    kept = {r.doc_id for r in drop_toxic(docs, labels).collect()}
    assert {600, 601} <= kept and 7 not in kept
    assert score_toxicity(empty, labels).count() == 0 and not any(r.toxic for r in score_toxicity(docs, labels.limit(0)).collect())


def test_language_model_base_and_held_out(spark, empty):
    from tidewake.llm.language_model import score_documents

    rng = np.random.default_rng(0)
    sides = [[f"{s}{i}{s}" for i in range(30)] for s in "ab"]
    rows = [(i, " ".join(rng.choice(sides[i % 2], 40))) for i in range(300)] + [(300, None), (301, "")]
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r.held_out and r.n_tokens > 1]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    words = {i: [*(t or "").split(), "\0"] for i, t in rows}
    train = [w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws]
    counts = {w: train.count(w) for w in set(train)}
    for r in got:
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (len(train) + 0.1 * (len(counts) + 1))) for w in words[r.doc_id])
        assert r.train_tokens == len(train) and np.isclose(r.base_score, base)
    assert score_documents(empty).count() == 0


def test_nearest_recall(spark):
    from tidewake.llm.ann import nearest

    rng = np.random.default_rng(0)
    m = rng.normal(size=(800, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (None, m[0].tolist())]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    hits = 0
    for q in range(0, 800, 20):
        score = m @ m[q]
        score[q] = -np.inf
        want = set(np.argsort(-score)[:20].tolist())
        hits += len(want & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.9 * 20 * 40 and len(got) == 800
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_nearest_recall_in_a_full_block(spark):
    from tidewake.llm.ann import nearest

    m = np.random.default_rng(0).normal(size=(8192, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>"), query_modulus=128).collect()
    hits = 0
    for q in range(0, 8192, 128):
        score = m @ m[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    print("recall", hits / (20 * 64))
    assert hits >= 0.95 * 20 * 64


def test_pipeline_runs(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "substring_dedup", "packing"]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
