"""Recall where the index prunes and lengths differ; ties, clashes and odd rows."""

import numpy as np


def test_recall_with_lengths_of_many_sizes(spark):
    from tidewake.llm.ann import nearest

    rng = np.random.default_rng(1)
    m = rng.normal(size=(9000, 64))
    m *= np.exp(rng.normal(0, 0.7, (len(m), 1))) / np.linalg.norm(m, axis=1, keepdims=True)
    got = nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>"), query_modulus=200).collect()
    hits = 0
    for q in range(0, 9000, 200):
        score = m @ m[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.9 * 20 * 45


def test_copies_tie_by_id_and_few_rows_give_all(spark):
    from tidewake.llm.ann import nearest

    rows = [(i, [1.0, 2.0] if i < 6 else [2.0, 1.0], "x") for i in (0, 1, 2, 3, 20, 40)] + [(60, [float("inf"), 1.0], "y"), (80, [None, 1.0], "z"), (100, [1.0, 2.0, 3.0], "w"), (0, [1.0, 2.0], "again")]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")).collect())
    assert [g for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 20), (0, 5, 40)]
    assert [g[2] for g in got if g[0] == 20] == [40, 0, 1, 2, 3] and {g[0] for g in got} == {0, 20, 40}


def test_footrule_sums_and_the_largest_by_plain_loops():
    from tidewake.llm.ann import gained, largest, permutations, posted

    rng = np.random.default_rng(2)
    for prefix in (1, 7, 12):
        m, pivots = rng.normal(size=(50, 6)), rng.normal(size=(12, 6))
        perm, own = permutations(m, pivots, prefix), permutations(rng.normal(size=(1, 6)), pivots, prefix)[0]
        want = [sum(2 * prefix - 2 * max(at, row.tolist().index(p)) for at, p in enumerate(own.tolist()) if p in row.tolist()) for row in perm]
        gain = gained(posted(perm, len(pivots)), own)
        assert gain.tolist() == want
        for weight in (gain * 1.0, gain * rng.random(50)):
            for n in (1, 20, 49, 50, 80):
                assert largest(weight, n).tolist() == sorted(np.argsort(-weight, kind="stable")[:n].tolist())
