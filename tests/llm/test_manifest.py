"""The Merkle manifest against a plain loop and against SQL."""

import hashlib
import zlib

import pytest
from oracle import differences
from pyspark.sql import functions as F

from tidewake.llm.manifest import MANIFEST_SQL, manifest, manifest_report

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, lower=False):
    text = r[1].translate({c: c + 32 for c in range(65, 91)}) if lower and r[1] is not None else r[1]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(levels, i):
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        yield run[: i % 8], run[i % 8 + 1 :]
        i //= 8


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        mine = sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = mine, levels_of([leaf(r) for r in mine])
    top = levels_of([trees[x][1][-1][0] for x in langs])
    for k, x in enumerate(langs):
        mine, levels = trees[x]
        for i, r in enumerate(mine):
            path = [*way(levels, i), *way(top, k)]
            h = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for before, after in path:
                h = digest(*before, h, *after)
            yield (r[0], leaf(r), levels[-1][0], top[-1][0], digest(*[s for b, a in path for s in (*b, *a)]), h, h == top[-1][0])


def same(spark, rows):
    got = manifest_report(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected(rows)))


@pytest.mark.parametrize("n", [1, 9, 65, 513])
def test_trees_of_many_sizes(spark, n):
    rows = [(i * 3, f"Text {i} É" * (i % 4), "en", f"s{i % 5}", i) for i in range(n)]
    assert same(spark, rows)


def test_odd_rows(spark):
    rows = [(None, "A", "en", None, None), (None, None, None, None, None), (5, "Twice", "en", "s", 1), (5, "Twice", "en", "s", 1), (5, "Once", "en", "s", 1), (6, "", "de", "", 0), (7, "x" * 300_000 + "Q", "zz", "s", 2), (-8, "B" * 9, "", "s", None), (9, "é", "É", "s", 3)]
    rows += [(100 + i, f"T{i}", f"l{i}", "s", i) for i in range(12)]
    assert same(spark, rows)
    assert manifest_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_columns_stay_out(spark):
    docs = spark.createDataFrame([(i, "Ab", "en", "s", 2, 1, "x", "y") for i in range(20)], f"{SCHEMA}, pos long, h string, leaf string")
    plain = manifest_report(docs.select("doc_id", "text", "lang", "source", "n_chars")).collect()
    assert sorted(map(tuple, manifest_report(docs).collect())) == sorted(map(tuple, plain))


def test_a_changed_row_is_found(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    met = {i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 0}
    assert {r.doc_id for r in manifest_report(docs).where("not verified").collect()} == met
    assert {len(r.path) for r in manifest(docs).collect()} == {3}


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(manifest_report(spark.read.parquet(f"{sf}/documents.parquet")), MANIFEST_SQL, sf) == []
