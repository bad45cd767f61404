"""Merkle manifest of a dataset: digests of rows, rolled up eight by eight into nested structs, and proofs out of them.

A row's place in its group gives its base-8 digits. Grouping the digits away one
after another, lowest first, nests the children of each node in a struct beside
its digest, so a block of 512 rows becomes one nested row; the tree above blocks
is rolled up in the same way, block by block. Going down again, each level is one
``transform`` that puts a child's siblings beside it and one ``explode``: within
a block no join is needed, and a block itself gets its way to the root by its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, sized, stored

#: Nodes that one digest covers.
ARITY = 8
#: Levels that a block nests: 512 rows or nodes in one struct at most.
LEVELS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def _field(c: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a dash."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, changed, row): each row's digest, and that of its tampered form where tampering meets it (else null).

    Texts are read once, here; what follows moves digests alone. ``row`` tells equal rows apart.
    """
    docs = only(docs, "doc_id", "source", "lang", "n_chars", "text")
    plain = [_field(F.col(c).cast("string")) for c in ("doc_id", "source", "lang", "n_chars")]
    of = lambda text: F.sha2(F.concat(*plain, _field(text)), 256)
    met = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & F.col("text").isNotNull()
    changed = F.when(met, of(F.translate("text", _UPPER, _LOWER)))
    return docs.select("doc_id", "lang", of(F.col("text")).alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("row"))


def ranked(rows: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, by ``order``) and ``total`` within each ``group`` (none: the whole table).

    Rows are dealt by ranges and numbered within a partition; a table of one row
    a partition and group holds what lies before. So no group meets one task.
    """
    keys = [group] if group else []
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    spans = dealt.groupBy(F.col("part").alias("part_"), *[F.col(k).alias("group_") for k in keys]).agg(F.min("at").alias("first_"), F.count("*").alias("n_"))
    mine = ["group_"] if group else []
    upto = Window.partitionBy(*mine).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before_", F.coalesce(F.sum("n_").over(upto), F.lit(0))).withColumn("total", F.sum("n_").over(Window.partitionBy(*mine)))
    same = F.col("part") == F.col("part_")
    if group:
        same &= F.col(group).eqNullSafe(F.col("group_"))
    placed = dealt.join(sized(stored(spans, "spans"), "64"), same)
    return placed.withColumn("pos", F.col("at") - F.col("first_") + F.col("before_")).drop("part", "at", "part_", "first_", "n_", "before_", *mine)


def _blocks(rows: DataFrame, level: int, payload: list[str]) -> DataFrame:
    """(key, total, block, h, kids): rows (key, total, pos, h, payload) at ``level`` of their trees, nested by blocks.

    The rows of a block are dealt together once; each further digit is grouped away
    in place. A node that is alone on its level is not digested again: it passes.
    """
    span = ARITY**LEVELS
    digit = lambda j: F.expr(f"pos div {ARITY**j} % {ARITY}").cast("int").alias(f"d{j}")
    rows = rows.select("key", "total", F.expr(f"pos div {span}").alias("block"), *[digit(j) for j in range(LEVELS)], "h", *payload).repartition("key", "block")
    held = ["h", *payload]
    for j in range(LEVELS):
        nested = F.sort_array(F.collect_list(F.struct(F.col(f"d{j}").alias("d"), *held))).alias("kids")
        rows = rows.groupBy("key", "total", "block", *[f"d{i}" for i in range(j + 1, LEVELS)]).agg(nested)
        alone = F.col("total") <= ARITY ** (level + j)
        rows = rows.withColumn("h", F.when(alone, F.col("kids")[0]["h"]).otherwise(_digest(F.col("kids.h"))))
        held = ["h", "kids"]
    return rows.select("key", "total", "block", "h", "kids")


def _opened(blocks: DataFrame, level: int, payload: list[str]) -> DataFrame:
    """The rows that ``_blocks`` nested, (key, pos, h, path, payload): each level puts a child's siblings before what its parent has in ``path``."""
    rows = blocks.select("key", "total", F.col("block").alias("pos"), "path", "kids")
    for j in reversed(range(LEVELS)):
        hs = F.col("kids.h")
        beside = lambda k, i: F.struct(k.alias("k"), F.array_join(F.slice(hs, F.lit(1), i), "").alias("before"), F.array_join(F.slice(hs, i + 2, F.lit(ARITY)), "").alias("after"))  # noqa: B023, E731
        rows = rows.select("key", "total", "pos", "path", F.explode(F.transform("kids", beside)).alias("x"))
        step = F.array(F.struct(F.col("x.before").alias("before"), F.col("x.after").alias("after")))
        path = F.when(F.col("total") > ARITY ** (level + j), F.concat(step, F.col("path"))).otherwise(F.col("path"))
        rows = rows.select("key", "total", (F.col("pos") * ARITY + F.col("x.k.d")).alias("pos"), path.alias("path"), *([F.col("x.k.kids").alias("kids")] if j else [F.col("x.k.h").alias("h"), *[F.col(f"x.k.{p}").alias(p) for p in payload]]))
    return rows


def tree_paths(rows: DataFrame, payload: list[str]) -> DataFrame:
    """(key, h, top, path, payload): ``top`` is the root of the key's tree and ``path`` the siblings before and after, level by level, from a row up to it.

    rows: (key, total, pos, h, payload). Each round takes ``LEVELS`` levels off
    all trees and leaves one row a block, so rounds grow with the logarithm of the
    largest tree. A block's own path comes down by its key: one row a block of 512.
    """
    largest = rows.agg(F.max("total")).first()[0] or 0
    tiers = [stored(_blocks(rows, 0, payload), "blocks")]
    while ARITY ** (LEVELS * len(tiers)) < largest:
        above = tiers[-1].select("key", "total", F.col("block").alias("pos"), "h")
        tiers.append(stored(_blocks(above, LEVELS * len(tiers), []), "blocks"))
    none = F.array().cast("array<struct<before:string,after:string>>")
    blocks = tiers[-1].select("*", F.col("h").alias("top"), none.alias("path"))
    tops = blocks.select(F.col("key").alias("key_"), "top")
    for t in reversed(range(len(tiers))):
        found = _opened(blocks, LEVELS * t, payload if t == 0 else [])
        if t:
            ways = stored(found.select(F.col("key").alias("key_"), F.col("pos").alias("pos_"), "path"), "paths")
            blocks = tiers[t - 1].join(sized(ways, "4096"), F.col("key").eqNullSafe(F.col("key_")) & (F.col("block") == F.col("pos_"))).drop("key_", "pos_")
    return found.join(sized(stored(tops, "tops"), "160"), F.col("key").eqNullSafe(F.col("key_"))).select("key", "h", "top", "path", *payload)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, changed, subroot, root, path): every row's digest, the roots above it, and its way to the last one.

    A tree for each lang over the rows by doc_id, and one over the langs' roots,
    null first. ``path`` has (before, after) for each level, the digests of the
    siblings on either side. Rows with null or repeated doc_id are leaves too:
    null before all ids, equal ids by leaf digest. A lone leaf is its lang's root, a
    lone lang's root the last one. Other columns take no part; an empty table
    gives no rows.
    """
    leaves = ranked(stored(leaf_rows(docs), "leaves"), "lang", ["doc_id", "leaf", "row"])
    below = tree_paths(leaves.select(F.col("lang").alias("key"), "total", "pos", F.col("leaf").alias("h"), "doc_id", "changed"), ["doc_id", "changed"])
    below = stored(below.select("doc_id", F.col("key").alias("lang"), F.col("h").alias("leaf"), "changed", F.col("top").alias("subroot"), "path"), "proofs")
    langs = ranked(below.groupBy("lang").agg(F.first("subroot").alias("h")), None, ["lang"])
    above = tree_paths(langs.select(F.lit(0).alias("key"), "total", "pos", "h", "lang"), ["lang"])
    above = stored(above.select(F.col("lang").alias("lang_"), F.col("top").alias("root"), F.col("path").alias("rest")), "langs")
    both = below.join(sized(above, "4096"), F.col("lang").eqNullSafe(F.col("lang_")))
    return both.select("doc_id", "lang", "leaf", "changed", "subroot", "root", F.concat("path", "rest").alias("path"))


def manifest_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf where there is one), verified.

    Cases are those of ``manifest``. A row without siblings on any level has the
    digest of nothing as its proof.
    """
    found = manifest(docs)
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("changed", "leaf"), lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))
    found = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same rows by DuckDB: recursive levels, crc32 bit by bit.
MANIFEST_SQL = """WITH RECURSIVE docs AS (SELECT doc_id, lang, text, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST) AS rid,
  coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
  list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, b: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
leaves AS (SELECT rid, doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(octet_length(encode(text)) || ':' || CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS changed,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total FROM docs),
levels AS (SELECT lang, 0 AS level, pos, total, leaf AS h FROM leaves
  UNION ALL SELECT lang, level + 1, pos // 8, (total + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM levels WHERE total > 1 GROUP BY lang, level, pos // 8, total),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM levels WHERE total = 1),
tops AS (SELECT 0 AS level, pos, total, subroot AS h FROM subroots UNION ALL SELECT level + 1, pos // 8, (total + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE total > 1 GROUP BY level, pos // 8, total),
steps AS (SELECT l.rid, v.level, coalesce(string_agg(v.h, '' ORDER BY v.pos) FILTER (v.pos < l.pos // (8 ** v.level)::BIGINT), '') AS before, coalesce(string_agg(v.h, '' ORDER BY v.pos) FILTER (v.pos > l.pos // (8 ** v.level)::BIGINT), '') AS after
  FROM leaves l JOIN levels v ON l.lang IS NOT DISTINCT FROM v.lang AND v.total > 1 AND v.pos // 8 = l.pos // (8 ** (v.level + 1))::BIGINT GROUP BY l.rid, l.pos, v.level),
top_steps AS (SELECT s.lang, 1000 + v.level AS level, coalesce(string_agg(v.h, '' ORDER BY v.pos) FILTER (v.pos < s.pos // (8 ** v.level)::BIGINT), '') AS before, coalesce(string_agg(v.h, '' ORDER BY v.pos) FILTER (v.pos > s.pos // (8 ** v.level)::BIGINT), '') AS after
  FROM subroots s JOIN tops v ON v.total > 1 AND v.pos // 8 = s.pos // (8 ** (v.level + 1))::BIGINT GROUP BY s.lang, s.pos, v.level),
ways AS (SELECT rid, string_agg(before || after, '' ORDER BY level) AS proof, list({'b': before, 'a': after} ORDER BY level) AS path
  FROM (SELECT * FROM steps UNION ALL SELECT l.rid, t.level, t.before, t.after FROM leaves l JOIN top_steps t ON l.lang IS NOT DISTINCT FROM t.lang) GROUP BY rid),
folds AS (SELECT l.rid, 0 AS i, l.changed AS h, path FROM leaves l LEFT JOIN ways USING (rid) UNION ALL SELECT rid, i + 1, sha256(path[i + 1].b || h || path[i + 1].a), path FROM folds WHERE i < len(path))
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(coalesce(w.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN tops r ON r.total = 1 LEFT JOIN ways w USING (rid) JOIN folds f ON f.rid = l.rid AND f.i = coalesce(len(f.path), 0)"""
