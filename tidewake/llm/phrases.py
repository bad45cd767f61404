"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it, and counters merge elementwise.

Level m reads all texts for phrases of m words: a task adds up a stripe for each
prefix of m - 1 words, stripes of one prefix meet in one partition and are merged
word by word, and a merged stripe gives the phrases that extend the prefix, its
total, and how far its commonest extension subsumes it. Only places whose first and
last m - 1 words are both frequent phrases are counted, told by a bit filter of
fixed size: a bit set by chance costs a counter, never a result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, only, sized, small_batches, stored

#: Occurrences that make a phrase a candidate, and the most words of one.
LEAST = 100
LONGEST = 5
#: Phrases reported for each language.
TOP = 2000
#: Bits of the filter of frequent phrases; its 8 MB are all that a level broadcasts.
FILTER_BITS = 26
#: A prefix with this share of all words has its stripe split in ``SEGMENTS`` by the next word; at most the inverse of it are.
HOT_SHARE = 1e-4
SEGMENTS = 64
#: Shelves that stripes are moved by, at least.
SHELVES = 256
#: Entries that a task holds before it adds them up, or hands them on.
HELD = 1 << 20

_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ENDS = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
_GAPS = np.isin(np.arange(256), [0x20, 0x09]) | _ENDS
_CODE = mix64((np.arange(256) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _FOLD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of a phrase and a word after it."""
    with np.errstate(over="ignore"):
        return mix64(a * _FOLD + b)


class Words:
    """The words of many texts: key (of language and word, never 0), piece, and place in the lower-cased bytes."""

    def __init__(self, texts: list[str | None], langs: list[str]):
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
        self.data = b"\n".join([*raw, b""]).translate(_TO_LOWER)
        data = np.frombuffer(self.data, np.uint8)
        word = ~_GAPS[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        inside = np.flatnonzero(word)
        at = np.cumsum(first[inside]) - 1
        offset = inside - self.start[at] if len(inside) else inside
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(offset.max(initial=0)), _BASE)]), dtype=np.uint64)
            value = _CODE[data[inside]] * power[offset]
            h = mix64(np.add.reduceat(value, np.flatnonzero(first[inside]))) if len(inside) else np.empty(0, np.uint64)
        ends = np.cumsum([len(x) + 1 for x in raw])
        self.doc = np.searchsorted(ends, self.start, "right")
        tongue = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) << 32 | zlib.adler32(x.encode("utf-8", "surrogatepass")) for x in langs], np.uint64)
        self.key = np.maximum(mix64(h ^ mix64(tongue)[self.doc]), np.uint64(1)) if len(h) else h
        self.piece = np.cumsum(_ENDS[data])[self.start] if len(h) else self.start

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(key of the k words from each word on, whether they lie in one piece), for all starts that k words follow."""
        n = max(0, len(self.key) - k + 1)
        keys = self.key[:n]
        for j in range(1, k):
            keys = _fold(keys, self.key[j : j + n])
        return keys, self.piece[:n] == self.piece[k - 1 : k - 1 + n]


def _held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _add_up(parts: list[np.ndarray]) -> list[np.ndarray]:
    """One column (prefix, next word, suffix, count) for each prefix and next word."""
    rows = np.concatenate(parts, axis=1)
    if not rows.shape[1]:
        return [rows]
    rows = rows[:, np.argsort(_fold(rows[0], rows[1]))]
    begin = np.flatnonzero(np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]))
    return [np.vstack([rows[:3, begin], np.add.reduceat(rows[3], begin)])]


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, key, word, f): each word of each language with its occurrences; stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).to_pylist()
            w = Words(b.column(1).to_pylist(), langs)
            keys, at, n = np.unique(w.key, return_index=True, return_counts=True)
            words = [w.data[s:e].decode("utf-8", "surrogatepass") for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([langs[d] for d in w.doc[at].tolist()], pa.string()), pa.array(keys.view(np.int64)), pa.array(words, pa.string()), pa.array(n)], names=["lang", "key", "word", "n"])

    found = docs.mapInArrow(count, "lang string, key long, word string, n long").groupBy("lang", "key", "word").agg(F.sum("n").alias("f"))
    return stored(found, "words")


def _distinct(rows: DataFrame) -> DataFrame:
    """``rows`` (stored), unless two words or phrases of them share a key that is frequent: then the counts can't be trusted."""
    alike = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("f").alias("f")).where(F.expr(f"n > 1 and f >= {LEAST}"))
    if not alike.isEmpty():
        raise ValueError(f"two words or phrases share the key {alike.first().key}")
    return rows


def merged_stripes(docs: DataFrame, m: int, bits: np.ndarray, hot: np.ndarray, words: int) -> DataFrame:
    """(p, total, next): the merged stripes of prefixes of m - 1 words; next has (x, q, s, n), the frequent next words with the keys of phrase and suffix.

    A stripe's entry 0 counts the places where nothing frequent follows, so
    ``total`` is the prefix's own number of occurrences. The stripe of a hot
    prefix comes in segments of next words, each merged and totalled alone. Stripes
    move by the shelf, some thousands of one hash together; there are as many
    shelves as keep the places of one in memory.
    """
    spark = docs.sparkSession
    shared, shelves = spark.sparkContext.broadcast((bits, hot)), max(SHELVES, words // HELD)

    def stripe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value

        def rows(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            (found,) = _add_up(parts)
            seg = np.where(np.isin(found[0], hot), found[1] % np.uint64(SEGMENTS), np.uint64(0))
            home = (_fold(found[0], seg) % np.uint64(shelves)).astype(np.int64)
            order = np.lexsort((found[0], home))
            home, found = home[order], found[:, order]
            begin = np.append(np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else [], len(home)).astype(np.int64)
            for i in range(0, len(begin) - 1, 64):  # column by column and in order of prefixes, which packs well
                some = begin[i : i + 65].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(home[some[:-1]]), pa.array([found[:, a:b].tobytes() for a, b in zip(some, some[1:], strict=False)], pa.binary())], names=["shelf", "entries"])

        parts, size = [np.empty((4, 0), np.uint64)], 0
        for b in batches:
            w = Words(b.column(1).to_pylist(), b.column(0).to_pylist())
            keys, whole = w.phrases(m - 1)
            good = whole & _held(bits, keys)
            at = np.flatnonzero(good)
            after = np.zeros(len(keys), bool)
            after[:-1] = good[1:] & (w.piece[1 : len(keys)] == w.piece[: len(keys) - 1]) if len(keys) else good[1:]
            follows = after[at]
            there = np.minimum(at + m - 1, len(w.key) - 1)
            parts.append(np.vstack([keys[at], np.where(follows, w.key[there], np.uint64(0)), np.where(follows, keys[np.minimum(at + 1, len(keys) - 1)], np.uint64(0)), np.ones(len(at), np.uint64)]))
            size += len(at)
            if size > HELD:
                parts = _add_up(parts)
                size = parts[0].shape[1]
                if size > HELD // 2:
                    yield from rows(parts)
                    parts, size = [parts[0][:, :0]], 0
        yield from rows(parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [np.empty((4, 0), np.uint64)], 0

        def out(rows: np.ndarray) -> pa.RecordBatch:
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            begin = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
            keep = (rows[1] > 0) & (rows[3] >= LEAST)
            offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(keep, begin))]).astype(np.int32)
            p, x, s, n = rows[:, keep]
            each = pa.StructArray.from_arrays([pa.array(c.view(np.int64)) for c in (x, _fold(p, x), s, n)], ["x", "q", "s", "n"])
            return pa.RecordBatch.from_arrays([pa.array(rows[0, begin].view(np.int64)), pa.array(np.add.reduceat(rows[3], begin).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), each)], names=["p", "total", "next"])

        now = None
        for b in batches:
            for shelf, entries in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if shelf != now and size:
                    yield out(_add_up(parts)[0])
                    parts, size = [parts[0][:, :0]], 0
                now = shelf
                parts.append(np.frombuffer(entries.as_buffer(), np.uint64).reshape(4, -1))
                size += parts[-1].shape[1]
                if size > 2 * max(HELD, parts[0].shape[1]):
                    parts = _add_up(parts)
                    size = parts[0].shape[1]
        if size:
            yield out(_add_up(parts)[0])

    found = docs.mapInArrow(stripe, "shelf long, entries binary").repartition("shelf").sortWithinPartitions("shelf")
    found = stored(found.mapInArrow(merge, "p long, total long, next array<struct<x:long,q:long,s:long,n:long>>"), f"stripes-{m}")
    shared.unpersist()
    return found


def _filter_of(keys: DataFrame) -> np.ndarray:
    """The bit filter of the column ``key``: bits are put together in Spark, so at most 2**20 words of 64 of them come to the driver."""
    words = keys.select(F.expr(f"key & {(1 << FILTER_BITS) - 1}").alias("b")).groupBy(F.expr("b >> 6").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[np.array(words["w"])] = np.array(words["bits"])
    return out.view(np.uint8)


def _hot_of(keys: DataFrame, words: int) -> np.ndarray:
    """The keys with ``HOT_SHARE`` of all words or more."""
    return np.sort(np.array([r.key for r in keys.where(F.col("f") >= max(LEAST, int(words * HOT_SHARE))).select("key").collect()], np.int64).view(np.uint64))


def candidates(docs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(tables of frequent phrases of 1, 2, ... words, n of each lang).

    A table has lang, key, phrase, last (word), f, firsts and lasts (occurrences
    of its first and last 1, 2, ... words), p and s (keys of its prefix and
    suffix). Both parts of a frequent phrase are frequent, so a level finds them in
    the table before it.
    """
    docs = only(docs, "lang", "text").withColumn("lang", F.coalesce("lang", F.lit("und")))
    small_batches(docs.sparkSession, 1024, "2m")
    words = _distinct(count_words(docs))
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "langs")
    none = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("long")
    levels = [stored(words.where(F.col("f") >= LEAST).select("lang", "key", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("firsts"), none.alias("lasts"), zero.alias("p"), zero.alias("s")), "phrases-1")]
    every = totals.agg(F.sum("n")).first()[0] or 0
    for m in range(2, LONGEST + 1):
        before = levels[-1]
        if before.isEmpty():
            break
        stripes = merged_stripes(docs, m, _filter_of(before), _hot_of(before, every), every)
        whole = stripes.groupBy("p").agg(F.sum("total").alias("total"))
        found = stripes.select("p", F.explode("next").alias("e")).select("p", F.col("e.q").alias("key"), F.col("e.s").alias("s"), F.col("e.n").alias("f"))
        first = before.join(whole, before["key"] == whole["p"]).select(before["key"].alias("p"), "lang", "phrase", F.concat("firsts", F.array("total")).alias("firsts"))
        last = before.select(F.col("key").alias("s"), "last", F.concat("lasts", F.array("f")).alias("lasts"))
        found = found.join(sized(first, "200"), "p").join(sized(last, "160"), "s")
        found = found.select("lang", "key", F.concat("phrase", F.lit(" "), "last").alias("phrase"), "last", "f", "firsts", "lasts", "p", "s")
        levels.append(_distinct(stored(found, f"phrases-{m}")))
    return levels, totals


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of 2 to 5 words of each language (null: ``und``).

    A phrase has a occurrences, 100 at least, and is cut into the two parts, of l
    and r occurrences, whose score 1000 * a * n // (l * r) is lowest (ties: the
    shorter first part). Phrases that lie in a longer candidate just as frequent go.
    Order: score, a, both descending, phrase. Null and empty texts have no words;
    rows count as often as they stand; other columns take no part; a language
    without such phrases, or an empty table, gives no rows. Two words or phrases
    that share a 64-bit key where either is frequent stop the query with an error.
    """
    levels, totals = candidates(docs)
    kept = None
    for m, rows in enumerate(levels[1:], 2):
        if m < len(levels):
            longer = levels[m].select("f", F.explode(F.array("p", "s")).alias("key")).groupBy("key").agg(F.max("f").alias("covered"))
            rows = rows.join(sized(stored(longer, "covered"), "24"), "key", "left").where("covered is null or covered < f").drop("covered")
        kept = rows if kept is None else kept.unionByName(rows)
    if kept is None:
        return levels[0].select("lang", F.lit(0).alias("rank"), "phrase", *[F.col("f").alias(c) for c in ("a", "l", "r", "n", "score")]).limit(0)
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = f"cast((1000 * ({wide('f')} * {wide('n')})) div ({wide('firsts[k - 1]')} * {wide('lasts[size(lasts) - k]')}) as bigint)"
    cut = F.expr(f"array_min(transform(sequence(1, size(firsts)), k -> struct({score} as score, k, firsts[k - 1] as l, lasts[size(lasts) - k] as r)))")
    rated = kept.join(sized(totals, "64"), "lang").select("lang", "phrase", F.col("f").alias("a"), "n", cut.alias("cut"))
    rated = rated.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rated.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows by DuckDB, every phrase counted.
COLLOCATIONS_SQL = """WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM runs, range(1, 6) r(k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, a.f AS l, b.f AS r, n.n, 1000::HUGEINT * c.f * n.n // (a.f::HUGEINT * b.f) AS score, c.cut FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c JOIN n USING (lang)
  JOIN f a ON a.lang = c.lang AND a.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f b ON b.lang = c.lang AND b.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM cuts) WHERE o = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.lang = b.lang AND c.f = b.a AND len(c.phrase) > len(b.phrase) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept) WHERE rank <= 2000"""
