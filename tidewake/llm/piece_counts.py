"""Token counts by unigram forward scores over a trie of distinct pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64, only, small_batches

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Pre-tokens kept with their counts by a worker.
KEEP = 600_000
_loaded: dict[str, "UnigramTrie"] = {}


class UnigramTrie:
    """Pieces of a vocabulary file with their scores, and the forward pass over a trie of pre-tokens.

    The score of a segmentation is the sum of its pieces' scores in the file; a
    character that no piece is costs ten more than the worst piece and becomes
    its UTF-8 bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        table: dict[int, list[tuple[int, float]]] = {}
        worst = 0.0
        for i in range(lib.get_piece_size()):
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)):
                p = lib.id_to_piece(i)
                worst = min(worst, lib.get_score(i))
                table.setdefault(len(p), []).append((int(self._hashes([p])[0]), lib.get_score(i)))
        self.unknown = worst - 10
        self.tables = {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([s for _, s in sorted(x)])) for n, x in table.items()}
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(self.tables), _BASE)]), dtype=np.uint64)
        self.known: dict[str, int] = {}

    @staticmethod
    def _codes(points: np.ndarray) -> np.ndarray:
        return mix64(points.astype(np.uint64) + np.uint64(1))

    def _hashes(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        with np.errstate(over="ignore"):
            for k, w in enumerate(words):
                for c in self._codes(np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4")):
                    out[k] = out[k] * _BASE + c
        return out

    def forward(self, words: list[str]) -> np.ndarray:
        """Pieces in the best segmentation of each word.

        The trie is built level by level from the sorted words: a node of depth
        d is a distinct prefix of d characters, so each shared prefix is scored
        once, from its ancestors up to the longest piece above it.
        """
        counts = np.zeros(len(words), np.int64)
        order = sorted(range(len(words)), key=words.__getitem__)
        lengths = np.array([len(words[i]) for i in order])
        if not len(lengths):
            return counts
        flat = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le", "surrogatepass"), "<u4")
        begin = np.cumsum(lengths) - lengths
        node = np.zeros(len(order), np.int64)  # of each word at the depth before
        hashes, scores, pieces, up = [np.zeros(1, np.uint64)], [np.zeros(1)], [np.zeros(1, np.int64)], []
        alive = np.arange(len(order))
        for depth in range(1, int(lengths.max()) + 1):
            alive = alive[lengths[alive] >= depth]
            char = flat[begin[alive] + depth - 1]
            parent = node[alive]
            new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (char[1:] != char[:-1])])
            node[alive] = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            up.append(parent[first])
            c = char[first]
            with np.errstate(over="ignore"):
                hashes.append(hashes[-1][up[-1]] * _BASE + self._codes(c))
            size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            best, count = np.full(len(first), -np.inf), np.zeros(len(first), np.int64)
            above = np.arange(len(first))
            for n in range(1, min(depth, len(self.powers) - 1) + 1):
                above = up[depth - n][above]
                if n in self.tables:
                    keys, values = self.tables[n]
                    with np.errstate(over="ignore"):
                        h = hashes[depth] - hashes[depth - n][above] * self.powers[n]
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = keys[at] == h
                    value = np.where(hit, values[at], self.unknown if n == 1 else -np.inf) + scores[depth - n][above]
                    number = pieces[depth - n][above] + np.where(hit, 1, size)
                    better = value >= best  # of equal scores the longer last piece
                    best, count = np.where(better, value, best), np.where(better, number, count)
            scores.append(best)
            pieces.append(count)
            ends = alive[lengths[alive] == depth]
            counts[np.array(order)[ends]] = count[node[ends]]
        return counts

    def count(self, texts: list[str]) -> list[int]:
        """Pieces of whole texts: blanks become the word mark, one more is put before a text, and each run of marks starts a pre-token."""
        split = [_pretokens(x) for x in texts]
        if len(self.known) > KEEP:
            self.known.clear()
        got = [list(map(self.known.get, s)) for s in split]
        new = {p for s, g in zip(split, got, strict=True) if None in g for p, x in zip(s, g, strict=True) if x is None}
        todo = list(new)
        self.known.update(zip(todo, self.forward(todo).tolist(), strict=True))
        return [sum(map(self.known.__getitem__, s)) if None in g else sum(g) for s, g in zip(split, got, strict=True)]


def _pretokens(text: str) -> list[str]:
    """Pre-tokens: no piece of the vocabulary holds a mark behind another character, so no segmentation crosses a cut before a mark."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or "▁" in text:
        import re

        return re.findall("▁*[^▁]+|▁+", "▁" + text.replace(" ", "▁"))
    return ["▁" + w for w in text.split(" ")]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens): pieces of the best unigram segmentation of each whole text; one row for each input row. Null and empty texts have none."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = UnigramTrie(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_loaded[vocabulary].count([x or "" for x in b.column(1).to_pylist()]), pa.int64())], names=["doc_id", "n_tokens"])

    return only(docs, "doc_id", "text").mapInArrow(count, "doc_id long, n_tokens long")
