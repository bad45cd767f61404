"""SentencePiece encoding and decoding by suffix-array matching of a batch's new words.

Words whose ids a worker has already are not matched again; all others of a
batch are concatenated and indexed together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, small_batches
from .encoders import _MARKS, KEEP_BYTES, LONGEST, OVERHEAD, _Store
from .piece_counts import _pretokens

#: Words up to this length are relaxed side by side; longer ones, and those with characters that no piece has, one by one.
SIDE_BY_SIDE = 200
_loaded: dict[str, "PieceEncoder"] = {}


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``codes`` sorted by the ``depth`` codes from there on, by doubling."""
    rank, span = codes.astype(np.int64), 1
    while span < depth:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-span] = rank[span:] + 1
        _, rank = np.unique(rank * (int(rank.max()) + 2) + ahead if span == 1 else rank * (len(rank) + 2) + ahead, return_inverse=True)
        span *= 2
    return np.argsort(rank, kind="stable")


class PieceEncoder:
    """Ids of a vocabulary file of byte-pair kind: pairs merge by score, leftmost first among equals."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.score = {self.text[i]: lib.get_score(i) for i in plain}
        self.id = {self.text[i]: i for i in plain}
        self.longest = max(map(len, self.id))
        self.ids = np.array(plain)
        self.points = np.full((len(plain), self.longest), -1, np.int64)
        for k, i in enumerate(plain):
            self.points[k, : len(self.text[i])] = list(map(ord, self.text[i]))
        self.size = (self.points >= 0).sum(1)
        self.halves = {t: self._halves(t) for t in self.id}
        self.strange = re.compile("([^" + re.escape("".join(t for t in self.id if len(t) == 1)) + "]+)")
        self.pairs, self.pair_fits = np.empty(0, np.int64), np.empty(0, bool)
        self.store, self.old, self.used = _Store(), _Store(), 0

    def merge(self, text: str) -> list[str]:
        """Merges of a short text, one by one."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes ``piece`` in the end; none for a character, or if its merges don't lead there."""
        parts = list(piece)
        while len(parts) > 2:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return None
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def fit(self, left: str, right: str) -> bool:
        """Whether no merge crosses from ``left`` to ``right``; then both stay as they are in any text that has them so.

        ``left`` of nothing asks whether the merges of ``right`` by itself lead to
        it. Both sides are unmade, the later merge first: a piece over the seam
        counts if it is merged before either of the pieces that took its parts.
        """
        if not left:
            return len(right) == 1 or self.halves[right] is not None
        if (len(left) > 1 and self.halves[left] is None) or (len(right) > 1 and self.halves[right] is None):
            return False
        score, late = self.score, -np.inf  # merges that score no more than ``late`` come too late
        worth = lambda p: score[p] if len(p) > 1 else np.inf  # noqa: E731  a character is there from the start
        while True:
            over = score.get(left + right)
            if over is not None and over > late:
                return False
            if len(left) == 1 and len(right) == 1:
                return True
            a, b = worth(left), worth(right)
            if b == np.inf or a < b:
                late, left = a, self.halves[left][1]
            else:
                late, right = np.nextafter(b, -np.inf), self.halves[right][0]

    def occurrences(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of every piece in the concatenated words, sorted by end, longest first."""
        flat = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        alphabet = np.unique(flat)
        codes = np.searchsorted(alphabet, flat)
        array = suffix_array(codes, self.longest)
        padded = np.concatenate([codes, np.full(self.longest, -1)])
        at = np.minimum(np.searchsorted(alphabet, self.points), len(alphabet) - 1)
        here = ((alphabet[at] == self.points) | (self.points < 0)).all(1)
        bounds = []
        for pad in (-2, 1 << 40):
            want = np.where(self.points[here] < 0, pad, at[here])
            low, high = np.zeros(len(want), np.int64), np.full(len(want), len(array))
            while (low < high).any():
                mid = np.minimum((low + high) // 2, len(array) - 1)
                seen = padded[array[mid][:, None] + np.arange(self.longest)]
                first = (seen != want).argmax(1)
                rows = np.arange(len(want))
                less = (seen[rows, first] < want[rows, first]) & (low < high)
                low, high = np.where(less, mid + 1, low), np.where(less | (low >= high), high, mid)
            bounds.append(low)
        count = bounds[1] - bounds[0]
        start = array[np.repeat(bounds[0] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        size = np.repeat(self.size[here], count)
        order = np.lexsort((-size, start + size))
        return start[order], (start + size)[order], np.repeat(self.ids[here], count)[order]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Relax edges in order of their ends: a prefix ends in the one piece that fits behind the best path to its start."""
        starts, ends, pieces = (x.tolist() for x in self.occurrences(words))
        out, k, base, text, n = [], 0, 0, self.text, len(ends)
        for w in words:
            last: list[str | None] = [""] * (len(w) + 1)
            before = [0] * (len(w) + 1)
            for e in range(1, len(w) + 1):
                found = None
                while k < n and ends[k] == base + e:
                    if found is None:
                        s, t = starts[k] - base, text[pieces[k]]
                        if last[s] is None or self.fit(last[s], t):
                            found = (s, t)
                    k += 1
                if found is None:  # no piece: the character stands alone and becomes its bytes
                    last[e], before[e] = None, e - 1
                else:
                    before[e], last[e] = found
            path, e = [], len(w)
            while e:
                s = before[e]
                path.append([self.byte[b] for b in w[s:e].encode("utf-8", "surrogatepass")] if last[e] is None else [self.id[last[e]]])
                e = s
            out.append(np.array([i for p in reversed(path) for i in p], "<u4").tobytes())
            base += len(w) + 1
        return out

    def fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fit`` for arrays of ids; -1 as ``left`` is the start of a word. Each distinct pair is judged once."""
        keys, back = np.unique((left + 1) * len(self.text) + right, return_inverse=True)
        at = np.searchsorted(self.pairs, keys)
        seen = np.zeros(len(keys), bool)
        seen[at < len(self.pairs)] = self.pairs[at[at < len(self.pairs)]] == keys[at < len(self.pairs)]
        fits = np.zeros(len(keys), bool)
        fits[seen] = self.pair_fits[at[seen]]
        new = np.flatnonzero(~seen)
        if len(new):
            names = ["", *self.text]
            fits[new] = [self.fit(names[k // len(self.text)], self.text[k % len(self.text)]) for k in keys[new].tolist()]
            if len(self.pairs) > 4_000_000:
                self.pairs, self.pair_fits = self.pairs[:0], self.pair_fits[:0]
                at = np.zeros(len(keys), np.int64)
            self.pairs, self.pair_fits = np.insert(self.pairs, at[new], keys[new]), np.insert(self.pair_fits, at[new], fits[new])
        return fits[back]

    def encode_together(self, words: list[str]) -> list[bytes]:
        """The same relaxation for many words side by side: all edges that end at their word's first character, then at the second, and so on."""
        size = np.array([len(w) for w in words], np.int64)
        base = np.cumsum(size + 1) - size - 1
        starts, ends, pieces = self.occurrences(words)
        word = np.searchsorted(base, starts, "right") - 1
        depth = ends - base[word]
        order = np.lexsort((np.arange(len(starts)), depth))
        starts, ends, pieces = starts[order], ends[order], pieces[order]
        edge = np.searchsorted(depth[order], np.arange(1, int(size.max()) + 2))
        last, before = np.full(int(base[-1] + size[-1]) + 1, -2), np.zeros(int(base[-1] + size[-1]) + 1, np.int64)
        last[base] = -1
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            ok = np.flatnonzero(last[starts[a:b]] > -2) + a
            ok = ok[self.fitting(last[starts[ok]], pieces[ok])]
            ok = ok[np.concatenate([[True], ends[ok][1:] != ends[ok][:-1]])] if len(ok) else ok
            last[ends[ok]], before[ends[ok]] = pieces[ok], starts[ok]
        own, at, steps = np.arange(len(words)), base + size, []
        while len(own):
            steps.append((own, last[at]))
            at = before[at]
            own, at = own[at > base[own]], at[at > base[own]]
        who, ids = (np.concatenate(x[::-1]) for x in zip(*steps, strict=True))
        raw, count = ids[np.argsort(who, kind="stable")].astype("<u4").tobytes(), np.bincount(who, minlength=len(words))
        cut = np.concatenate([[0], np.cumsum(count) * 4]).tolist()
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def encode_new(self, words: list[str]) -> list[bytes]:
        """Ids of whole pre-tokens. A character that no piece has parts a word and becomes its bytes."""
        cut = [self.strange.split(w) for w in words]
        segments = list({x: None for c in cut for x in c[::2] if x})
        known = {"": b""}
        short, long = [x for x in segments if len(x) <= SIDE_BY_SIDE], [x for x in segments if len(x) > SIDE_BY_SIDE]
        for part in (short, long):
            for k in range(0, len(part), 50_000):
                some = part[k : k + 50_000]
                known.update(zip(some, (self.encode_together if part is short else self.encode_words)(some), strict=True))
        spelled = lambda x: np.array([self.byte[b] for b in x.encode("utf-8", "surrogatepass")], "<u4").tobytes()
        return [known[c[0]] if len(c) == 1 else b"".join([spelled(x) if k % 2 else known[x] for k, x in enumerate(c)]) for c in cut]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of ``words``, each a pre-token less its first mark (or, with the mark still there, a run of marks and what follows). Marks behind a stem are encoded apart where no merge crosses."""
        old, store = self.old, self.store
        known = {w: old[w] for w in words if w in old}
        fresh = [w for w in words if w not in known]
        stems = {w: x for w in fresh if w[-1:] in _MARKS and (x := w.rstrip(_MARKS))}
        tails = {w[len(x) :] for w, x in stems.items()}
        wanted = {w for w in fresh if w not in stems}.union(stems.values())
        known |= {w: (store if w in store else old)[w] for w in wanted if w in store or w in old}
        todo = [w for w in wanted if w not in known]
        spelled = [w if w[:1] == "▁" else "▁" + w for w in todo]
        got = self.encode_new([*spelled, *tails])
        known.update(zip(todo, got, strict=False))
        tail_ids = dict(zip(tails, got[len(todo) :], strict=True))
        whole = []
        for w, x in stems.items():
            a, b = known[x], tail_ids[w[len(x) :]]
            left, right = int.from_bytes(a[-4:], "little"), int.from_bytes(b[:4], "little")
            if left in self.of_byte or right in self.of_byte or self.fit(self.text[left], self.text[right]):
                known[w] = a + b
            else:
                whole.append(w)
        known.update(zip(whole, self.encode_new([w if w[:1] == "▁" else "▁" + w for w in whole]), strict=True))
        keep = {w: i for w, i in known.items() if len(w) <= LONGEST}
        store.update(keep)
        self.used += OVERHEAD * len(keep) + sum(map(len, keep)) + sum(map(len, keep.values()))
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.used > 3 * KEEP_BYTES // 2:
            self.store, self.old, self.used = _Store(), self.store, 0
        again: dict[str, int] = {}
        place = [again.setdefault(x, len(again)) for x in texts]  # equal texts are encoded once
        cuts = [_keys(x) for x in again]
        get = self.store.__getitem__
        ids = [list(map(get, c)) for c in cuts]
        known: dict[str, bytes] = {}
        if self.store.wanted:
            known, self.store.wanted = self._learn(set(self.store.wanted)), []
        out = []
        for c, i in zip(cuts, ids, strict=True):
            at = 0
            for _ in range(i.count(None)):
                at = i.index(None, at)
                i[at] = known[c[at]]
            out.append(b"".join(i))
        return [out[k] for k in place]


def _keys(text: str) -> list[str]:
    """Pre-tokens, less their first mark if they have one and more."""
    if text and not ("  " in text or text[0] == " " or text[-1] == " " or "▁" in text):
        return text.split(" ")
    return [p if p[:2] == "▁▁" or p == "▁" or p[0] != "▁" else p[1:] for p in _pretokens(text)]


def encode_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, piece_ids, decoded): ids of each whole text as little-endian unsigned 32-bit integers, and the text decoded from them.

    One row for each input row, repeated ones too; null and empty texts have no
    ids and decode to an empty text; an empty table gives no rows. A long text
    is encoded whole; long unbroken words are never kept. A mark character in a text decodes to a blank.
    """
    small_batches(docs.sparkSession, 2048)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = PieceEncoder(vocabulary)
        coder = _loaded[vocabulary]
        utf8 = [bytes([coder.of_byte[i]]) if i in coder.of_byte else t.encode() for i, t in enumerate(coder.text)]
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)) if b.nbytes > 64 << 20 else (b,):
                ids = coder.encode([x or "" for x in part.column(1).to_pylist()])
                text = [b"".join([utf8[i] for i in np.frombuffer(x, "<u4").tolist()]).decode("utf-8", "replace").replace("▁", " ")[1:] for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(text, pa.string())], names=["doc_id", "piece_ids", "decoded"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece_ids binary, decoded string")


def piece_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and decoded_crc32 (unsigned) of each document."""
    return encode_pieces(docs, vocabulary).select("doc_id", (F.length("piece_ids") / 4).cast("long").alias("n_pieces"), F.crc32("piece_ids").alias("ids_crc32"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))
