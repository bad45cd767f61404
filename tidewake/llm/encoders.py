"""Exact encodings by the tokenizers library, with the ids of words kept.

Both vocabularies split a text at white space before any merge, so the ids of a
text are those of its words in a row. A store bounded in bytes keeps the ids of
words seen; what it lacks goes through the library. Texts in which a cut could
move a split (runs of mixed white space) go through the library whole.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Bytes kept by each half of the store, with what Python needs for a word and its ids.
KEEP_BYTES, OVERHEAD = 72 << 20, 200
#: Longer words are encoded each time they come.
LONGEST = 64
_CONTROL = re.compile("[\x1c-\x1f]")
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: A run of these is one pre-token of either vocabulary.
_MARKS = ".,!?;:*$%&#|()-+=@\""
_loaded: dict[tuple[str, str], "WordEncoder"] = {}


class _Store(dict):
    """Ids by word; words that are asked for and missing are noted."""

    def __init__(self) -> None:
        self.wanted: list[str] = []

    def __missing__(self, word: str) -> None:
        self.wanted.append(word)


def _plain_letter(c: str) -> bool:
    """A letter that either vocabulary's normalization leaves as it is, so that marks behind it are a pre-token of their own."""
    return c < "ɐ" and c.isalpha() and c == c.lower()


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_file(path), kind
        self.store, self.old = _Store(), _Store()
        self.tails: dict[str, bytes] = {}
        self.used = 0
        vocabulary = self.library.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # pieces that begin (or end) a word
        for piece, i in vocabulary.items():
            self.edge[i] = piece[:1] == "Ġ" if kind == "space-led" else piece[-4:] == "</w>"

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _spelled(self, word: str) -> str:
        """What the library is asked for a word: in a space-led vocabulary two newlines mark the head of a text, and one is part of the word."""
        if self.kind == "word":
            return word
        return word[2:] if word[:2] == "\n\n" else word if word[:1] == "\n" else " " + word

    def _tail(self, marks: str) -> bytes:
        if len(marks) > LONGEST:
            return self._whole(marks)
        if (got := self.tails.get(marks)) is None:
            if len(self.tails) > 20_000:
                self.tails.clear()
            got = self.tails[marks] = self._whole(marks)
        return got

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of ``words``, kept if they aren't long. Marks after a plain letter are encoded apart, and upper case like lower case where the vocabulary has none."""
        store, old = self.store, self.old
        known = {w: old[w] for w in words if w in old}
        fresh = [w for w in words if w not in known] if known else words
        core = {}  # of words that aren't asked for themselves
        for w in fresh:
            if w[-1:] in _MARKS and w:
                stem = w.rstrip(_MARKS)
                if stem and _plain_letter(stem[-1].lower() if stem[-1].isascii() and self.kind == "word" else stem[-1]):
                    core[w] = stem
        if self.kind == "word":
            core |= {w: x for w in fresh if w.isascii() and (x := core.get(w, w).lower()) != w}
        wanted = {w for w in fresh if w not in core}.union(core.values())
        known |= {w: (store if w in store else old)[w] for w in wanted if w in store or w in old}
        self._ask([w for w in wanted if w not in known], known)
        for w, x in core.items():
            known[w] = known[x] + self._tail(w[len(x) :]) if len(x) < len(w) else known[x]
        keep = {w: i for w, i in known.items() if len(w) <= LONGEST}
        store.update(keep)
        self.used += OVERHEAD * len(keep) + sum(map(len, keep)) + sum(map(len, keep.values()))
        return known

    def _ask(self, words: list[str], known: dict[str, bytes]) -> None:
        """Put the library's ids of ``words`` in ``known``. Words of letters alone are one pre-token each, so many go in one call and are told apart by their first (or last) pieces."""
        plain = [w for w in words if w.isalpha() and len(w) <= LONGEST]
        rest = [w for w in words if not (w.isalpha() and len(w) <= LONGEST)]
        runs = [plain[k : k + 128] for k in range(0, len(plain), 128)]
        lead = " " if self.kind == "space-led" else ""
        for run, e in zip(runs, self.library.encode_batch_fast([lead + " ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.edge[ids])
            at = [*at.tolist(), len(ids)] if lead else [0, *(at + 1).tolist()]
            if len(at) != len(run) + 1:  # a letter that the library parts or drops
                rest += run
                continue
            raw = ids.tobytes()
            known.update(zip(run, [raw[4 * i : 4 * j] for i, j in zip(at[:-1], at[1:], strict=True)], strict=True))
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            for w, e in zip(part, self.library.encode_batch_fast(list(map(self._spelled, part)), add_special_tokens=False), strict=True):
                ids = e.ids
                known[w] = struct.pack(f"<{len(ids)}I", *ids)

    def _cut(self, text: str) -> list[str] | None:
        if self.kind == "word":
            return None if _CONTROL.search(text) else text.split()
        if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or ("\n\n" in text and "<|" in text) or text[-1:] == " " or text[-2:] == "\n\n" or _OTHER_SPACE.search(text):
            return None
        cut = text.replace("\n", " \n").split(" ")
        if cut[0]:
            cut[0] = "\n\n" + cut[0]
            return cut
        return cut[1:]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.used > KEEP_BYTES:
            self.store, self.old, self.used = _Store(), self.store, 0
        store = self.store
        get = store.__getitem__
        again: dict[str, int] = {}
        place = [again.setdefault(x, len(again)) for x in texts]  # equal texts are encoded once
        texts = list(again)
        cuts = list(map(self._cut, texts))
        ids = [c and list(map(get, c)) for c in cuts]
        known: dict[str, bytes] = {}
        if store.wanted:
            known = self._learn(set(store.wanted))
            store.wanted = []
        out = []
        for text, c, i in zip(texts, cuts, ids, strict=True):
            if c is None:
                out.append(self._whole(text))
                continue
            at = 0
            for _ in range(i.count(None)):
                at = i.index(None, at)
                i[at] = known[c[at]]
            out.append(b"".join(i))
        return [out[k] for k in place]


def encoder(path: str, kind: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file. kind: ``space-led`` (byte-level pieces carry the space before them) or ``word``."""
    if (path, kind) not in _loaded:
        _loaded[path, kind] = WordEncoder(path, kind)
    return _loaded[path, kind]
