"""Token ids of whole texts by a public tokenizer, with a bounded cache of words in each Python worker.

The tokenizer drops white space and never joins characters across it, so a text's ids are its words' ids one after another.
Each distinct word is encoded by the library once per worker and then looked up by a 64-bit hash of its bytes.
"""

from __future__ import annotations

import os

import numpy as np

from tessera.llm.common import Words

#: Words that a worker's cache holds at most; beyond that it starts anew. Only speed depends on it.
CACHE_WORDS = 3_000_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.key, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.new: dict[int, tuple[int, int]] = {}

    def _keys(self, words: Words) -> np.ndarray:
        keys = words.hashes(lower=True)
        marks = np.flatnonzero(words.buf[:-1] == 0x3C)
        marks = marks[words.buf[marks + 1] == 0x7C] if len(marks) else marks
        if len(marks):  # "<|": a special token's name depends on case
            i = np.unique(np.searchsorted(words.starts, marks, side="right") - 1)
            keys[i] = words.hashes(lower=False, starts=words.starts[i], ends=words.ends[i]) ^ np.uint64(0x5851F42D4C957F2D)
        return keys

    def _add(self, texts: list[bytes], keys: np.ndarray) -> None:
        """Encodes new words, all in one text, and divides the ids by where they start."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        at = np.cumsum([0, *(len(t) + 1 for t in plain)])
        got = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
        ids = np.array(got.ids, np.uint32)
        begin = np.array([a for a, _ in got.offsets], np.int64)
        bounds = np.searchsorted(begin, at)
        if self.used + len(ids) > len(self.pool):
            pool = np.zeros(2 * (self.used + len(ids)), np.uint32)
            pool[: self.used] = self.pool[: self.used]
            self.pool = pool
        self.pool[self.used : self.used + len(ids)] = ids
        key = np.concatenate([self.key, keys])
        start = np.concatenate([self.start, bounds[:-1] + self.used])
        size = np.concatenate([self.size, np.diff(bounds).astype(np.int32)])
        order = np.argsort(key, kind="stable")
        self.key, self.start, self.size = key[order], start[order], size[order]
        self.used += len(ids)

    def places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word, where its ids lie in the pool and how many there are."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        unique, index, inverse = np.unique(self._keys(words), return_index=True, return_inverse=True)
        if len(self.key) > CACHE_WORDS:
            self._clear()
        at = np.searchsorted(self.key, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == unique[inside]
        if not known.all():
            missing = np.flatnonzero(~known)
            self._add([words.text(i) for i in index[missing]], unique[missing])
            at = np.searchsorted(self.key, unique)
        return self.start[at][inverse], self.size[at][inverse].astype(np.int64)

    def lengths(self, words: Words) -> np.ndarray:
        """Ids in each text."""
        sums = np.concatenate([[0], np.cumsum(self.places(words)[1])])
        return np.diff(sums[words.first])

    def ids(self, words: Words, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, each closed by end_id, and the texts' bounds."""
        start, size = self.places(words)
        sums = np.concatenate([[0], np.cumsum(size)])
        n = len(words.first) - 1
        own = np.diff(sums[words.first])
        closes = int(end_id is not None)
        bounds = np.concatenate([[0], np.cumsum(own + closes)])
        flat = np.repeat(start - sums[:-1], size) + np.arange(sums[-1])
        out = np.empty(bounds[-1], np.uint32)
        keep = np.ones(len(out), bool)
        if closes:
            out[bounds[1:] - 1] = end_id
            keep[bounds[1:] - 1] = False
        out[keep] = self.pool[flat]
        assert len(bounds) == n + 1
        return out, bounds


_made: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]
