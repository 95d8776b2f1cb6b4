"""Toxicity by a noisy channel: disguised words are restored, then the restored text is scored.

A character trigram model is counted over all documents. Words that may be disguised (digits or marks between letters, letters
three times in a row, letters spaced out) become lattices: a mark may stand for some letters, a repeated letter for one or two,
a separator, or the space between two letters, for nothing or for the end of a word. Viterbi decoding finds the likeliest words
under the character model, which also holds the lexicon's words; an entry that fits whole between two ends is one step. The lexicon is learned from labelled documents: a word's surroundings there (copies of a document have
the same ones and so count once) come from toxic documents as often as any word's do, or else nearly always; a mixture of these two kinds is fitted
over all words. Words that are more likely of the second kind are the lexicon, of any size. A text's score follows from the odds of toxic documents and
from how much likelier each of the lexicon's words that it holds, as written or as restored, is in a toxic text than by chance in one of its length, scaled
to fit the labels; without any, it is ``BASE``, raised a little by the surest of its other words.

The lexicon is learned from at most ``max_train`` toxic and twice as many other labelled documents (those with the least id
hash); character counts
come from all documents. Null or empty texts get the base score, repeated rows are scored each, repeated labels of a document
count once (the largest), an empty table gives an empty result, and without usable labels every score is 0. Texts are read
whole; further columns are ignored, and labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import Words, combine, fold, keep_rows, load, materialise, slices, text_of

MAX_TRAIN = 6000
#: Score of a text without any entry.
BASE = 0.03
#: What a mark may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "h"}
SEPARATORS = ".-_~'`"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Log score of an entry that fits between two ends of words.
ENTRY = -2.3
#: Tokens up to this length are remembered with what they stand for.
REMEMBERED = 64

#: How surely a word of the lexicon is of the toxic kind at least, and one that still ranks texts.
STRONG, WEAK = 0.5, 0.02

_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "".join(LEET) + SEPARATORS if ord(c) < 128]] = True


def letters(b: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 text belongs to a letter: a-z, and all beyond ASCII but U+0080 to U+00BF, U+2000 to U+207F and U+3000 to U+303F (quotes, dashes, dots)."""
    out = _CLASS[b] > 0
    for lead, low, high, size in ((0xC2, 0x80, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3)):
        at = np.flatnonzero(b == lead)
        at = at[at + size <= len(b)]
        at = at[(b[at + 1] >= low) & (b[at + 1] <= high)]
        for k in range(size):
            out[at + k] = False
    return out


def cores(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words without marks at either end that are no letters."""
    letter = letters(words.buf)
    places, at = np.flatnonzero(letter), np.concatenate([[0], np.cumsum(letter)])
    lo, hi = at[words.starts], at[words.ends]
    starts, ends = words.starts.copy(), words.starts.copy()
    some = hi > lo
    starts[some], ends[some] = places[lo[some]], places[hi[some] - 1] + 1
    return starts, ends


def features(words: Words, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of cores of two bytes or more, and the word of each."""
    some = np.flatnonzero(ends - starts > 1)
    return words.hashes(starts=starts[some], ends=ends[some]), some


def trigrams(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of three characters in a row within each text; a character is one class, however many bytes it has."""
    head = (buf & 0xC0) != 0x80
    c = np.where(letters(buf), _CLASS[buf], 0)[head].astype(np.int32)
    if len(c) < 3:
        return np.zeros(1 << 15, np.int64)
    inside = np.ones(len(c) - 2, bool)
    edges = np.concatenate([[0], np.cumsum(head)])[offsets[1:-1]]
    for k in (1, 2):
        inside[edges[(edges >= k) & (edges - k < len(inside))] - k] = False
    return np.bincount(((c[:-2] << 10) + (c[1:-1] << 5) + c[2:])[inside], minlength=1 << 15)


def character_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Trigrams of letter classes (27 and a boundary, in 32 x 32 x 32) over all documents."""

    def run(batches):
        total = np.zeros(1 << 15, np.int64)
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column("body")):
                total += trigrams(buf, offsets)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    got = text_of(docs, key, text, lower=True).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << 15)
    if len(got):
        out[got["gram"].to_numpy()] = got["n"].to_numpy()
    return out


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    sure: np.ndarray = field(default_factory=lambda: np.zeros(0))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))  # an entry's share of toxic texts
    chance: np.ndarray = field(default_factory=lambda: np.zeros(0))  # and of other texts' words
    odds: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)  # of log odds
    base: float = 0.0
    names: list[str] = field(default_factory=list)
    logp: np.ndarray = field(default_factory=lambda: np.zeros((32, 32, 32)))
    decoded: dict[str, list[str]] = field(default_factory=dict)
    trie: dict = field(default_factory=dict)

    def __post_init__(self):
        for word in filter(None, self.names):
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word

    def decode(self, token: str) -> list[str]:
        """The likeliest words for a disguised token."""
        token = token.lower()
        if len(token) > REMEMBERED:
            return viterbi(token, self.logp, self.trie).split()
        if token not in self.decoded:
            if len(self.decoded) > 200_000:
                self.decoded.clear()
            self.decoded[token] = viterbi(token, self.logp, self.trie).split()
        return self.decoded[token]

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def restored(self, words: Words) -> tuple[list[str], list[int]]:
        """Words restored from disguised ones, and the text of each."""
        out, who = [], []
        doc = words.doc
        for i, token in disguised(words, doc):
            for got in self.decode(token):
                if len(got) > 2:
                    out.append(got)
                    who.append(int(doc[i]))
        return out, who

    def evidence(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each text the log odds from its words of the lexicon, NaN where it holds none, and how sure the surest of its other words is."""
        n = len(words.first) - 1
        starts, ends = cores(words)
        hashes, who = features(words, starts, ends)
        entry = self.found(hashes)
        hit = entry >= 0
        pairs = [np.stack([words.doc[who[hit]], entry[hit]], 1)]
        texts, docs = self.restored(words)
        if texts:
            raw = [t.encode() for t in texts]
            again = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            h, w = features(again, again.starts, again.ends)
            e = self.found(h)
            pairs.append(np.stack([np.array(docs)[again.doc[w[e >= 0]]], e[e >= 0]], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0) if sum(map(len, pairs)) else np.zeros((0, 2), int)
        text, e = pairs[:, 0], pairs[:, 1]
        strong = self.sure[e] >= STRONG
        by_chance = 1 - np.exp(-self.chance[e] * np.maximum(words.counts[text], 1))
        ratio = 1 + self.sure[e] * (self.toxic[e] / np.maximum(by_chance, 1e-12) - 1)
        logs = np.log(max(self.odds, 1e-9)) + np.bincount(text[strong], weights=np.log(ratio[strong]), minlength=n)
        other = np.zeros(n)
        np.maximum.at(other, text[~strong], self.sure[e][~strong])
        return np.where(np.bincount(text[strong], minlength=n) > 0, logs, np.nan), other

    def score(self, words: Words) -> np.ndarray:
        logs, other = self.evidence(words)
        some = 1 / (1 + np.exp(-np.clip(self.scale[0] * np.nan_to_num(logs) + self.scale[1], -30, 30)))
        return np.maximum(1 - (1 - self.base) * (1 - 0.8 * other), np.where(np.isnan(logs), 0.0, some))


def disguised(words: Words, doc: np.ndarray):
    """Words that may be disguised, with their index, and words spelled out letter by letter."""
    b = words.buf
    if not len(words):
        return
    size = words.ends - words.starts
    letter = letters(b)
    at = np.concatenate([[0], np.cumsum(letter)])
    held = at[words.ends] - at[words.starts]
    am = np.concatenate([[0], np.cumsum(_MARK[b])])
    starts, ends = cores(words)
    inside = am[np.maximum(ends, starts)] - am[starts]
    # A mark that leads or ends a word counts where letters are most of it ("$cum", "1diot").
    lead = _MARK[b[words.starts]] & (held * 2 >= size)
    tail = _MARK[b[words.ends - 1]] & (held * 2 >= size) & ~np.isin(b[words.ends - 1], np.frombuffer((SEPARATORS + "!").encode(), np.uint8))
    low = b | 0x20
    three = np.zeros(len(b) + 1, np.int64)
    if len(b) > 2:
        run = (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & letter[:-2]
        three[1 : len(run) + 1] = np.cumsum(run)
        three[len(run) + 1 :] = three[len(run)]
    thrice = three[np.maximum(words.ends - 2, words.starts)] - three[words.starts] > 0
    for i in np.flatnonzero((size > 2) & (held > 0) & ((inside > 0) | lead | tail | thrice)):
        yield i, words.text(i).decode("utf-8", "ignore")
    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    single = (chars[words.ends] - chars[words.starts] == 1) & (letter[words.starts] | _MARK[b[words.starts]])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    for lo, hi in zip(edge[::2], edge[1::2], strict=True):
        for j in np.split(np.arange(lo, hi), np.flatnonzero(np.diff(doc[lo:hi])) + 1):
            if len(j) > 2 and letter[words.starts[j]].sum() > 1:
                yield j[0], " ".join(words.text(i).decode("utf-8", "ignore") for i in j)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of a character, what it may stand for and at what cost; a space is the end of a word. Letters that
    are spaced out stand for themselves each, or for nothing where they repeat the one before."""
    out: list[list[tuple[str, float]]] = []
    spaced, before = " " in token, ""
    for m in re.finditer(r"(.)" if spaced else r"(.)\1*", token, re.S):
        c, n = m[1], len(m[0])
        edge = m.start() == 0 or m.end() == len(token)
        if c in SEPARATORS or c == " ":
            out.append([("", 0.0), (" ", 0.0)])
        elif c in LEET:
            options = [(x, 0.7 + (len(LEET[c]) > 2)) for x in LEET[c]]
            options += [(2 * x, 0.7) for x in LEET[c] if n > 1]
            options += [("", 1.0)] if n > 1 or edge or c == before else []
            out.append(options if c.isalnum() else [*options, (" ", 1.0)])
        elif "a" <= c <= "z" or ord(c) > 127:
            options = [(c, 0.0 if n == 1 else 0.3 if n > 2 else 1.5), *([(2 * c, 0.0)] if n > 1 else [])]
            out.append([*options, ("", 1.0)] if c == before else options)
        elif c.isdigit() or not c.isalnum():
            out.append([("", 1.0)] if c.isalnum() else [("", 1.0), (" ", 1.0)])
        before = c if spaced and c != " " else before
    return out


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


#: The state after an entry: only nothing or the end of the word can follow.
_WHOLE = (-1, -1)


def _entries(units: list[list[tuple[str, float]]], i: int, trie: dict):
    """Entries that the lattice can spell from unit i on: the unit after the last, the cost and the word."""
    held = {id(trie): (0.0, trie)}
    for j in range(i, len(units)):
        nxt: dict[int, tuple[float, dict]] = {}
        for cost, node in held.values():
            for text, more in units[j]:
                to = None if text == " " or (node is trie and not text) else node
                for ch in text:
                    to = to.get(ch) if to else None
                if to and (id(to) not in nxt or nxt[id(to)][0] > cost + more):
                    nxt[id(to)] = (cost + more, to)
        if not nxt:
            return
        for cost, node in nxt.values():
            if "" in node:
                yield j + 1, cost, node[""]
        held = nxt


def viterbi(token: str, logp: np.ndarray, trie: dict | None = None) -> str:
    """The best path through the token's lattice under the trigram model; a state is the last two characters."""
    units = lattice(token)
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    wholes: dict[int, tuple[float, tuple]] = {}
    for i, options in enumerate(units):
        if trie and (0, 0) in states:
            score, path = states[0, 0]
            for j, cost, word in _entries(units, i, trie):
                s = score + ENTRY - cost
                if j not in wholes or wholes[j][0] < s:
                    wholes[j] = (s, (path, word))
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for text, cost in options:
                x, y, s = a, b, score - cost
                if text == " ":
                    s += logp[a, b, 0] if (a, b) not in ((0, 0), _WHOLE) else 0.0
                    x = y = 0
                elif text and (a, b) == _WHOLE:
                    continue
                else:
                    for ch in text:
                        z = _code(ch)
                        s += logp[x, y, z]
                        x, y = y, z
                if (x, y) not in nxt or nxt[x, y][0] < s:
                    nxt[x, y] = (s, (path, text) if text else path)
        whole = wholes.pop(i + 1, None)
        if whole and (_WHOLE not in nxt or nxt[_WHOLE][0] < whole[0]):
            nxt[_WHOLE] = whole
        states = nxt
    path = max(((s if (a, b) in ((0, 0), _WHOLE) else s + logp[a, b, 0], i, p) for i, ((a, b), (s, p)) in enumerate(states.items())), default=(0.0, 0, None), key=lambda x: x[0])[2]
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


def character_model(counts: np.ndarray, lexicon: list[str], share: float = 0.5) -> np.ndarray:
    """Log probabilities of a character after two others: corpus and lexicon in equal parts, smoothed by bigrams and a floor."""
    own = np.zeros(1 << 15)
    for word in lexicon:
        c = [0, 0, *map(_code, word), 0]
        for x, y, z in zip(c, c[1:], c[2:], strict=False):
            own[(x << 10) + (y << 5) + z] += 1

    def conditional(n):
        cube = n.reshape(32, 32, 32)
        two = cube.sum(0)
        lower = (two + 0.1) / (two + 0.1).sum(1, keepdims=True)
        return (cube + 2 * lower[None]) / (cube.sum(2, keepdims=True) + 2)

    corpus = counts.reshape(32, 32, 32).copy()
    corpus[0, 0] = corpus[:, 0].sum(0)  # at the start of a word only the boundary is known
    return np.log((1 - share) * conditional(corpus.reshape(-1)) + share * conditional(own) if own.any() else conditional(corpus.reshape(-1)))


@dataclass
class Kinds:
    """Two kinds of words: of the one, surroundings are toxic with the sample's ``share``; of the other, with ``rate``. ``prior``: the other's part of all words."""

    share: float
    rate: float
    prior: float

    def terms(self) -> tuple[float, float, float]:
        """Log odds that a word is of the other kind: a constant, and what a toxic and another surrounding add."""
        return float(np.log(self.prior / (1 - self.prior))), float(np.log(self.rate / self.share)), float(np.log((1 - self.rate) / (1 - self.share)))

    def sure(self, t: np.ndarray, c: np.ndarray) -> np.ndarray:
        """How surely words are of the other kind; one surrounding tells nothing."""
        a, b, d = self.terms()
        return np.where(t > 1, 1 / (1 + np.exp(-np.clip(a + b * t + d * c, -50, 50))), 0.0)


def mixture(t: np.ndarray, c: np.ndarray, n: np.ndarray, steps: int = 40) -> Kinds:
    """Fitted by expectation and maximisation to n words with t toxic and c other surroundings each."""
    share = float((n * t).sum() / (n * (t + c)).sum())
    kinds = Kinds(share, max(0.9, (1 + share) / 2), 1e-3)
    for _ in range(steps):
        z = n * kinds.sure(t, c)
        rate = ((z * t).sum() + 9) / ((z * (t + c)).sum() + 10)
        kinds = Kinds(share, float(np.clip(rate, (1 + share) / 2, 0.99)), float(np.clip(z.sum() / n.sum(), 1e-6, 0.1)))
    return kinds


@dataclass
class Entry:
    """A word's hash, how surely it is toxic, its share of toxic texts and of other texts' words, and, in the lexicon, the word."""

    feature: int
    sure: float
    toxic: float
    chance: float
    word: str


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, key: str = "doc_id", text: str = "text") -> tuple[list[Entry], float, DataFrame]:
    """Entries, the odds of a toxic text, and the labelled texts (y, body). Surroundings are pairs of neighbouring words, so copies of a document add none."""
    marks = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & (fold(key, 5) != 0)).groupBy(F.col(key).alias("lab_key")).agg(F.max("toxic").cast("int").alias("y"))
    ranked = marks.withColumn("rank", F.xxhash64("lab_key"))
    chosen = ranked.where("y = 1").orderBy("rank", "lab_key").limit(max_train).union(ranked.where("y = 0").orderBy("rank", "lab_key").limit(2 * max_train))
    sample = materialise(text_of(docs, key, text, lower=True).join(F.broadcast(chosen.select("lab_key", "y")), F.col("key") == F.col("lab_key")).groupBy("key", "y").agg(F.max("body").alias("body")).select("y", "body"), "toxic-sample")

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column("body")):
                words = Words(buf, offsets)
                starts, ends = cores(words)
                whole, (hashes, who) = words.hashes(), features(words, starts, ends)
                if not len(hashes):
                    continue
                left, right = np.append(np.uint64(0), whole[:-1]), np.append(whole[1:], np.uint64(0))
                some = words.counts > 0
                left[words.first[:-1][some]] = right[words.first[1:][some] - 1] = 0  # a text's ends
                around, doc = combine([left[who], right[who]]), words.doc[who]
                order = np.lexsort((hashes, doc))
                keep = np.ones(len(order), bool)
                keep[1:] = (doc[order][1:] != doc[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
                order = order[keep]
                y = batch.column("y")[lo:hi].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(hashes[order].view(np.int64)), pa.array(around[order].view(np.int64)), pa.array(y[doc[order]])], names=["feature", "around", "y"])

    rows = sample.mapInArrow(run, "feature long, around long, y int").distinct()
    counts = materialise(rows.groupBy("feature").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")), "toxic-counts")
    table = counts.groupBy("t", "c").count().toPandas()  # of a bounded sample
    t, c, n = (table[x].to_numpy().astype(float) for x in ("t", "c", "count"))
    if not (n * t).sum() or not (n * c).sum():
        return [], 0.0, sample
    kinds = mixture(t, c, n)
    a, b, d = kinds.terms()
    found = counts.where((F.col("t") > 1) & (F.lit(a) + F.lit(b) * F.col("t") + F.lit(d) * F.col("c") > float(np.log(WEAK / (1 - WEAK))))).orderBy("feature").collect()
    sure = kinds.sure(np.array([r["t"] for r in found], float), np.array([r["c"] for r in found], float))
    names = _spell(sample, {r["feature"] for r, x in zip(found, sure, strict=True) if x >= STRONG})
    texts = _sizes(sample)
    entries = [
        Entry(r["feature"], float(x), min(1.0, r["t"] / texts["toxic"]), (r["c"] + 0.5) / max(1, texts["words"]), names.get(r["feature"], ""))
        for r, x in zip(found, sure, strict=True)
    ]
    return entries, texts["toxic"] / max(1, texts["other"]), sample


def _sizes(sample: DataFrame) -> dict[str, int]:
    """Toxic and other texts of the sample, and the others' words."""

    def run(batches):
        for batch in batches:
            y = batch.column("y").to_numpy()
            words = [Words(buf, offsets).counts for _, _, buf, offsets in slices(batch.column("body"))]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (y.sum(), (1 - y).sum(), (np.concatenate(words) * (1 - y)).sum() if words else 0)], names=["toxic", "other", "words"])

    return sample.mapInArrow(run, "toxic long, other long, words long").agg(*(F.sum(c).alias(c) for c in ("toxic", "other", "words"))).first().asDict()


def _spell(sample: DataFrame, wanted: set[int]) -> dict[int, str]:
    """The words that the chosen hashes stand for, read off the sample."""
    keys = np.array(sorted(wanted), np.int64).view(np.uint64)

    def run(batches):
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column("body")):
                words = Words(buf, offsets)
                starts, ends = cores(words)
                hashes, who = features(words, starts, ends)
                out: dict[int, str] = {}
                for i in np.flatnonzero(np.isin(hashes, keys)):
                    out.setdefault(int(hashes[i : i + 1].view(np.int64)[0]), buf[starts[who[i]] : ends[who[i]]].tobytes().decode("utf-8", "ignore").lower())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()))], names=["feature", "word"])

    got = sample.where("y = 1").mapInArrow(run, "feature long, word string").groupBy("feature").agg(F.min("word").alias("word")).collect()
    return {r["feature"]: r["word"] for r in got}


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, key: str = "doc_id", text: str = "text") -> Model:
    entries, odds, sample = learn(docs, labels, max_train, key, text)
    entries = sorted(entries, key=lambda e: np.int64(e.feature).view(np.uint64))
    logp = character_model(character_counts(docs, key, text), [e.word for e in entries if e.word])
    keys = np.array([e.feature for e in entries], np.int64).view(np.uint64)
    sure, toxic, chance = (np.array([getattr(e, x) for e in entries]) for x in ("sure", "toxic", "chance"))
    model = Model(keys, sure, toxic, chance, odds, base=BASE if entries else 0.0, names=[e.word for e in entries], logp=logp)
    model.scale = calibrate(model, sample)
    return model


def calibrate(model: Model, sample: DataFrame, steps: int = 30) -> tuple[float, float]:
    """Scale and offset of the log odds under which the labelled texts that hold words of the lexicon are likeliest (targets a little inside 0 and 1)."""
    if not len(model.keys):
        return 1.0, 0.0

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column("body")):
                logs, _ = model.evidence(Words(buf, offsets))
                some = ~np.isnan(logs)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("y")[lo:hi].to_numpy()[some]), pa.array(logs[some])], names=["y", "x"])

    got = sample.mapInArrow(run, "y int, x double").toPandas()  # of a bounded sample
    y, x = got["y"].to_numpy(), np.minimum(got["x"].to_numpy(), 30)
    pos, neg = (y == 1).sum(), (y == 0).sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    features = np.stack([x, np.ones(len(x))], 1)

    def loss(w):
        z = features @ w
        return (np.logaddexp(0, z) - target * z).sum() + 0.05 * ((w - [1, 0]) ** 2).sum()

    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + 0.1 * np.eye(2), features.T @ (p - target) + 0.1 * (w - [1, 0]))
        size = next((k for k in 0.5 ** np.arange(12) if w[0] > k * step[0] and loss(w - k * step) < loss(w)), 0)
        if not size:
            break
        w = w - size * step
    return float(w[0]), float(w[1])


def classify(docs: DataFrame, model: Model, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted of every document."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column("body")):
                yield pa.RecordBatch.from_arrays([batch.column("key")[lo:hi].cast(pa.int64()), pa.array(model.score(Words(buf, offsets)))], names=["key", "score"])

    scored = text_of(docs, key, text, lower=True).mapInArrow(run, "key long, score double")
    return scored.select(F.col("key").alias(key), F.coalesce(fold("key", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold."""
    return keep_rows(docs, lambda words: model.score(words) < threshold, text, lower=True)


def restore(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the words restored in each document that has any."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column("body")):
                texts, who = model.restored(Words(buf, offsets))
                by: dict[int, list[str]] = defaultdict(list)
                for t, w in zip(texts, who, strict=True):
                    by[w].append(t)
                yield pa.RecordBatch.from_arrays([batch.column("key")[lo:hi].take(pa.array(list(by), pa.int64())).cast(pa.int64()), pa.array(list(by.values()), pa.list_(pa.string()))], names=["key", "restored"])

    return text_of(docs, key, text, lower=True).mapInArrow(run, "key long, restored array<string>").withColumnRenamed("key", key)


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return classify(docs, fit(docs, labels))
