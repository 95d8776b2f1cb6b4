"""Benchmark decontamination by latent semantic retrieval, with checks for copies and paraphrases.

Passages (runs of ``PASSAGE`` words) are TF-IDF rows over hashed terms. Document frequencies are counted over all passages of all
documents, and the index is fitted on all of them too: a randomised sketch Z = A'A O of their Gram matrix, with a fixed random O, is
summed over the tasks, and from it follow the leading right singular vectors (Nystroem form of the randomised SVD). Every passage of
every document is searched. Words are then projected, windows of words are sums of
projections, and windows of about an item's own length, or of a part's, at most a quarter of it apart, are compared with it by cosine. Candidates of at least
``COSINE`` are checked: the longest common subsequence of their words with the item's must hold ``VERBATIM`` of the item, or
``PARAPHRASE`` of it together with its answer (its ``answer`` column, or else its last words).

The driver gets the summed sketch (terms x columns, of fixed size) and the benchmark, in blocks of about ``ITEMS``. Null and
empty texts, items without words, and empty tables match nothing; rows that repeat an id or have none match each for itself, and so do
items; texts are searched whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import Words, keep_rows, load, materialise, slices, text_of
from tessera.llm.toxicity import cores

TERMS = 1 << 14
RANK = 64
OVERSAMPLE = 8
PASSAGE = 32
#: Words of the text at either side of a window that are checked at least.
BLOCK = 8
#: Windows of ``EXACT`` words or more are in steps of this many words, longer ones of twice as many; shorter ones of a quarter of their length.
GRAIN = 4
EXACT = 16
#: Words between the starts of windows at most.
STRIDE = 8
#: Blocks that are summed, and candidates that are checked, at a time.
CHUNK = 4096
#: Places on which the words of items fall for the first of these checks.
MARKS = 1 << 12
#: Windows that are multiplied with the items at a time.
WINDOWS = 2048
#: Lengths of windows for parts of items; an item is also compared with the longest that is not much longer than itself.
PARTS = (8, 16, 32, 64)
COSINE = 0.5
VERBATIM = 0.8
PARAPHRASE = 0.6
ANSWER_WORDS = 5
ANSWER_SHARE = 0.6
#: Items that are sent to the tasks at once, and that are multiplied at once.
ITEMS = 16384
TILE = 512
#: Words whose rows are summed at a time for the sketch, so that they stay in the cache.
SKETCH_WORDS = 1024
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_PLAIN = np.arange(256) < 128
_PLAIN[65:91] = _PLAIN[97:123] = False
SKETCH = ", ".join(f"c{j} double" for j in range(RANK + OVERSAMPLE))


@dataclass
class _Some:
    """Words picked from a text, one after another."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _cores(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """What ``cores`` gives; words between two letters a-z, but for one ASCII mark at either end, are not looked at inside."""
    starts, ends = words.starts.copy(), words.ends.copy()
    odd = np.flatnonzero(~(_LETTER.take(words.buf[starts]) & _LETTER.take(words.buf[ends - 1])))
    if len(odd):
        lo, hi = starts[odd], ends[odd]
        hi -= _PLAIN.take(words.buf[hi - 1]) & (hi - lo > 1)
        lo += _PLAIN.take(words.buf[lo]) & (hi - lo > 1)
        starts[odd], ends[odd] = lo, hi
        odd = odd[~(_LETTER.take(words.buf[lo]) & _LETTER.take(words.buf[hi - 1]))]
    if len(odd):
        size = ends[odd] - starts[odd]
        stop = np.cumsum(size)
        shift = starts[odd] - (stop - size)
        lo, hi = cores(_Some(words.buf[np.arange(stop[-1]) + np.repeat(shift, size)], stop - size, stop))
        starts[odd], ends[odd] = lo + shift, hi + shift
    return starts, ends


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words and their hashes, without marks at their ends."""
    words = Words(buf, offsets)
    if not len(words):
        return words, np.zeros(0, np.uint64)
    starts, ends = _cores(words)
    empty = ends <= starts
    return words, words.hashes(starts=np.where(empty, words.starts, starts), ends=np.where(empty, words.ends, ends))


def _terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(50)).astype(np.int64)  # 14 bits


def _passages(count: np.ndarray) -> np.ndarray:
    """The passage of each word, numbered through the slice. count: words of each text."""
    many = -(-count // PASSAGE)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(np.cumsum(many) - many, count) + at // PASSAGE


def _cells(count: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, term and count of each cell that isn't 0."""
    cells = np.sort((_passages(count) << 14) | terms)
    head = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
    return cells[head] >> 14, cells[head] & (TERMS - 1), np.diff(np.append(head, len(cells)))


def terms_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A table that holds the terms of all words, two bytes each, and words a text, four bytes each, a row for each slice; and for each task the
    passages that hold each term, and those in all under term -1."""

    def run(batches):
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column("body")):
                words, h = _words(buf, offsets)
                if not len(words):
                    continue
                count = words.counts[words.counts > 0]
                passage, term, _ = _cells(count, _terms(h))
                total += np.bincount(term, minlength=TERMS)
                n += int(passage[-1]) + 1
                yield batch_of([None], [None], [_terms(h).astype("<u2").tobytes()], [count.astype("<u4").tobytes()])
        if n:
            some = np.flatnonzero(total)
            yield batch_of(np.append(some, -1), np.append(total[some], n), [None] * (len(some) + 1), [None] * (len(some) + 1))

    def batch_of(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["term", "n", "terms", "counts"])

    return materialise(text_of(docs, key, text, lower=True).mapInArrow(run, "term long, n long, terms binary, counts binary"), "terms")


def document_frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and passages in all. known: ``terms_of`` the rows, if it is at hand."""
    known = terms_of(docs, key, text) if known is None else known
    got = known.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out, n = np.zeros(TERMS), 0
    if len(got):
        inner = got["term"].to_numpy() >= 0
        out[got["term"].to_numpy()[inner]] = got["n"].to_numpy()[inner]
        n = int(got["n"].to_numpy()[~inner].sum())
    return out, n


def random_test_matrix(columns: int = RANK + OVERSAMPLE) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(4096)).standard_normal((TERMS, columns)).astype(np.float32)


def sketch(docs: DataFrame, idf: np.ndarray, key: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> np.ndarray:
    """Z = A'A O over all passages, rows of A of unit length. known: ``terms_of`` the rows, if it is at hand."""
    weight = idf.astype(np.float32)

    def run(batches):
        omega = np.vstack([random_test_matrix() * weight[:, None], np.zeros((1, RANK + OVERSAMPLE), np.float32)])
        total, ones = np.zeros((TERMS, RANK + OVERSAMPLE)), np.ones((1, PASSAGE), np.float32)
        for batch in batches:
            for row in range(len(batch)):
                held = np.frombuffer(batch.column("terms")[row].as_buffer(), "<u2").astype(np.int64)
                counts = np.frombuffer(batch.column("counts")[row].as_buffer(), "<u4").astype(np.int64)
                passage, term, count = _cells(counts, held)
                w = count.astype(np.float32) * weight[term]
                norm = np.sqrt(np.add.reduceat(w * w, np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))))
                # Each word adds its row, so that no counts are needed from here on.
                own, padded = _passages(counts), np.append(held, TERMS)
                first = np.searchsorted(own, np.arange(len(norm) + 1))
                y = np.empty((len(norm), RANK + OVERSAMPLE), np.float32)
                for a in range(0, len(y), SKETCH_WORDS // PASSAGE):
                    lo = first[a : a + SKETCH_WORDS // PASSAGE + 1, None]
                    at = lo[:-1] + np.arange(PASSAGE)
                    y[a : a + len(at)] = np.matmul(ones, omega.take(padded.take(np.where(at < lo[1:], at, len(held))), axis=0))[:, 0]
                y /= np.square(np.maximum(norm, 1e-6))[:, None]
                order = np.argsort(padded[:-1].astype(np.int16), kind="stable")  # 14 bits, by radix
                term, own = padded[order], own[order]
                # Words of one term in groups of a passage's size are summed by a product, which is faster than the sum of what remains.
                head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                size = np.diff(np.append(head, len(term)))
                full = size // PASSAGE
                before = np.cumsum(full) - full
                start = np.repeat(head - before * PASSAGE, full) + np.arange(full.sum()) * PASSAGE
                sums = np.empty((len(start), RANK + OVERSAMPLE), np.float32)
                for a in range(0, len(start), SKETCH_WORDS // PASSAGE):
                    at = start[a : a + SKETCH_WORDS // PASSAGE, None] + np.arange(PASSAGE)
                    sums[a : a + len(at)] = np.matmul(ones, y.take(own[at], axis=0))[:, 0]
                if len(sums):
                    total[term[head[full > 0]]] += np.add.reduceat(sums, before[full > 0], axis=0)
                rest = np.arange(len(term)) >= np.repeat(head + full * PASSAGE, size)
                term, own = term[rest], own[rest]
                for a in range(0, len(term), SKETCH_WORDS):
                    rows = term[a : a + SKETCH_WORDS]
                    head = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                    total[rows[head]] += np.add.reduceat(y.take(own[a : a + SKETCH_WORDS], axis=0), head, axis=0)
        total *= weight[:, None]
        some = np.flatnonzero(np.abs(total).sum(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, j]) for j in range(total.shape[1]))], names=["term", *(f"c{j}" for j in range(total.shape[1]))])

    known = terms_of(docs, key, text) if known is None else known
    parts = known.where(F.col("term").isNull()).select("terms", "counts").mapInArrow(run, "term long, " + SKETCH)
    got = parts.groupBy("term").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(RANK + OVERSAMPLE))).toPandas()
    z = np.zeros((TERMS, RANK + OVERSAMPLE))
    if len(got):
        z[got["term"].to_numpy()] = got[[f"c{j}" for j in range(RANK + OVERSAMPLE)]].to_numpy()
    return z


def singular_vectors(z: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors of A and its singular values, from the sketch."""
    omega = random_test_matrix(z.shape[1]).astype(float)
    core = omega.T @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > max(value.max(initial=0), 1e-12) * 1e-9
    half = z @ (vector[:, keep] / np.sqrt(value[keep]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return u[:, :rank], s[:rank]


@dataclass
class Items:
    """A block of the benchmark: words of each item, its answer's words, latent vectors, kinds of windows, and what words it holds how often."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vectors: np.ndarray
    window: np.ndarray
    part: np.ndarray
    vocabulary: np.ndarray  # sorted hashes of all items' words
    held: np.ndarray  # sorted item * len(vocabulary) + word
    times: np.ndarray

    def places(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes in the vocabulary, -1 for others: a table by leading bits gives the first of a few to look at."""
        bits = np.uint64(64 - max(8, len(self.vocabulary).bit_length() + 4))
        first = np.searchsorted(self.vocabulary, np.arange(1 << int(64 - bits), dtype=np.uint64) << bits).astype(np.int32)
        most = int(np.unique(self.vocabulary >> bits, return_counts=True)[1].max())
        at, out = first[h >> bits], np.full(len(h), -1)
        for k in range(most):
            here = np.minimum(at + k, len(self.vocabulary) - 1)
            out = np.where(self.vocabulary[here] == h, here, out)
        return out

    @cached_property
    def marks(self) -> np.ndarray:
        """For each item a row of ``MARKS`` + 1 places: whether the item holds a word of the vocabulary that falls on a place, from place 1 on."""
        out = np.zeros((len(self.ids), MARKS + 1), bool)
        out[self.held // len(self.vocabulary), 1 + self.held % len(self.vocabulary) % MARKS] = True
        return out


def project(docs: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """For each term its inverse document frequency times its row of the singular vectors, divided by the singular values."""
    known = terms_of(docs, key, text)
    df, n = document_frequencies(docs, key, text, known)
    idf = np.log((n + 1) / (df + 0.5))
    v, s = singular_vectors(sketch(docs, idf, key, text, known))
    out = np.zeros((TERMS, RANK), np.float32)
    if len(s):
        out[:, : v.shape[1]] = idf[:, None] * v / np.maximum(s, s.max() * 1e-3)
        # Dividing by small singular values blows rare words up; none may weigh more than the median word.
        norm = np.linalg.norm(out, axis=1)
        out *= np.minimum(1, np.median(norm[df > 0]) / np.maximum(norm, 1e-12))[:, None]
    return out


def _hash(text: str | None) -> np.ndarray:
    raw = (text or "").lower().encode()
    return _words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1]


def grain_of(size: int) -> int:
    """Words in a block of windows of about ``size`` words."""
    return 2 * GRAIN if size >= 2 * EXACT else GRAIN if size >= EXACT else max(1, size // 4)


def window_of(n: int) -> int:
    """The length of the windows that an item of n words is compared with: n, or within an eighth of it."""
    step = max(grain_of(n), GRAIN << max(0, (n // EXACT).bit_length() - 1) if n >= EXACT else 0)
    return (n + step // 2) // step * step


def benchmark_items(rows: list, projection: np.ndarray) -> Items:
    """rows: (id, text, answer or None)."""
    # In the order of their lengths, so that items of one kind of window lie side by side.
    kept = sorted(((i, h, a) for i, t, a in rows if len(h := _hash(t))), key=lambda x: len(x[1]))
    words = [h for _, h, _ in kept]
    answers = [_hash(a) if a else h[-ANSWER_WORDS:] for _, h, a in kept]
    vectors = np.array([projection[_terms(h)].sum(0) for h in words], np.float32).reshape(-1, RANK)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    window = np.array([window_of(len(h)) for h in words], np.int64)
    part = np.array([max((w for w in PARTS if w <= 1.15 * len(h)), default=PARTS[0]) for h in words], np.int64)
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    owned = [np.searchsorted(vocabulary, h) + j * len(vocabulary) for j, h in enumerate(words)]
    held, times = np.unique(np.concatenate(owned), return_counts=True) if words else (np.zeros(0, np.int64),) * 2
    return Items([i for i, _, _ in kept], words, answers, vectors, window, part, vocabulary, held, times)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _blocks(words: Words, term: np.ndarray, projection: np.ndarray, grain: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of projections over blocks of ``grain`` words, the first block of each text, and the number of its blocks.

    Texts of fewer than ``least`` blocks are filled up with zeros, so that no window reaches into the next text.
    """
    many = -(-words.counts // grain)
    first = np.concatenate([[0], np.cumsum(np.where(many > 0, np.maximum(many, least), 0))])
    text = np.repeat(np.arange(len(many)), np.diff(first))
    start = (np.arange(first[-1]) - first[text]) * grain + words.first[text]
    end = words.first[text + 1]
    padded = np.append(term, TERMS)  # the row of zeros
    out = np.empty((first[-1], RANK), np.float32)
    for lo in range(0, len(out), CHUNK):
        at, stop = start[lo : lo + CHUNK], end[lo : lo + CHUNK]
        sums = projection.take(padded[np.where(at < stop, at, len(term))], axis=0)
        for k in range(1, grain):
            sums += projection.take(padded[np.where(at + k < stop, at + k, len(term))], axis=0)
        out[lo : lo + CHUNK] = sums
    return out, first, many


def _starts(first: np.ndarray, many: np.ndarray, size: int, grain: int) -> np.ndarray:
    """The blocks where windows of ``size`` words start: a quarter of that apart at most, and one that ends with the text."""
    step = max(1, min(size // 4, STRIDE) // grain)
    last = np.maximum(many - size // grain, 0)
    n = np.where(many > 0, -(-last // step) + 1, 0)
    text = np.repeat(np.arange(len(many)), n)
    return first[text] + np.minimum((np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step, last[text])


def _alike(blocks: np.ndarray, starts: dict[int, np.ndarray], of: dict[int, tuple[int, int]], vectors: np.ndarray):
    """size (in blocks), start blocks and items of the windows that have the cosine that is asked for. of: the range of items for each size.

    Windows are summed by size, each size from the one below, and multiplied with the items of that size while they are in the cache.
    """
    most = max(of)
    for lo in range(0, len(blocks), WINDOWS):
        part = blocks[lo : lo + WINDOWS + most]
        sums, held = part, 1
        for size in sorted(of):
            n = min(WINDOWS, len(part) - size + 1)
            if n <= 0:
                break
            sums = sums[: len(part) - size + 1].copy() if held == 1 else sums[: len(part) - size + 1]
            for k in range(held, size):
                sums += part[k : k + len(sums)]
            held = size
            at = starts[size]
            at = at[np.searchsorted(at, lo) : np.searchsorted(at, lo + n)] - lo
            if not len(at):
                continue
            own = sums[:n] if len(at) == n else sums[at]
            need = COSINE * np.sqrt(np.maximum(np.einsum("ij,ij->i", own, own), 1e-12))[:, None]
            for a in range(*of[size], TILE):
                tile = vectors[a : min(a + TILE, of[size][1])]
                hit = np.flatnonzero(own @ tile.T >= need)
                if len(hit):
                    yield size, at[hit // len(tile)] + lo, hit % len(tile) + a


def _joined(hits):
    """size, block and item of hits, ``CHUNK`` of them or more at a time."""
    some, n = [], 0
    for size, block, item in hits:
        some.append((np.full(len(block), size), block, item))
        n += len(block)
        if n >= CHUNK:
            yield tuple(np.concatenate(x) for x in zip(*some, strict=True))
            some, n = [], 0
    if some:
        yield tuple(np.concatenate(x) for x in zip(*some, strict=True))


def _held(place: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """For each region place[lo:hi], none of them empty, at least as many words as ``_bounds`` gives: those that fall on a place that the item marks."""
    out = np.zeros(len(lo), np.int64)
    marks = items.marks.view(np.uint8).ravel()
    for a in range(0, len(lo), CHUNK):
        b0, b1 = lo[a : a + CHUNK], hi[a : a + CHUNK]
        n = b1 - b0
        ends = np.cumsum(n)
        at = np.ones(ends[-1], np.int64)
        at[0], at[ends[:-1]] = b0[0], b0[1:] - b1[:-1] + 1
        word = place.take(np.cumsum(at, out=at))
        out[a : a + CHUNK] = np.add.reduceat(marks.take(np.repeat(item[a : a + CHUNK] * (MARKS + 1), n) + np.where(word < 0, 0, 1 + word % MARKS)), ends - n, dtype=np.int32)
    return out


def _bounds(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """For each region h[lo:hi] how many of the item's words it holds, repeated ones as often as both do: no common subsequence is longer."""
    out = np.zeros(len(lo), np.int64)
    n_words = len(items.vocabulary)
    for a in range(0, len(lo), CHUNK):
        n = hi[a : a + CHUNK] - lo[a : a + CHUNK]
        ends = np.cumsum(n)
        who = np.repeat(np.arange(len(n)), n)
        word = h[np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(lo[a : a + CHUNK], n)]
        key = word + np.repeat(item[a : a + CHUNK], n) * n_words
        at = np.minimum(np.searchsorted(items.held, key), len(items.held) - 1)
        known = (word >= 0) & (items.held[at] == key)
        both = np.sort(who[known] * len(items.held) + at[known])
        head = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        times = np.minimum(np.diff(np.append(head, len(both))), items.times[both[head] % len(items.held)])
        out[a : a + CHUNK] = np.bincount(both[head] // len(items.held), weights=times, minlength=len(n))
    return out


def _range(some: np.ndarray) -> tuple[int, int]:
    at = np.flatnonzero(some)
    return int(at[0]), int(at[-1]) + 1


def matches(words: Words, h: np.ndarray, items: Items, projection: np.ndarray) -> dict[tuple[int, int], tuple[float, bool, int]]:
    """By text and item: the share of the item in the common subsequence, whether the answer is there, and the window's first word, of the best match."""
    best: dict[tuple[int, int], tuple[float, bool, int]] = {}
    if not len(words) or not items.ids:
        return best
    term, place = _terms(h), items.places(h)
    lengths = np.array([len(w) for w in items.words])
    padded = np.vstack([projection, np.zeros((1, RANK), np.float32)])
    sizes = np.unique(np.append(items.window, items.part))
    for grain in sorted({grain_of(int(x)) for x in sizes}):
        of = {int(x) // grain: _range((items.window == x) | (items.part == x)) for x in sizes if grain_of(int(x)) == grain}
        blocks, first, many = _blocks(words, term, padded, grain, max(of))
        starts = {size: _starts(first, many, size * grain, grain) for size in of}
        for size, block, item in _joined(_alike(blocks, starts, of, items.vectors)):
            text = np.searchsorted(first, block, side="right") - 1
            lo = words.first[text] + (block - first[text]) * grain
            long = size * grain
            pad = np.maximum(0, lengths[item] - long) + np.maximum(BLOCK, long // 4)
            b0, b1 = np.maximum(words.first[text], lo - pad), np.minimum(words.first[text + 1], lo + long + pad)
            some = np.flatnonzero(_held(place, b0, b1, item, items) >= PARAPHRASE * lengths[item])
            for c in some[_bounds(place, b0[some], b1[some], item[some], items) >= PARAPHRASE * lengths[item[some]]]:
                i, t = int(item[c]), int(text[c])
                own, before = items.words[i], best.get((t, i), (0.0,))[0]
                if before >= 1:
                    continue
                region = h[b0[c] : b1[c]].tolist()
                share = lcs(own.tolist(), region) / len(own)
                if share < PARAPHRASE or share <= before:
                    continue
                answer = items.answers[i].tolist()
                found = lcs(answer, region) >= ANSWER_SHARE * len(answer)
                if share >= VERBATIM or found:
                    best[t, i] = share, found, int(lo[c] - words.first[t])
    return best


FOUND = "key long, item long, lcs_share double, answer_found boolean, word_offset long"


def search(docs: DataFrame, items: Items, projection: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs`` and item that match."""
    types = pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64()

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column("body")):
                own = batch.column("key")[lo:hi]
                rows = [(own[t].as_py(), items.ids[i], *found) for (t, i), found in sorted(matches(*_words(buf, offsets), items, projection).items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "item", "lcs_share", "answer_found", "word_offset"])

    return text_of(docs, key, text, lower=True).mapInArrow(run, FOUND)


def _item_blocks(benchmark: DataFrame, projection: np.ndarray, item: str) -> Iterator[Items]:
    """The benchmark in blocks, in the memory of the driver one at a time."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = materialise(benchmark.select(F.col(item).cast("long").alias("item"), F.col("text").alias("text"), answer.alias("answer")), "benchmark")
    blocks = max(1, -(-rows.count() // ITEMS))
    for b in range(blocks):
        held = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        yield benchmark_items([(r["item"], r["text"], r["answer"]) for r in held], projection)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """doc_id, item_id, share of the item found, whether its answer was, kind (verbatim or paraphrase) and place, for each match."""
    projection = project(docs, key, text)
    parts = reduce(DataFrame.union, [search(docs, items, projection, key, text) for items in _item_blocks(benchmark, projection, item)])
    kind = F.when(F.col("lcs_share") >= VERBATIM, "verbatim").otherwise("paraphrase")
    return parts.select(F.col("key").alias(key), F.col("item").alias(item), "lcs_share", "answer_found", kind.alias("kind"), "word_offset")


def keep(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of ``docs`` in whose text no item is found."""
    projection = project(docs, key, text)
    for items in _item_blocks(benchmark, projection, item):

        def clean(words: Words, items: Items = items) -> np.ndarray:
            out = np.ones(len(words.first) - 1, bool)
            out[[t for t, _ in matches(*_words(words.buf, words.offsets), items, projection)]] = False
            return out

        docs = keep_rows(docs, clean, text, lower=True)
    return docs


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
