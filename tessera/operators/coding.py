"""Entropy coding of ITU-T T.800: the MQ arithmetic coder (annex C), bit streams with stuffing and tag trees (annex B.10).

These are bit-serial, so they are functions over one code block's or one packet's bytes, for Arrow batches; blocks are independent of each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions.workers import ship

#: Fixed values of table C.2: probability of the less probable symbol, next state after it and after the more probable one, and whether their roles are exchanged.
STATES = [
    (0x5601, 1, 1, 1), (0x3401, 6, 2, 0), (0x1801, 9, 3, 0), (0x0AC1, 12, 4, 0), (0x0521, 29, 5, 0), (0x0221, 33, 38, 0), (0x5601, 6, 7, 1), (0x5401, 14, 8, 0),
    (0x4801, 14, 9, 0), (0x3801, 14, 10, 0), (0x3001, 17, 11, 0), (0x2401, 18, 12, 0), (0x1C01, 20, 13, 0), (0x1601, 21, 29, 0), (0x5601, 14, 15, 1), (0x5401, 14, 16, 0),
    (0x5101, 15, 17, 0), (0x4801, 16, 18, 0), (0x3801, 17, 19, 0), (0x3401, 18, 20, 0), (0x3001, 19, 21, 0), (0x2801, 19, 22, 0), (0x2401, 20, 23, 0), (0x2201, 21, 24, 0),
    (0x1C01, 22, 25, 0), (0x1801, 23, 26, 0), (0x1601, 24, 27, 0), (0x1401, 25, 28, 0), (0x1201, 26, 29, 0), (0x1101, 27, 30, 0), (0x0AC1, 28, 31, 0), (0x09C1, 29, 32, 0),
    (0x08A1, 30, 33, 0), (0x0521, 31, 34, 0), (0x0441, 32, 35, 0), (0x02A1, 33, 36, 0), (0x0221, 34, 37, 0), (0x0141, 35, 38, 0), (0x0111, 36, 39, 0), (0x0085, 37, 40, 0),
    (0x0049, 38, 41, 0), (0x0025, 39, 42, 0), (0x0015, 40, 43, 0), (0x0009, 41, 44, 0), (0x0005, 42, 45, 0), (0x0001, 43, 45, 0), (0x5601, 46, 46, 0),
]


class Contexts:
    """State and more probable symbol of each context."""

    def __init__(self, n: int, first: dict[int, int] | None = None):
        self.state, self.likely = [(first or {}).get(i, 0) for i in range(n)], [0] * n

    def after(self, context: int, bit: int) -> None:
        _, lps, mps, exchange = STATES[self.state[context]]
        if bit == self.likely[context]:
            self.state[context] = mps
        else:
            self.likely[context] ^= exchange
            self.state[context] = lps


class MqEncoder:
    def __init__(self, contexts: Contexts):
        self.contexts, self.a, self.c, self.wait, self.out = contexts, 0x8000, 0, 12, bytearray([0])

    def _byte(self) -> None:
        """Moves finished bits out of the register; a byte of ones is followed by one of seven bits."""
        if self.out[-1] != 0xFF and self.c >= 0x8000000:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
            if self.out[-1] == 0xFF:
                self.c &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20)
            self.c &= 0xFFFFF
            self.wait = 7
        else:
            self.out.append(self.c >> 19)
            self.c &= 0x7FFFF
            self.wait = 8

    def _shift(self) -> None:
        while True:
            self.a, self.c, self.wait = self.a << 1, self.c << 1, self.wait - 1
            if not self.wait:
                self._byte()
            if self.a & 0x8000:
                return

    def put(self, bit: int, context: int) -> None:
        qe = STATES[self.contexts.state[context]][0]
        likely = bit == self.contexts.likely[context]
        self.a -= qe
        if likely and self.a & 0x8000:
            self.c += qe
            return
        # The smaller part of the interval is the less probable symbol's, whichever it is named for.
        if (self.a < qe) == likely:
            self.a = qe
        else:
            self.c += qe
        self.contexts.after(context, bit)
        self._shift()

    def flush(self) -> bytes:
        full = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= full:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.wait
            self._byte()
        if self.out[-1] == 0xFF:
            self.out.pop()
        return bytes(self.out[1:])


class MqDecoder:
    """Reads beyond the end of the data as ones."""

    def __init__(self, data: bytes, contexts: Contexts):
        self.contexts, self.data, self.at = contexts, data, 0
        self.c = self._at(0) << 16
        self._byte()
        self.c <<= 7
        self.wait, self.a = self.wait - 7, 0x8000

    def _at(self, i: int) -> int:
        return self.data[i] if i < len(self.data) else 0xFF

    def _byte(self) -> None:
        if self._at(self.at) == 0xFF:
            if self._at(self.at + 1) > 0x8F:
                self.c += 0xFF00
                self.wait = 8
            else:
                self.at += 1
                self.c += self._at(self.at) << 9
                self.wait = 7
        else:
            self.at += 1
            self.c += self._at(self.at) << 8
            self.wait = 8

    def get(self, context: int) -> int:
        qe = STATES[self.contexts.state[context]][0]
        likely = self.contexts.likely[context]
        self.a -= qe
        if (self.c >> 16) & 0xFFFF < qe:  # the lower part of the interval
            bit = likely if self.a < qe else 1 - likely
            self.a = qe
        else:
            self.c -= qe << 16
            if self.a & 0x8000:
                return likely
            bit = 1 - likely if self.a < qe else likely
        self.contexts.after(context, bit)
        while True:
            if not self.wait:
                self._byte()
            self.a, self.c, self.wait = self.a << 1, (self.c << 1) & 0xFFFFFFFF, self.wait - 1
            if self.a & 0x8000:
                return bit


class BitWriter:
    """Bits, most significant first; after a byte of ones the next has seven bits."""

    def __init__(self):
        self.out, self.held, self.n, self.room = bytearray(), 0, 0, 8

    def put(self, value: int, bits: int = 1) -> None:
        for k in range(bits - 1, -1, -1):
            self.held = self.held << 1 | value >> k & 1
            self.n += 1
            if self.n == self.room:
                self.out.append(self.held)
                self.room = 7 if self.held == 0xFF else 8
                self.held = self.n = 0

    def flush(self) -> bytes:
        if self.n or self.room == 7:
            self.put(0, self.room - self.n)
        return bytes(self.out)


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.left, self.held = data, 0, 0, 0

    def get(self, bits: int = 1) -> int:
        out = 0
        for _ in range(bits):
            if not self.left:
                stuffed = self.held == 0xFF
                if self.at >= len(self.data):
                    raise EOFError
                self.held, self.left = self.data[self.at], 7 if stuffed else 8
                self.at += 1
            self.left -= 1
            out = out << 1 | self.held >> self.left & 1
        return out


class TagTree:
    """A tree of minima over a grid of leaves. ``put`` and ``get`` send what of a leaf's path isn't known up to a threshold."""

    def __init__(self, width: int, height: int, values: Sequence[int] | None = None):
        self.sizes = [(width, height)]
        while self.sizes[-1] != (1, 1) and width and height:
            w, h = self.sizes[-1]
            self.sizes.append((-(-w // 2), -(-h // 2)))
        self.low = [[0] * (w * h) for w, h in self.sizes]
        self.known = [[False] * (w * h) for w, h in self.sizes]
        self.value = [list(values)] if values is not None else []
        for (w, h), (up_w, up_h) in zip(self.sizes, self.sizes[1:], strict=False) if values is not None else ():
            up = [math.inf] * (up_w * up_h)
            for y in range(h):
                for x in range(w):
                    up[y // 2 * up_w + x // 2] = min(up[y // 2 * up_w + x // 2], self.value[-1][y * w + x])
            self.value.append(up)

    def _path(self, x: int, y: int) -> Iterator[tuple[int, int]]:
        for level in range(len(self.sizes) - 1, -1, -1):
            yield level, (y >> level) * self.sizes[level][0] + (x >> level)

    def _walk(self, x: int, y: int, threshold: int, step: Callable[[int, int], int]) -> bool:
        """Whether the leaf's value is below the threshold; step tells, or sends, whether a node's value is its lower bound."""
        low = 0
        for level, i in self._path(x, y):
            self.low[level][i] = low = max(low, self.low[level][i])
            while low < threshold and not self.known[level][i]:
                if step(level, i):
                    self.known[level][i] = True
                else:
                    low += 1
                self.low[level][i] = low
            low = self.low[level][i]
        return self.known[0][i] and low < threshold

    def put(self, out: BitWriter, x: int, y: int, threshold: int) -> bool:
        def step(level: int, i: int) -> int:
            bit = int(self.value[level][i] <= self.low[level][i])
            out.put(bit)
            return bit

        return self._walk(x, y, threshold, lambda level, i: step(level, i))

    def get(self, data: BitReader, x: int, y: int, threshold: int) -> bool:
        return self._walk(x, y, threshold, lambda level, i: data.get())

    def leaf(self, data: BitReader, x: int, y: int) -> int:
        """A leaf's value, read with rising thresholds."""
        threshold = 1
        while not self.get(data, x, y, threshold):
            threshold += 1
        return self.low[0][y * self.sizes[0][0] + x]


#: Contexts of a block coder: 19, of which the first (zero coding), run length and uniform ones begin in other states.
BLOCK_CONTEXTS, FIRST_STATES = 19, {0: 4, 17: 3, 18: 46}


def mq_encode(bits: Sequence[int], contexts: Sequence[int]) -> bytes:
    coder = MqEncoder(Contexts(BLOCK_CONTEXTS, FIRST_STATES))
    for bit, context in zip(bits, contexts, strict=True):
        coder.put(bit, context)
    return coder.flush()


def mq_decode(data: bytes, contexts: Sequence[int]) -> list[int]:
    coder = MqDecoder(data, Contexts(BLOCK_CONTEXTS, FIRST_STATES))
    return [coder.get(c) for c in contexts]


#: The same by 2 * state + more probable symbol: probability, and what follows the more and the less probable symbol.
_QE = [STATES[i >> 1][0] for i in range(2 * len(STATES))]
_AFTER_MORE = [2 * STATES[i >> 1][2] + (i & 1) for i in range(2 * len(STATES))]
_AFTER_LESS = [2 * STATES[i >> 1][1] + (i & 1 ^ STATES[i >> 1][3]) for i in range(2 * len(STATES))]


def block_encode(symbols: list[int]) -> bytes:
    """As ``MqEncoder`` codes a block's symbols, each 2 * context + bit, in one loop."""
    index = [2 * FIRST_STATES.get(i, 0) for i in range(BLOCK_CONTEXTS)]
    coder = MqEncoder(Contexts(0))
    a, c, wait, out = coder.a, coder.c, coder.wait, coder.out
    for symbol in symbols:
        at = index[symbol >> 1]
        qe = _QE[at]
        a -= qe
        if (symbol ^ at) & 1:
            if a < qe:
                c += qe
            else:
                a = qe
            index[symbol >> 1] = _AFTER_LESS[at]
        else:
            if a & 0x8000:
                c += qe
                continue
            if a < qe:
                a = qe
            else:
                c += qe
            index[symbol >> 1] = _AFTER_MORE[at]
        n = 16 - a.bit_length()
        a <<= n
        while n >= wait:
            n -= wait
            coder.c = c << wait
            coder._byte()
            c, wait = coder.c, coder.wait
        c <<= n
        wait -= n
    coder.a, coder.c, coder.wait = a, c, wait
    return coder.flush()


def block_reader(data: bytes) -> Callable[[int, int], int]:
    """``MqDecoder.get`` of a block's contexts as one function; its second argument is not used."""
    index = [2 * FIRST_STATES.get(i, 0) for i in range(BLOCK_CONTEXTS)]
    first = MqDecoder(data, Contexts(0))
    a, c, wait, at, held = first.a, first.c, first.wait, first.at, bytes(data) + b"\xff\xff"

    def get(context: int, _: int = 0) -> int:
        nonlocal a, c, wait, at
        i = index[context]
        qe = _QE[i]
        a -= qe
        if (c >> 16) & 0xFFFF < qe:
            likely = a < qe
            a = qe
        else:
            c -= qe << 16
            if a & 0x8000:
                return i & 1
            likely = a >= qe
        index[context] = _AFTER_MORE[i] if likely else _AFTER_LESS[i]
        n = 16 - a.bit_length()
        a <<= n
        while n > wait:
            n -= wait
            c = (c << wait) & 0xFFFFFFFF
            if held[at] != 0xFF:
                at += 1
                c += held[at] << 8
                wait = 8
            elif held[at + 1] > 0x8F:
                c += 0xFF00
                wait = 8
            else:
                at += 1
                c += held[at] << 9
                wait = 7
        c = (c << n) & 0xFFFFFFFF
        wait -= n
        return i & 1 if likely else 1 - (i & 1)

    return get


def _symbols(batch: pa.RecordBatch) -> Iterator[tuple[int, list[int], list[int]]]:
    yield from zip(*(batch.column(c).to_pylist() for c in ("block", "bits", "contexts")), strict=True)


def encode_blocks(blocks: DataFrame) -> DataFrame:
    """block, contexts and data from block, bits and contexts."""
    ship(blocks.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [(k, c, mq_encode(b, c)) for k, b, c in _symbols(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.int32()), pa.binary()), strict=True)], names=["block", "contexts", "data"]) if rows else batch.slice(0, 0).select([])

    return blocks.select("block", "bits", "contexts").mapInArrow(run, "block long, contexts array<int>, data binary")


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """block and bits from block, contexts and data."""
    ship(blocks.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bits = [mq_decode(d, c) for c, d in zip(batch.column("contexts").to_pylist(), batch.column("data").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(bits, pa.list_(pa.int32()))], names=["block", "bits"])

    return blocks.select("block", "contexts", "data").mapInArrow(run, "block long, bits array<int>")


def stuff(bits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, and their number for each string, of strings of so many bits that follow each other, as ``BitWriter`` makes them; a step writes a byte of every string."""
    ends = np.cumsum(sizes)
    at, last, padded = ends - sizes, np.zeros(len(sizes), np.uint8), np.append(bits, 0).astype(np.uint8)
    live, whose, out = np.flatnonzero(sizes > 0), [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    while len(live):
        short = last[live] == 0xFF
        places = at[live][:, None] + np.arange(8)
        byte = np.packbits(np.where(places < ends[live][:, None], padded[np.minimum(places, len(bits))], 0), axis=1)[:, 0]
        byte = np.where(short, byte >> 1, byte)
        at[live] += 8 - short
        last[live] = byte
        whose.append(live)
        out.append(byte)
        live = live[(at[live] < ends[live]) | (byte == 0xFF)]
    owner = np.concatenate(whose)
    return np.concatenate(out)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))


def unstuff(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bits of strings of so many bytes, their number for each string, and the byte that each bit lies in."""
    after = np.append(False, data == 0xFF)[: len(data)]
    after[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    kept = np.ones((len(data), 8), bool)
    kept[after, 0] = False
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.unpackbits(data).reshape(-1, 8)[kept], np.bincount(owner, 8 - after, len(sizes)).astype(np.int64), np.repeat(np.arange(len(data)), 8)[kept.reshape(-1)]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of about so many rows that hold whole groups; the batches come in the order of ``key``."""
    held, n, least = [], 0, rows
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), n - cut
            least = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def code_tag_trees(tree: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values as read back from the coded bits of many trees at once, and their tree's bytes, for each leaf. Leaves come in the order of tree, y, x.

    Leaves are sent whole, one after another, so each node is sent once, when its first leaf comes: as many zeros as its value exceeds its parent's by, then a one.
    """
    if len(v) and min(v.min(), y.min(), x.min()) < 0:
        raise ValueError("places and values of a tag tree's leaves are not negative")
    starts = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
    t = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(tree))))
    h, w = np.maximum.reduceat(y, starts) + 1, np.maximum.reduceat(x, starts) + 1
    depth, side = np.zeros(len(starts), np.int64), np.maximum(h, w)
    while (side > 1).any():
        depth += side > 1
        side = (side + 1) // 2
    # A level's nodes: tree, line, column, least value, number of cells with a leaf, first leaf; and each child's place in it.
    levels, above, (nt, ny, nx, value, cells, first) = [], [], (t, y, x, v, np.ones(len(v), np.int64), np.arange(len(v)))
    for level in range(int(depth.max()) + 1):
        rise = depth[nt] >= level
        shift = int(level > 0)
        key = ((nt * (int(h.max()) + 1) + (ny >> shift)) * (int(w.max()) + 1) + (nx >> shift))[rise]
        _, at, place = np.unique(key, return_index=True, return_inverse=True)
        order = np.argsort(place, kind="stable")
        cuts = np.append(True, np.diff(place[order]) > 0).nonzero()[0]
        up = np.full(len(nt), -1)
        up[rise] = place
        above.append(up)
        if level:
            value, cells = np.minimum.reduceat(value[rise][order], cuts), np.add.reduceat(cells[rise][order], cuts)
        else:
            value, cells = v[order[np.append(cuts[1:], len(order)) - 1]], cells[at]
        first = np.minimum.reduceat(first[rise][order], cuts)
        nt, ny, nx = nt[rise][at], (ny[rise] >> shift)[at], (nx[rise] >> shift)[at]
        area = (np.minimum(h[nt], (ny + 1) << level) - (ny << level)) * (np.minimum(w[nt], (nx + 1) << level) - (nx << level))
        levels.append((nt, first, np.where(cells < area, 0, value)))
    above.append(np.full(len(nt), -1))
    more = [own - np.where(up >= 0, np.append(levels[i + 1][2], 0)[up] if i + 1 < len(levels) else 0, 0) for i, ((_, _, own), up) in enumerate(zip(levels, above[1:], strict=True))]
    trees, firsts, more = (np.concatenate(c) for c in ([a for a, _, _ in levels], [b for _, b, _ in levels], more))
    order = np.lexsort((-np.repeat(np.arange(len(levels)), [len(a) for a, _, _ in levels]), firsts))
    lengths = (more + 1)[order]
    bits = np.zeros(int(lengths.sum()), np.uint8)
    bits[np.cumsum(lengths) - 1] = 1
    data, sizes = stuff(bits, np.bincount(trees, more + 1, len(starts)).astype(np.int64))
    # Back: the ones end the nodes, in the same order.
    read, counts, _ = unstuff(data, sizes)
    ones, ends, owner = np.flatnonzero(read), np.cumsum(counts), trees[order]
    if len(ones) != len(order) or (np.searchsorted(ends, ones, "right") != owner).any():
        raise ValueError("a tag tree's bits don't end its nodes")
    before = np.append(-1, ones[:-1])
    opens = np.append(True, owner[1:] != owner[:-1])
    before[opens] = (ends - counts)[owner[opens]] - 1
    got = np.empty(len(order), np.int64)
    got[order] = ones - before - 1
    parts = np.split(got, np.cumsum([len(a) for a, _, _ in levels])[:-1])
    for i in range(len(levels) - 2, -1, -1):
        up = above[i + 1]
        parts[i] += np.where(up >= 0, parts[i + 1][up], 0)
    return parts[0][above[0]], sizes[t]


def code_tag_tree(leaves: DataFrame) -> DataFrame:
    """tree, x, y, v as read back from each tree's coded bits, and their number. leaves: (tree, x, y, v); a tree covers one precinct's blocks. Many trees are coded at once."""
    ship(leaves.sparkSession)

    def run(batches):
        for table in whole_groups(batches, "tree"):
            tree, y, x, v = (table.column(c).to_numpy() for c in ("tree", "y", "x", "v"))
            back, n = code_tag_trees(tree, y, x, v)
            yield from pa.table([pa.array(a) for a in (tree, x, y, back, n)], names=["tree", "x", "y", "v", "n"]).to_batches(1 << 14)

    placed = leaves.select(*(leaves[c].cast("long").alias(c) for c in ("tree", "x", "y", "v")))
    return placed.repartition("tree").sortWithinPartitions("tree", "y", "x").mapInArrow(run, "tree long, x long, y long, v long, n long")
