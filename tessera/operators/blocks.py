"""Code blocks (ITU-T T.800 annex D) and packet headers (annex B.10): bit planes to coded bytes and back, on top of ``coding``.

A block is at most 64 by 64 samples, coded alone; a header belongs to one packet of one precinct. Both are functions for Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.functions.workers import ship
from tessera.operators.coding import BitReader, BitWriter, TagTree, block_encode, block_reader, stuff, unstuff, whole_groups

SIGN, REFINE, RUN, UNIFORM = 9, 14, 17, 18


def _zero_contexts(band: str) -> list[int]:
    """Context of a sample that isn't significant yet, by 15 h + 5 v + d: significant neighbours in its line (h), its column (v) and at its corners (d)."""
    out = []
    for n in range(45):
        h, v, d = n // 15, n // 5 % 3, n % 5
        if band == "HH":
            straight = min(h + v, 2)
            out.append((straight, 3 + straight, 6 + min(straight, 1), 8)[min(d, 3)])
            continue
        if band == "HL":
            h, v = v, h
        out.append(8 if h == 2 else (7 if v else 6 if d else 5) if h else 2 + v if v else min(d, 2))
    return out


_ZERO = {band: _zero_contexts(band) for band in ("LL", "LH", "HL", "HH")}


def _sign_context(h: int, v: int) -> tuple[int, int]:
    """Context, and whether the sign is sent flipped, from the clamped sums of the neighbours' signs in the line and in the column."""
    flip = h < 0 or (h == 0 and v < 0)
    if flip:
        h, v = -h, -v
    return SIGN + 3 * h + v, int(flip)


#: The same by 5 * (h + 2) + v + 2, of sums that aren't clamped yet.
_SIGNS = [_sign_context(max(-1, min(1, h)), max(-1, min(1, v))) for h in range(-2, 3) for v in range(-2, 3)]


@lru_cache(64)
def _columns(w: int, h: int) -> list[tuple[int, ...]]:
    """Places, within a border, of the samples of each column of each stripe of four lines."""
    return [tuple((y + 1) * (w + 2) + x + 1 for y in range(top, min(top + 4, h))) for top in range(0, h, 4) for x in range(w)]


def _run(w: int, h: int, band: str, planes: int, passes: int, io: Callable[[int, int], int], value: list[int], negative: list[int]) -> tuple[list[int], list[int]]:
    """Signs and magnitudes, with a border, after the first ``passes`` passes. io codes a bit in a context, or reads one; value and negative (bordered) are what is coded."""
    stride, columns = w + 2, _columns(w, h)
    places, n, zero = [i for column in columns for i in column], (w + 2) * (h + 2), _ZERO[band]
    # near: 15 h + 5 v + d of significant neighbours, kept as samples turn significant.
    sign, magnitude, near, refined = [0] * n, [0] * n, [0] * n, bytearray(n)

    def become(i: int, one: int) -> None:
        """A sample turns significant: its sign is coded."""
        context, flip = _SIGNS[5 * (sign[i - 1] + sign[i + 1]) + sign[i - stride] + sign[i + stride] + 12]
        sign[i] = -1 if io(context, negative[i] ^ flip) ^ flip else 1
        magnitude[i] |= one
        near[i - 1] += 15
        near[i + 1] += 15
        near[i - stride] += 5
        near[i + stride] += 5
        near[i - stride - 1] += 1
        near[i - stride + 1] += 1
        near[i + stride - 1] += 1
        near[i + stride + 1] += 1

    seen = bytearray(n)
    for k in range(passes):
        plane, kind = planes - 1 - (k + 2) // 3, (k + 2) % 3
        one = 1 << plane
        if kind == 0:  # samples beside significant ones
            for i in places:
                if near[i] and not sign[i]:
                    seen[i] = 1
                    if io(zero[near[i]], value[i] >> plane & 1):
                        become(i, one)
        elif kind == 1:  # samples that were significant before
            for i in places:
                if sign[i] and not seen[i]:
                    if io(REFINE + 2 if refined[i] else REFINE + (near[i] > 0), value[i] >> plane & 1):
                        magnitude[i] |= one
                    refined[i] = 1
        else:  # what is left; a column of four samples without any neighbours is one run
            for column in columns:
                if len(column) == 4:
                    p, q, r, s = column
                    # A significant or seen sample has, or is, a neighbour of one in its column.
                    if not (near[p] or near[q] or near[r] or near[s]):
                        first = 0 if value[p] & one else 1 if value[q] & one else 2 if value[r] & one else 3 if value[s] & one else 4
                        if not io(RUN, int(first < 4)):
                            continue
                        at = io(UNIFORM, first >> 1 & 1) << 1
                        at |= io(UNIFORM, first & 1)
                        become(column[at], one)
                        column = column[at + 1 :]
                for i in column:
                    if not sign[i] and not seen[i] and io(zero[near[i]], value[i] >> plane & 1):
                        become(i, one)
            seen = bytearray(n)
    return sign, magnitude


def encode_block(values: np.ndarray, band: str) -> tuple[bytes, int, int]:
    """Coded bytes, bit planes and passes of a block of whole numbers."""
    planes = int(np.abs(values).max(initial=0)).bit_length()
    passes = max(0, 3 * planes - 2)
    if not passes:
        return b"", 0, 0
    symbols: list[int] = []
    add = symbols.append

    def io(context: int, bit: int) -> int:
        add(context << 1 | bit)
        return bit

    h, w = values.shape
    bordered = np.pad(values, 1).reshape(-1)
    _run(w, h, band, planes, passes, io, np.abs(bordered).tolist(), (bordered < 0).astype(int).tolist())
    return block_encode(symbols), planes, passes


def decode_block(data: bytes, w: int, h: int, band: str, planes: int, passes: int) -> np.ndarray:
    """The samples after so many passes; bits that weren't read are 0."""
    nothing = [0] * ((w + 2) * (h + 2))
    sign, magnitude = _run(w, h, band, planes, passes, block_reader(data), nothing, nothing)
    return (np.array(sign, np.int64) * np.array(magnitude, np.int64)).reshape(h + 2, w + 2)[1:-1, 1:-1]


def encode_samples(samples: DataFrame, size: int = 64, band: str = "LL", keys: tuple[str, ...] = ("image_id", "comp")) -> DataFrame:
    """keys, y0, x0, w, h, planes, passes and data: one row for each block of the samples' grid, cut to the samples there are; gaps are 0. A key named band is the block's band."""
    ship(samples.sparkSession)
    names = list(keys)

    def build(df: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(df.y.min()), int(df.x.min())
        grid = np.zeros((int(df.y.max()) - y0 + 1, int(df.x.max()) - x0 + 1), np.int64)
        grid[df.y - y0, df.x - x0] = df.v
        one = df.iloc[0]
        data, planes, passes = encode_block(grid, one.band if "band" in names else band)
        return pd.DataFrame({**{k: [one[k]] for k in names}, "y0": [y0], "x0": [x0], "w": [grid.shape[1]], "h": [grid.shape[0]], "planes": [planes], "passes": [passes], "data": [data]})

    placed = samples.select(*names, F.floor(F.col("y") / size).cast("long").alias("by"), F.floor(F.col("x") / size).cast("long").alias("bx"), "y", "x", "v")
    kinds = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in names)
    return placed.groupBy(*names, "by", "bx").applyInPandas(build, f"{kinds}, y0 long, x0 long, w int, h int, planes int, passes int, data binary")


def decode_samples(blocks: DataFrame, band: str = "LL", drop: int = 0, keys: tuple[str, ...] = ("image_id", "comp")) -> DataFrame:
    """Samples of the blocks; ``drop`` leaves out that many last passes of each."""
    ship(blocks.sparkSession)
    names = list(keys)
    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in names)

    def run(parts):
        for df in parts:
            for b in df.to_dict("records"):
                v = decode_block(b["data"] or b"", b["w"], b["h"], b["band"] if "band" in names else band, b["planes"], max(0, b["passes"] - drop))
                y, x = np.divmod(np.arange(v.size), b["w"])
                yield pd.DataFrame({**{k: b[k] for k in names}, "y": y + b["y0"], "x": x + b["x0"], "v": v.reshape(-1)})

    return blocks.mapInPandas(run, f"{kinds}, y long, x long, v long")


# ------------------------------------------------------------ packet headers


@dataclass
class Precinct:
    """What headers of one precinct's packets know of its blocks, in lines of ``w``."""

    w: int
    h: int
    included: TagTree
    zero_planes: TagTree
    length_bits: list[int] = field(default_factory=list)
    begun: list[bool] = field(default_factory=list)

    @classmethod
    def new(cls, w: int, h: int, first_layer: list[int] | None = None, zero_planes: list[int] | None = None) -> Precinct:
        return cls(w, h, TagTree(w, h, first_layer), TagTree(w, h, zero_planes), [3] * (w * h), [False] * (w * h))


def _put_passes(out: BitWriter, n: int) -> None:
    if n < 3:
        out.put((0, 0b10)[n - 1], n)
    elif n < 6:
        out.put(0b1100 | (n - 3), 4)
    elif n < 37:
        out.put(0b1111 << 5 | (n - 6), 9)
    else:
        out.put(0b111111111 << 7 | (n - 37), 16)


def _get_passes(data: BitReader) -> int:
    if not data.get():
        return 1
    if not data.get():
        return 2
    for bits, base in ((2, 3), (5, 6), (7, 37)):
        n = data.get(bits)
        if bits == 7 or n < (1 << bits) - 1:
            return base + n
    raise AssertionError


def write_packet_header(state: Precinct, layer: int, blocks: list[tuple[int, int]]) -> bytes:
    """blocks: passes and bytes that each block adds in this layer (0 passes: none)."""
    out = BitWriter()
    if not any(n for n, _ in blocks):
        out.put(0)
        return out.flush()
    out.put(1)
    for i, (n, size) in enumerate(blocks):
        y, x = divmod(i, state.w)
        if state.begun[i]:
            out.put(int(n > 0))
        else:
            state.included.put(out, x, y, layer + 1)
        if not n:
            continue
        if not state.begun[i]:
            state.begun[i] = True
            for t in range(1, state.zero_planes.value[0][i] + 2):
                state.zero_planes.put(out, x, y, t)
        _put_passes(out, n)
        own = n.bit_length() - 1
        more = max(0, size.bit_length() - own - state.length_bits[i])
        out.put((1 << more) - 1 << 1, more + 1)
        state.length_bits[i] += more
        out.put(size, state.length_bits[i] + own)
    return out.flush()


def read_packet_header(state: Precinct, layer: int, data: bytes) -> tuple[list[tuple[int, int, int]], int]:
    """Zero bit planes (where first included, else -1), passes and bytes of each block, and the header's length."""
    bits = BitReader(data)
    found = [(-1, 0, 0)] * (state.w * state.h)
    if bits.get():
        for i in range(state.w * state.h):
            y, x = divmod(i, state.w)
            zero = -1
            if state.begun[i]:
                if not bits.get():
                    continue
            elif state.included.get(bits, x, y, layer + 1):
                state.begun[i] = True
                zero = state.zero_planes.leaf(bits, x, y)
            else:
                continue
            n = _get_passes(bits)
            while bits.get():
                state.length_bits[i] += 1
            found[i] = zero, n, bits.get(state.length_bits[i] + n.bit_length() - 1)
    return found, bits.at + (bits.held == 0xFF and not bits.left)


class _Trees:
    """Tag trees of many precincts at once: grids of ``h`` lines of 4 leaves, of which a precinct has those in ``there``. A node outside a precinct's own tree sends nothing."""

    def __init__(self, there: np.ndarray, value: np.ndarray | None = None):
        n = len(there)
        grid = there.reshape(n, -1, 4)
        self.there, self.low, self.known, self.value = [grid], [], [], []
        if value is not None:
            self.value.append(np.where(grid, value.reshape(grid.shape), np.iinfo(np.int64).max))
        while self.there[-1].shape[1:] != (1, 1):
            h, w = self.there[-1].shape[1:]
            rows, cols = np.arange(0, h, 2), np.arange(0, w, 2)
            if value is not None:
                self.value.append(np.minimum.reduceat(np.minimum.reduceat(self.value[-1], rows, axis=1), cols, axis=2))
            self.there.append(np.logical_or.reduceat(np.logical_or.reduceat(self.there[-1], rows, axis=1), cols, axis=2))
        # A tree ends with the first level of one node.
        single = [t.sum((1, 2)) <= 1 for t in self.there]
        self.own = [np.ones(n, bool) if not i else ~single[i - 1] for i in range(len(single))]
        self.low = [np.zeros(t.shape, np.int64) for t in self.there]
        self.known = [np.zeros(t.shape, bool) for t in self.there]

    def walk(self, i: int, threshold: np.ndarray, mask: np.ndarray, step: Callable) -> np.ndarray:
        """As ``TagTree._walk`` for leaf ``i``. step(level, y, x, room, mask): how many zeros come, ``room`` at most, and whether a one ends them."""
        low = np.zeros(len(threshold), np.int64)
        for level in range(len(self.there) - 1, -1, -1):
            y, x = (i // 4) >> level, (i % 4) >> level
            m = mask & self.own[level]
            own = np.maximum(low, self.low[level][:, y, x])
            go = m & ~self.known[level][:, y, x] & (own < threshold)
            zeros, one = step(level, y, x, threshold - own, go, own)
            low = np.where(m, own + zeros, low)
            self.low[level][:, y, x] = np.where(m, low, self.low[level][:, y, x])
            self.known[level][:, y, x] |= one
        return mask & self.known[0][:, i // 4, i % 4] & (self.low[0][:, i // 4, i % 4] < threshold)


class _Tokens:
    """Numbers of so many bits for each lane, in order."""

    def __init__(self):
        self.value, self.bits = [], []

    def put(self, value, bits, mask: np.ndarray) -> None:
        self.bits.append(np.where(mask, bits, 0))
        self.value.append(np.where(mask, value, 0))

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        bits, value = np.stack(self.bits, 1), np.stack(self.value, 1).reshape(-1)
        n = bits.reshape(-1)
        left = np.repeat(np.cumsum(n), n) - 1 - np.arange(int(n.sum()))
        return stuff(np.where(left < 63, np.repeat(value, n) >> np.minimum(left, 62) & 1, 0), bits.sum(1))


class _Reader:
    """Reads a string of bits for each lane."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        bits, counts, self.byte = unstuff(data, sizes)
        self.data, self.sizes, self.bits = data, sizes, np.append(bits, 0).astype(np.int64)
        self.end = np.cumsum(counts)
        self.begin = self.end - counts
        self.at, n = self.begin.copy(), len(bits)
        self.next = [np.minimum.accumulate(np.where(np.append(bits, b) == b, np.arange(n + 1), n)[::-1])[::-1] for b in (0, 1)]

    def get(self, bits, mask: np.ndarray) -> np.ndarray:
        n = np.where(mask, bits, 0)
        out = np.zeros(len(n), np.int64)
        for k in range(int(n.max(initial=0))):
            out = np.where(k < n, out << 1 | self.bits[np.minimum(self.at + k, len(self.bits) - 1)], out)
        self.at += n
        return out

    def run(self, of: int, mask: np.ndarray) -> np.ndarray:
        """Bits of this kind that come next; they are not passed."""
        at = np.minimum(self.at, len(self.bits) - 1)
        return np.where(mask, self.next[1 - of][at] - at, 0)

    def used(self) -> np.ndarray:
        if (self.at > self.end).any():
            raise EOFError
        last = np.maximum(self.at - 1, 0)
        some = self.at > self.begin
        byte = self.byte[np.minimum(last, len(self.byte) - 1)] if len(self.byte) else last
        whole = np.append(self.byte, -1)[np.minimum(self.at, len(self.byte))] != byte
        first = np.cumsum(self.sizes) - self.sizes
        return np.where(some, byte - first + 1 + (whole & (self.data[byte] == 0xFF) if len(self.data) else 0), 0)


def _bit_length(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def _write_headers(out: _Tokens, included: _Trees, zero_planes: _Trees, zero: np.ndarray, layer: int, passes: np.ndarray, size: np.ndarray, begun: np.ndarray, length_bits: np.ndarray, live: np.ndarray) -> None:
    """``write_packet_header`` for a layer of every live precinct."""

    def send(tree):
        def step(level, y, x, room, go, own):
            value = tree.value[level][:, y, x]
            zeros, one = np.where(go, np.minimum(value - own, room), 0), go & (value - own < room)
            out.put(1 * one, zeros + one, go)
            return zeros, one

        return step

    some = live & (passes > 0).any(1)
    out.put(1 * some, 1, live)
    there = included.there[0].reshape(len(live), -1)
    for i in range(passes.shape[1]):
        m, n = some & there[:, i], passes[:, i]
        out.put(1 * (n > 0), 1, m & begun[:, i])
        included.walk(i, np.full(len(live), layer + 1), m & ~begun[:, i], send(included))
        m = m & (n > 0)
        zero_planes.walk(i, zero[:, i] + 1, m & ~begun[:, i], send(zero_planes))
        begun[:, i] |= m
        for top, bits, base in ((1, 1, 0), (2, 2, 0b10), (5, 4, 0b1100), (36, 9, 0b1111 << 5), (1 << 62, 16, 0b111111111 << 7)):
            low = {1: 1, 2: 2, 5: 3, 36: 6}.get(top, 37)
            out.put(base + n - low, bits, m & (n >= low) & (n <= top))
        own = _bit_length(np.maximum(n, 1)) - 1
        more = np.where(m, np.maximum(0, _bit_length(size[:, i]) - own - length_bits[:, i]), 0)
        out.put((1 << (more + 1)) - 2, more + 1, m)
        length_bits[:, i] += more
        out.put(size[:, i], length_bits[:, i] + own, m)


def _read_headers(data: _Reader, included: _Trees, zero_planes: _Trees, layer: int, begun: np.ndarray, length_bits: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``read_packet_header`` for a layer of every live precinct."""

    def step(level, y, x, room, go, own):
        run = data.run(0, go)
        zeros, one = np.minimum(run, np.where(go, room, 0)), go & (run < room)
        data.at += zeros + one
        return zeros, one

    there = included.there[0].reshape(len(live), -1)
    found = np.full(there.shape, -1), np.zeros(there.shape, np.int64), np.zeros(there.shape, np.int64)
    some = data.get(1, live) > 0
    for i in range(there.shape[1]):
        m = some & there[:, i]
        new = m & ~begun[:, i]
        again = data.get(1, m & begun[:, i]) > 0
        new = included.walk(i, np.full(len(live), layer + 1), new, step)
        zero_planes.walk(i, np.full(len(live), 1 << 40), new, step)
        m = again | new
        begun[:, i] |= new
        n, open_ = np.zeros(len(live), np.int64), m
        for bits, base in ((1, 1), (1, 2), (2, 3), (5, 6), (7, 37)):
            got = data.get(bits, open_)
            ended = open_ & ((got < (1 << bits) - 1) | (bits == 7))
            n = np.where(ended, base + got, n)
            open_ = open_ & ~ended
        more = data.run(1, m)
        length_bits[:, i] += more
        data.at += np.where(m, more + 1, 0)
        size = data.get(length_bits[:, i] + _bit_length(np.maximum(n, 1)) - 1, m)
        for a, b in zip(found, (np.where(new, zero_planes.low[0][:, i // 4, i % 4], -1), n, size), strict=True):
            a[:, i] = np.where(m, b, a[:, i])
    return found


def code_headers(precinct: np.ndarray, layer: np.ndarray, block: np.ndarray, zero: np.ndarray, passes: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """The columns of ``header_roundtrip`` of many precincts at once, whose rows follow each other; those of like size are coded together."""
    starts = np.flatnonzero(np.append(True, precinct[1:] != precinct[:-1]))
    which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(precinct))))
    blocks, layers = np.maximum.reduceat(block, starts) + 1, np.maximum.reduceat(layer, starts) + 1
    lines = -(-blocks // 4)
    like = np.stack([_bit_length(lines - 1), _bit_length(layers - 1)], 1)
    done = []
    for kind in np.unique(like, axis=0):
        lanes = np.flatnonzero((like == kind).all(1))
        place = np.full(len(starts), -1)
        place[lanes] = np.arange(len(lanes))
        rows = place[which] >= 0
        g, n_layers, n = place[which[rows]], layers[lanes], 4 * int(lines[lanes].max())
        p, s, z = (np.zeros((len(lanes), int(n_layers.max()), n), np.int64) for _ in range(3))
        p[g, layer[rows], block[rows]], s[g, layer[rows], block[rows]] = passes[rows], length[rows]
        z = np.zeros((len(lanes), n), np.int64)
        z[g, block[rows]] = zero[rows]
        there = (np.arange(n) // 4 < lines[lanes][:, None]) & (np.arange(n) % 4 < np.minimum(blocks[lanes], 4)[:, None])
        first = np.where((p > 0).any(1), (p > 0).argmax(1), n_layers[:, None])
        trees = _Trees(there, first), _Trees(there, z)
        back = _Trees(there), _Trees(there)
        begun, bits, begun_back, bits_back = (f((len(lanes), n), v, t) for f, v, t in [(np.full, False, bool), (np.full, 3, np.int64)] * 2)
        for k in range(p.shape[1]):
            live, out = n_layers > k, _Tokens()
            _write_headers(out, *trees, z, k, p[:, k], s[:, k], begun, bits, live)
            data, sizes = out.flush()
            reader = _Reader(data, sizes)
            found = _read_headers(reader, *back, k, begun_back, bits_back, live)
            used = reader.used()
            if (used != sizes).any():
                i = int((used != sizes).argmax())
                raise ValueError(f"a header of {sizes[i]} bytes was read to {used[i]}")
            lane, at = np.nonzero(found[1])
            done.append((precinct[starts[lanes[lane]]], np.full(len(lane), k), at, *(f[lane, at] for f in found)))
    return [np.concatenate(c) for c in zip(*done, strict=True)]


def header_roundtrip(blocks: DataFrame) -> DataFrame:
    """precinct, layer, block, zero_planes, passes, length as read back from each precinct's packet headers. blocks: the same columns but
    zero_planes on every row, one row for each layer and block; blocks of a precinct lie in lines of 4. Many precincts are coded at once."""
    ship(blocks.sparkSession)
    names = ["precinct", "layer", "block", "zero_planes", "passes", "length"]

    def run(batches):
        for table in whole_groups(batches, "precinct"):
            columns = code_headers(*(table.column(c).to_numpy() for c in names))
            yield from pa.table([pa.array(c, pa.int64()) for c in columns], names=names).to_batches(1 << 14)

    placed = blocks.select(*(F.col(c).cast("long").alias(c) for c in names))
    return placed.repartition("precinct").sortWithinPartitions("precinct").mapInArrow(run, ", ".join(f"{c} long" for c in names))
