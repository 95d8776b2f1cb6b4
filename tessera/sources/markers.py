"""Bodies of codestream markers and of boxes as rows: one row for each field, with the item that it belongs to. Layouts follow ITU-T T.800 and T.801.

A segment that is cut off, or longer than its data, gives the fields that lie whole in it. Component numbers take two bytes where SIZ names 257 components or more.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.functions.workers import ship
from tessera.sources.codestream import boxes, scan

Field = tuple[int, str, int]


class Reader:
    """Big-endian numbers from a part of some bytes; ``more`` tells whether n bytes are left."""

    def __init__(self, data: bytes, lo: int, hi: int):
        self.data, self.at, self.hi = data, lo, min(hi, len(data))

    def more(self, n: int = 1) -> bool:
        return self.at + n <= self.hi

    def take(self, n: int) -> int:
        if not self.more(n):
            raise EOFError
        self.at += n
        return int.from_bytes(self.data[self.at - n : self.at], "big")

    def rest(self) -> bytes:
        out, self.at = self.data[self.at : self.hi], self.hi
        return out


def _named(r: Reader, item: int, *fields: tuple[str, int]) -> Iterator[Field]:
    for name, size in fields:
        yield item, name, r.take(size)


def _style(r: Reader) -> Iterator[Field]:
    """Levels, block size, block style and kernel, and the precincts' sizes where they are given."""
    yield 0, "levels", r.take(1)
    for name in ("block_width", "block_height"):
        yield 0, name, 4 << r.take(1)
    yield from _named(r, 0, ("block_style", 1), ("kernel", 1))
    level = 0
    while r.more():
        both = r.take(1)
        yield level, "precinct_width", 1 << (both & 15)
        yield level, "precinct_height", 1 << (both >> 4)
        level += 1


def _steps(r: Reader) -> Iterator[Field]:
    """Guard bits, kind (0 none, 1 derived, 2 for each band) and each band's exponent and mantissa."""
    both = r.take(1)
    yield 0, "guard_bits", both >> 5
    yield 0, "kind", both & 31
    wide, band = (both & 31) > 0, 0
    while r.more(1 + wide):
        value = r.take(1 + wide)
        yield band, "exponent", value >> 11 if wide else value >> 3
        yield band, "mantissa", value & 2047 if wide else 0
        band += 1


def _varying(r: Reader, end: int, item: int = 0) -> Iterator[Field]:
    """Packet lengths of seven bits a byte, of which all but the last have the top bit set."""
    value = 0
    while r.at < end:
        byte = r.take(1)
        value = value << 7 | byte & 127
        if byte < 128:
            yield item, "packet_length", value
            item, value = item + 1, 0


def _cod(r, wide):
    yield from _named(r, 0, ("style", 1), ("order", 1), ("layers", 2), ("transform", 1))
    yield from _style(r)


def _coc(r, wide):
    yield from _named(r, 0, ("component", wide), ("style", 1))
    yield from _style(r)


def _qcc(r, wide):
    yield 0, "component", r.take(wide)
    yield from _steps(r)


def _rgn(r, wide):
    yield from _named(r, 0, ("component", wide), ("style", 1), ("shift", 1))


def _poc(r, wide):
    item = 0
    while r.more(5 + 2 * wide):
        yield from _named(r, item, ("first_res", 1), ("first_comp", wide), ("end_layer", 2), ("end_res", 1), ("end_comp", wide), ("order", 1))
        item += 1


def _tlm(r, wide):
    yield 0, "index", r.take(1)
    sizes = r.take(1)
    tile, length, item = sizes >> 4 & 3, 4 if sizes & 64 else 2, 0
    while r.more(tile + length):
        yield item, "tile", r.take(tile) if tile else item
        yield item, "length", r.take(length)
        item += 1


def _plt(r, wide):
    yield 0, "index", r.take(1)
    yield from _varying(r, r.hi)


def _plm(r, wide):
    yield 0, "index", r.take(1)
    item = 0
    while r.more():
        end = r.at + 1 + r.take(1)
        for item, name, value in _varying(r, min(end, r.hi), item):
            yield item, name, value
            item += 1


def _ppm(r, wide):
    yield 0, "index", r.take(1)
    item = 0
    while r.more(4):
        size = r.take(4)
        yield item, "header_bytes", size
        r.at += size
        item += 1


def _ppt(r, wide):
    yield 0, "index", r.take(1)
    yield 0, "header_bytes", len(r.rest())


def _com(r, wide):
    yield 0, "kind", r.take(2)
    text = r.rest()
    yield 0, "bytes", len(text)
    for i, byte in enumerate(text):
        yield i, "byte", byte


def _crg(r, wide):
    item = 0
    while r.more(4):
        yield from _named(r, item, ("x_offset", 2), ("y_offset", 2))
        item += 1


def _cap(r, wide):
    held = r.take(4)
    yield 0, "parts", held
    for part in range(1, 33):
        if held >> (32 - part) & 1:
            yield part, "capability", r.take(2)


def _sot(r, wide):
    yield from _named(r, 0, ("tile", 2), ("length", 4), ("part", 1), ("parts", 1))


def _mct(r, wide):
    yield 0, "index", r.take(2)
    kind = r.take(2)
    yield 0, "array", kind & 255
    yield 0, "array_kind", kind >> 8 & 3
    yield 0, "element_kind", kind >> 10 & 3
    yield 0, "last", r.take(2)
    size, item = (2, 4, 4, 8)[kind >> 10 & 3], 0
    while r.more(size) and kind >> 10 & 3 < 2:
        yield item, "element", int.from_bytes(r.take(size).to_bytes(size, "big"), "big", signed=True)
        item += 1


def _mco(r, wide):
    for item in range(r.take(1)):
        yield item, "stage", r.take(1)


def _cbd(r, wide):
    n = r.take(2)
    yield 0, "same", n >> 15
    for item in range(1 if n >> 15 else n & 0x7FFF):
        depth = r.take(1)
        yield item, "prec", (depth & 127) + 1
        yield item, "signed", depth >> 7


def _dfs(r, wide):
    yield 0, "index", r.take(2)
    n = r.take(1)
    for item in range(n):
        if item % 4 == 0:
            four = r.take(1)
        yield item, "split", four >> (6 - 2 * (item % 4)) & 3


#: Readers of bodies by marker; QCD has the fields of QCC but for the component.
MARKER_BODIES: dict[str, Callable[[Reader, int], Iterator[Field]]] = {
    "COD": _cod, "COC": _coc, "QCD": lambda r, wide: _steps(r), "QCC": _qcc, "RGN": _rgn, "POC": _poc, "TLM": _tlm, "PLT": _plt, "PLM": _plm, "PPM": _ppm,
    "PPT": _ppt, "COM": _com, "CRG": _crg, "CAP": _cap, "SOT": _sot, "MCT": _mct, "MCO": _mco, "CBD": _cbd, "DFS": _dfs,
}


def _whole(fields: Iterator[Field]) -> Iterator[Field]:
    try:
        yield from fields
    except EOFError:
        return


def marker_fields(data: bytes) -> Iterator[tuple[str, int, int, str, int]]:
    """marker, its place, item, field and value."""
    wide = 1
    for name, at, size in scan(data):
        if name == "SIZ" and at + 40 <= len(data):
            wide = 1 + (struct.unpack_from(">H", data, at + 38)[0] > 256)
        if name in MARKER_BODIES:
            for item, field, value in _whole(MARKER_BODIES[name](Reader(data, at + 4, at + size), wide)):
                yield name, at, item, field, value


# ------------------------------------------------------------ boxes


def _ihdr(r):
    yield from _named(r, 0, ("height", 4), ("width", 4), ("components", 2), ("depth", 1), ("compression", 1), ("unknown_colour", 1), ("rights", 1))


def _bpcc(r):
    item = 0
    while r.more():
        yield item, "depth", r.take(1)
        item += 1


def _colr(r):
    yield from _named(r, 0, ("method", 1), ("precedence", 1), ("approximation", 1))
    if r.more(4) and r.data[r.at - 3] == 1:
        yield 0, "colour_space", r.take(4)
    else:
        yield 0, "profile_bytes", len(r.rest())


def _pclr(r):
    entries, columns = r.take(2), r.take(1)
    yield 0, "entries", entries
    yield 0, "columns", columns
    depth = [r.take(1) for _ in range(columns)]
    for i, d in enumerate(depth):
        yield i, "depth", d
    for e in range(entries):
        for c, d in enumerate(depth):
            yield e * columns + c, "value", r.take(((d & 127) + 8) // 8)


def _cmap(r):
    item = 0
    while r.more(4):
        yield from _named(r, item, ("component", 2), ("mapping", 1), ("column", 1))
        item += 1


def _cdef(r):
    for item in range(r.take(2)):
        yield from _named(r, item, ("channel", 2), ("type", 2), ("association", 2))


def _res(r):
    yield from _named(r, 0, ("y_num", 2), ("y_den", 2), ("x_num", 2), ("x_den", 2))
    for name in ("y_exp", "x_exp"):
        yield 0, name, (r.take(1) + 128) % 256 - 128


def _ftyp(r):
    yield from _named(r, 0, ("brand", 4), ("version", 4))
    item = 0
    while r.more(4):
        yield item, "compatible", r.take(4)
        item += 1


def _table(*fields: tuple[str, int]):
    """Version and flags, then a count and as many items."""

    def read(r):
        yield 0, "flags", r.take(4)
        for item in range(r.take(4)):
            yield from _named(r, item, *fields)

    return read


def _stsz(r):
    yield 0, "flags", r.take(4)
    size, n = r.take(4), r.take(4)
    for item in range(n):
        yield item, "size", size or r.take(4)


BOX_BODIES: dict[str, Callable[[Reader], Iterator[Field]]] = {
    "ihdr": _ihdr, "bpcc": _bpcc, "colr": _colr, "pclr": _pclr, "cmap": _cmap, "cdef": _cdef, "resc": _res, "resd": _res, "ftyp": _ftyp, "stsz": _stsz,
    "stco": _table(("offset", 4)), "stts": _table(("count", 4), ("delta", 4)), "stsc": _table(("first_chunk", 4), ("samples", 4), ("description", 4)),
}


def box_fields(data: bytes) -> Iterator[tuple[str, int, int, str, int]]:
    """box, its place, item, field and value."""
    for _, name, at, size in boxes(data):
        if name in BOX_BODIES:
            for item, field, value in _whole(BOX_BODIES[name](Reader(data, at + 8, at + size))):
                yield name, at, item, field, value


def codestream_of(data: bytes) -> bytes:
    """The raw codestream of a file: the body of its first jp2c box, or the data itself where they are no boxes."""
    if data[:4] == b"\xff\x4f\xff\x51":
        return data
    for _, name, at, size in boxes(data):
        if name == "jp2c":
            return data[at + 8 : at + size]
    return b""


def write_jp2(codestream: bytes, info: dict, late: list[tuple[str, bytes]] = ()) -> bytes:
    """Signature, file type, header boxes and codestream; ``late`` boxes (geographic metadata) follow the codestream.

    info: w, h, depths (as bytes of bpcc), colour_space, and if wanted palette (rows of entries), mapping and channels.
    """
    from tessera.sources.codestream import box

    depths = info["depths"]
    same = len(set(depths)) == 1
    inner = box("ihdr", struct.pack(">IIHBBBB", info["h"], info["w"], len(depths), depths[0] if same else 255, 7, 0, 0))
    inner += b"" if same else box("bpcc", bytes(depths))
    inner += box("colr", struct.pack(">BBBI", 1, 0, 0, info["colour_space"]))
    if info.get("palette"):
        inner += box("pclr", struct.pack(">HB", len(info["palette"]), len(info["palette"][0])) + bytes([7] * len(info["palette"][0])) + bytes(v for e in info["palette"] for v in e))
        inner += box("cmap", b"".join(struct.pack(">HBB", *m) for m in info["mapping"]))
    if info.get("channels"):
        inner += box("cdef", struct.pack(">H", len(info["channels"])) + b"".join(struct.pack(">HHH", *c) for c in info["channels"]))
    head = box("jP  ", b"\r\n\x87\n") + box("ftyp", b"jp2 \0\0\0\0jp2 ") + box("jp2h", inner)
    return head + box("jp2c", codestream) + b"".join(box(kind, body) for kind, body in late)


# ------------------------------------------------------------ as DataFrames

FIELDS = "path string, name string, pos long, item long, field string, value long"


def _rows(files: DataFrame, read: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    ship(files.sparkSession)
    names = [x.split(" ")[0] for x in FIELDS.split(", ")]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = list(read(content or b""))
                for a in range(0, len(rows), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows[a : a + 100_000])), *(pa.array(c) for c in zip(*rows[a : a + 100_000], strict=True))], names=names)

    return files.select("path", "content").mapInArrow(run, FIELDS)


def marker_rows(files: DataFrame) -> DataFrame:
    """path, name, pos, item, field, value for files with path and content."""
    return _rows(files, marker_fields)


def box_rows(files: DataFrame) -> DataFrame:
    return _rows(files, box_fields)


def wrap(files: DataFrame, comps: int, late: list[tuple[str, bytes]] = ()) -> DataFrame:
    """path and content: files of 8-bit components around raw codestreams, whose size is read from their SIZ."""
    ship(files.sparkSession)

    def put(data: bytes) -> bytes:
        info = {"w": 0, "h": 0, **{k: v for k, v in zip(("w", "h"), _size(data), strict=True)}, "depths": [7] * comps, "colour_space": 16 if comps > 2 else 17}
        return write_jp2(data, info, list(late))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([put(c or b"") for c in batch.column("content").to_pylist()], pa.binary())], names=["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary")


def _size(data: bytes) -> tuple[int, int]:
    at = next((at for name, at, _ in scan(data) if name == "SIZ"), None)
    if at is None or at + 22 > len(data):
        return 0, 0
    x1, y1, x0, y0 = struct.unpack_from(">IIII", data, at + 6)
    return x1 - x0, y1 - y0


def extract(files: DataFrame) -> DataFrame:
    """path and content, which is the raw codestream."""
    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([codestream_of(c or b"") for c in batch.column("content").to_pylist()], pa.binary())], names=["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary")


def frames(fields: DataFrame) -> DataFrame:
    """path, frame, offset and size of every frame of every movie, from the fields of its sample tables (``box_rows``): a chunk holds as many frames as the
    last entry of stsc that begins at it or before says; frames lie one after another in their chunk. Frames beyond the chunks are left out."""
    wide = lambda box, **names: fields.where(F.col("name") == box).groupBy("path", "item").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(n) for n, f in names.items()))
    sizes = wide("stsz", size="size").where("size is not null").withColumnRenamed("item", "frame")
    chunks = wide("stco", start="offset").where("start is not null").withColumnRenamed("item", "chunk")
    runs = wide("stsc", first="first_chunk", held="samples").where("first is not null").drop("item")
    # A movie's runs are few; each chunk takes the last that has begun.
    counted = chunks.join(runs, "path").where("first <= chunk + 1").groupBy("path", "chunk", "start").agg(F.max_by("held", "first").alias("held"))
    first = F.coalesce(F.sum("held").over(W.partitionBy("path").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("from", first).where("held > 0").select("path", "chunk", "start", F.explode(F.expr("sequence(from, from + held - 1)")).alias("frame"))
    within = W.partitionBy("path", "chunk").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)
    return placed.join(sizes, ["path", "frame"]).select("path", "frame", (F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))).cast("long").alias("offset"), "size")


def dump_lines(images: DataFrame) -> DataFrame:
    """path, line and text: a readable account of each image's header (``codestream.images``)."""
    lines = [
        F.format_string("image x0=%d y0=%d x1=%d y1=%d", "x0", "y0", "x1", "y1"),
        F.format_string("tiles %dx%d of %dx%d", F.ceil(F.col("x1") / F.col("tw")), F.ceil(F.col("y1") / F.col("th")), "tw", "th"),
        F.format_string("components %d transform %d", "numcomps", "mct"),
        F.format_string("layers %d resolutions %d", "layers", "numres"),
    ]
    return images.select("path", F.posexplode(F.array(*lines)).alias("line", "text"))
