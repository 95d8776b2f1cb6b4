"""Queries over codestreams and files made from the regions: what each segment holds is stated once, as numbers for the bytes and as fields for the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.plans import rasters as R
from tessera.plans.queries import query
from tessera.plans.rasters import sql
from tessera.sources import markers as M

#: A number of so many bytes; its text is valid in Spark and in the SQL. k is the region's number, 0 to 24.
Part = tuple[str, int]
#: Name, code, parts of the body, and the fields (item, name, value) that they amount to.
Segment = tuple[str, int, list[Part], list[tuple[int, str, str]]]


def _plain(name: str, code: int, *fields: tuple[int, str, str, int]) -> Segment:
    """A segment whose fields are its numbers."""
    return name, code, [(v, n) for _, _, v, n in fields], [(i, f, v) for i, f, v, _ in fields]


_STYLE = [(0, "levels", "2", "2", 1), (0, "block_width", "1 + k % 3", "8 << (k % 3)", 1), (0, "block_height", "3", "32", 1), (0, "block_style", "k % 4", "k % 4", 1), (0, "kernel", "k % 2", "k % 2", 1)]
_STYLED = [(p, n) for _, _, p, _, n in _STYLE], [(i, f, v) for i, f, _, v, _ in _STYLE]
_BANDS = range(7)

SEGMENTS: list[Segment] = [
    ("SIZ", 0xFF51, [("0", 2), ("x1", 4), ("y1", 4), ("x0", 4), ("y0", 4), ("16", 4), ("16", 4), ("0", 4), ("0", 4), ("3", 2)] + [("7", 1), ("1", 1), ("1", 1)] * 3, []),
    ("CAP", 0xFF50, [("131072", 4), ("k * 3", 2)], [(0, "parts", "131072"), (15, "capability", "k * 3")]),
    ("COD", 0xFF52, [("0", 1), ("k % 5", 1), ("k + 1", 2), ("k % 2", 1), *_STYLED[0]], [(0, "style", "0"), (0, "order", "k % 5"), (0, "layers", "k + 1"), (0, "transform", "k % 2"), *_STYLED[1]]),
    ("COC", 0xFF53, [("2", 1), ("1", 1), *_STYLED[0], ("119", 1), ("135 + k % 4", 1), ("152", 1)],
     [(0, "component", "2"), (0, "style", "1"), *_STYLED[1], (0, "precinct_width", "128"), (0, "precinct_height", "128"), (1, "precinct_width", "128 << (k % 4)"), (1, "precinct_height", "256"), (2, "precinct_width", "256"), (2, "precinct_height", "512")]),
    ("QCD", 0xFF5C, [("(k % 8) * 32 + 2", 1), *((f"(8 + k % 10) * 2048 + (k * 37 + {b}) % 2048", 2) for b in _BANDS)],
     [(0, "guard_bits", "k % 8"), (0, "kind", "2"), *((b, f, v) for b in _BANDS for f, v in (("exponent", "8 + k % 10"), ("mantissa", f"(k * 37 + {b}) % 2048")))]),
    ("QCC", 0xFF5D, [("1", 1), ("64", 1), *((f"(k + {b}) * 8", 1) for b in _BANDS)], [(0, "component", "1"), (0, "guard_bits", "2"), (0, "kind", "0"), *((b, f, v) for b in _BANDS for f, v in (("exponent", f"k + {b}"), ("mantissa", "0")))]),
    _plain("RGN", 0xFF5E, (0, "component", "k % 3", 1), (0, "style", "0", 1), (0, "shift", "k % 32", 1)),
    _plain("POC", 0xFF5F, *((i, f, v, n) for i in (0, 1) for f, v, n in (("first_res", f"{i}", 1), ("first_comp", "0", 1), ("end_layer", f"k + {i}", 2), ("end_res", "3", 1), ("end_comp", "3", 1), ("order", f"(k + {i}) % 5", 1)))),
    ("TLM", 0xFF55, [("0", 1), ("80", 1), *((v, n) for i in range(3) for v, n in ((f"{i}", 1), (f"k * 70000 + {i}", 4)))], [(0, "index", "0"), *((i, f, v) for i in range(3) for f, v in (("tile", f"{i}"), ("length", f"k * 70000 + {i}")))]),
    ("PLM", 0xFF57, [("1", 1), ("3", 1), ("k", 1), ("129", 1), ("k + 1", 1), ("1", 1), ("k + 2", 1)], [(0, "index", "1"), (0, "packet_length", "k"), (1, "packet_length", "128 + k + 1"), (2, "packet_length", "k + 2")]),
    ("PPM", 0xFF60, [("0", 1), ("2", 4), ("k", 2), ("1", 4), ("k", 1)], [(0, "index", "0"), (0, "header_bytes", "2"), (1, "header_bytes", "1")]),
    _plain("CRG", 0xFF63, *((c, f, f"k * {c + m}", 2) for c in range(3) for f, m in (("x_offset", 100), ("y_offset", 200)))),
    ("COM", 0xFF64, [("1", 2), ("65 + k", 1), ("97", 1)], [(0, "kind", "1"), (0, "bytes", "2"), (0, "byte", "65 + k"), (1, "byte", "97")]),
    ("MCT", 0xFF74, [("0", 2), ("256 + k", 2), ("0", 2), *((f"(k * {j} - 20 + 65536) % 65536", 2) for j in range(9))], [(0, "index", "0"), (0, "array", "k"), (0, "array_kind", "1"), (0, "element_kind", "0"), (0, "last", "0"), *((j, "element", f"k * {j} - 20") for j in range(9))]),
    ("MCO", 0xFF77, [("2", 1), ("k", 1), ("k + 1", 1)], [(0, "stage", "k"), (1, "stage", "k + 1")]),
    ("CBD", 0xFF78, [("3", 2), ("k", 1), ("128 + k", 1), ("7", 1)], [(0, "same", "0"), (0, "prec", "k + 1"), (0, "signed", "0"), (1, "prec", "k + 1"), (1, "signed", "1"), (2, "prec", "8"), (2, "signed", "0")]),
    ("DFS", 0xFF72, [("k", 2), ("5", 1), ("k", 1), ("k % 4 * 64", 1)], [(0, "index", "k"), *((i, "split", f"(k >> {6 - 2 * i}) & 3") for i in range(4)), (4, "split", "k % 4")]),
    ("SOT", 0xFF90, [("k", 2), ("31", 4), ("0", 1), ("1", 1)], [(0, "tile", "k"), (0, "length", "31"), (0, "part", "0"), (0, "parts", "1")]),
    ("PLT", 0xFF58, [("0", 1), ("k", 1), ("129", 1), ("k", 1)], [(0, "index", "0"), (0, "packet_length", "k"), (1, "packet_length", "128 + k")]),
    ("PPT", 0xFF61, [("2", 1), ("k", 4)], [(0, "index", "2"), (0, "header_bytes", "4")]),
]


def _bytes(parts: list[Part]) -> str:
    """The numbers as hexadecimal digits, in Spark's SQL."""
    return ", ".join(f"lpad(hex(cast({v} as bigint)), {2 * n}, '0')" for v, n in parts).replace("<<", "*")


def _size(parts: list[Part]) -> int:
    return sum(n for _, n in parts)


def _codestream() -> str:
    out = ["'FF4F'"]
    for _, code, parts, _ in SEGMENTS:
        out += [f"'{code:04X}{_size(parts) + 2:04X}'", _bytes(parts)]
    return f"concat({', '.join(out)}, 'FF93FFD9')"


def streams(spark, d) -> DataFrame:
    """path and content: one codestream for each region."""
    r = R.regions(spark, d).withColumnRenamed("region", "k")
    return r.select(F.col("k").cast("string").alias("path"), F.unhex(F.expr(_codestream())).alias("content"))


def _expected(names: tuple[str, ...]) -> str:
    """The fields of the named segments, as SQL."""
    rows, at = [], 2
    for name, _, parts, fields in SEGMENTS:
        rows += [f"select k::varchar path, '{name}' as name, {at}::bigint pos, {i}::bigint item, '{f}' field, ({v})::bigint as \"value\" from r" for i, f, v in fields if name in names]
        at += _size(parts) + 4
    return sql("regions", ", r as (select region k, x0, y0, x1, y1 from regions) " + " union all ".join(rows))


def _named(*names: str):
    def run(spark, d):
        return M.marker_rows(streams(spark, d)).where(F.col("name").isin(*names))

    return run


for _query, _names in {
    "coding_markers": ("COD", "COC", "RGN", "POC"), "quantisation_markers": ("QCD", "QCC"), "index_markers": ("TLM", "PLT", "PLM", "PPM", "PPT"), "other_markers": ("COM", "CRG", "CAP", "SOT"),
    "component_markers": ("MCT", "MCO", "CBD"), "part2_markers": ("DFS",),
}.items():
    _run = _named(*_names)
    _run.__name__ = _query
    query(_expected(_names))(_run)


# ------------------------------------------------------------ boxes

#: Box, its superbox if any, body and fields.
BOXES: list[tuple[str, str, list[Part], list[tuple[int, str, str]]]] = [
    ("ftyp", "", [("1785737760", 4), ("k", 4), ("1785737760", 4)], [(0, "brand", "1785737760"), (0, "version", "k"), (0, "compatible", "1785737760")]),
    ("ihdr", "jp2h", [("y1 - y0", 4), ("x1 - x0", 4), ("3", 2), ("255", 1), ("7", 1), ("k % 2", 1), ("0", 1)],
     [(0, "height", "y1 - y0"), (0, "width", "x1 - x0"), (0, "components", "3"), (0, "depth", "255"), (0, "compression", "7"), (0, "unknown_colour", "k % 2"), (0, "rights", "0")]),
    ("bpcc", "jp2h", [("7", 1), ("k", 1), ("128 + k", 1)], [(0, "depth", "7"), (1, "depth", "k"), (2, "depth", "128 + k")]),
    ("colr", "jp2h", [("1", 1), ("k", 1), ("0", 1), ("16 + k % 3", 4)], [(0, "method", "1"), (0, "precedence", "k"), (0, "approximation", "0"), (0, "colour_space", "16 + k % 3")]),
    ("pclr", "jp2h", [("4", 2), ("3", 1), ("7", 1), ("7", 1), ("11", 1), *((f"k * {e + 1} + {c}", 1 + (c == 2)) for e in range(4) for c in range(3))],
     [(0, "entries", "4"), (0, "columns", "3"), (0, "depth", "7"), (1, "depth", "7"), (2, "depth", "11"), *((e * 3 + c, "value", f"k * {e + 1} + {c}") for e in range(4) for c in range(3))]),
    ("cmap", "jp2h", [(v, n) for c in range(3) for v, n in (("0", 2), ("1", 1), (f"(k + {c}) % 3", 1))], [(c, f, v) for c in range(3) for f, v in (("component", "0"), ("mapping", "1"), ("column", f"(k + {c}) % 3"))]),
    ("cdef", "jp2h", [("2", 2), ("0", 2), ("0", 2), ("k % 3 + 1", 2), ("1", 2), ("1", 2), ("0", 2)], [(0, "channel", "0"), (0, "type", "0"), (0, "association", "k % 3 + 1"), (1, "channel", "1"), (1, "type", "1"), (1, "association", "0")]),
    ("resc", "jp2h", [("k + 1", 2), ("2", 2), ("k + 3", 2), ("4", 2), ("256 - 3", 1), ("k", 1)], [(0, "y_num", "k + 1"), (0, "y_den", "2"), (0, "x_num", "k + 3"), (0, "x_den", "4"), (0, "y_exp", "-3"), (0, "x_exp", "k")]),
    ("stts", "stbl", [("0", 4), ("2", 4), ("k", 4), ("1", 4), ("7", 4), ("k + 9", 4)], [(0, "flags", "0"), (0, "count", "k"), (0, "delta", "1"), (1, "count", "7"), (1, "delta", "k + 9")]),
    ("stsc", "stbl", [("0", 4), ("1", 4), ("1", 4), ("k + 1", 4), ("1", 4)], [(0, "flags", "0"), (0, "first_chunk", "1"), (0, "samples", "k + 1"), (0, "description", "1")]),
    ("stsz", "stbl", [("0", 4), ("0", 4), ("3", 4), *((f"k * 1000 + {i}", 4) for i in range(3))], [(0, "flags", "0"), *((i, "size", f"k * 1000 + {i}") for i in range(3))]),
    ("stco", "stbl", [("0", 4), ("2", 4), ("k * 5000", 4), ("k * 5000 + 77", 4)], [(0, "flags", "0"), (0, "offset", "k * 5000"), (1, "offset", "k * 5000 + 77")]),
]


def _files() -> tuple[str, str]:
    """The file as hexadecimal digits, and its fields as SQL."""
    out, rows, at, above = ["'0000000C6A5020200D0A870A'"], [], 12, ""
    for name, inside, parts, fields in BOXES:
        if inside != above and inside:
            size = 8 + sum(_size(p) + 8 for _, i, p, _ in BOXES if i == inside)
            out.append(f"'{size:08X}{inside.encode().hex().upper()}'")
            at += 8
        above = inside
        out += [f"'{_size(parts) + 8:08X}{name.encode().hex().upper()}'", _bytes(parts)]
        rows += [f"select k::varchar path, '{name}' as name, {at}::bigint pos, {i}::bigint item, '{f}' field, ({v})::bigint as \"value\" from r" for i, f, v in fields]
        at += _size(parts) + 8
    return f"concat({', '.join(out)})", sql("regions", ", r as (select region k, x0, y0, x1, y1 from regions) " + " union all ".join(rows))


def files(spark, d) -> DataFrame:
    """path and content: boxes of a still image and of a movie's sample tables."""
    r = R.regions(spark, d).withColumnRenamed("region", "k")
    return r.select(F.col("k").cast("string").alias("path"), F.unhex(F.expr(_files()[0])).alias("content"))


@query(_files()[1])
def box_bodies(spark, d):
    return M.box_rows(files(spark, d))
