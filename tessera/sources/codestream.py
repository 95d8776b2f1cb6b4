"""Codestreams and boxes: finding the format, scanning markers, reading headers. Layouts follow ITU-T T.800 and T.802."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.workers import ship

#: Marker codes.
MARKERS = {
    0xFF4F: "SOC", 0xFF50: "CAP", 0xFF51: "SIZ", 0xFF52: "COD", 0xFF53: "COC", 0xFF55: "TLM", 0xFF57: "PLM", 0xFF58: "PLT", 0xFF5C: "QCD", 0xFF5D: "QCC", 0xFF5E: "RGN",
    0xFF5F: "POC", 0xFF60: "PPM", 0xFF61: "PPT", 0xFF63: "CRG", 0xFF64: "COM", 0xFF72: "DFS", 0xFF74: "MCT", 0xFF75: "MCC", 0xFF77: "MCO", 0xFF78: "CBD", 0xFF79: "ATK",
    0xFF90: "SOT", 0xFF91: "SOP", 0xFF92: "EPH", 0xFF93: "SOD", 0xFFD9: "EOC",
}
NO_LENGTH = {"SOC", "SOD", "EOC", "EPH"}
SUPERBOXES = {"jp2h", "res ", "asoc", "uinf", "moov", "trak", "mdia", "minf", "stbl", "dinf"}
ORDERS = ["LRCP", "RLCP", "RPCL", "PCRL", "CPRL", "PRCL"]


def detect(content: Column) -> Column:
    """J2K, JP2, MJ2 or UNK by the first bytes."""
    head = F.hex(F.substring(content, 1, 32))
    return (
        F.when(F.startswith(head, F.lit("FF4FFF51")), "J2K")
        .when(F.startswith(head, F.lit("0000000C6A5020200D0A870A")) & (F.substring(head, 41, 8) == "6D6A7032"), "MJ2")
        .when(F.startswith(head, F.lit("0000000C6A5020200D0A870A")), "JP2")
        .otherwise("UNK")
    )


def scan(data: bytes) -> Iterator[tuple[str, int, int]]:
    """Name, place and length of each marker segment; a tile part's data is skipped by its length. Stops where data is cut off."""
    at = 0
    while at + 2 <= len(data):
        code = struct.unpack_from(">H", data, at)[0]
        name = MARKERS.get(code, f"{code:04X}")
        if code < 0xFF00:
            return
        if name in NO_LENGTH:
            yield name, at, 2
            at += 2
            continue
        if at + 4 > len(data):
            return
        size = struct.unpack_from(">H", data, at + 2)[0]
        yield name, at, size + 2
        if name == "SOT":
            total = struct.unpack_from(">I", data, at + 6)[0]
            end = at + total if total else len(data) - 2
            inner = at + size + 2
            while inner + 4 <= min(end, len(data)) and struct.unpack_from(">H", data, inner)[0] != 0xFF93:
                n = struct.unpack_from(">H", data, inner + 2)[0]
                yield MARKERS.get(struct.unpack_from(">H", data, inner)[0], "?"), inner, n + 2
                inner += n + 2
            yield "SOD", inner, 2
            at = end
        else:
            at += size + 2


def header(data: bytes) -> dict | None:
    """Geometry, components and coding style; None if there is no whole SIZ."""
    out: dict = {}
    for name, at, size in scan(data):
        if name == "SIZ" and at + size <= len(data):
            _, x1, y1, x0, y0, tw, th, tx0, ty0, n = struct.unpack_from(">HIIIIIIIIH", data, at + 4)
            comps = [struct.unpack_from("BBB", data, at + 40 + 3 * i) for i in range(n)]
            out |= {"x0": x0, "y0": y0, "x1": x1, "y1": y1, "tx0": tx0, "ty0": ty0, "tw": tw, "th": th, "numcomps": n}
            out["components"] = [{"prec": (p & 0x7F) + 1, "sgnd": bool(p & 0x80), "dx": dx, "dy": dy} for p, dx, dy in comps]
        elif name == "COD":
            style, order, layers, mct, levels, cw, ch, _, kernel = struct.unpack_from(">BBHBBBBBB", data, at + 4)
            out |= {"order": ORDERS[order] if order < len(ORDERS) else "?", "layers": layers, "mct": mct, "numres": levels + 1, "irreversible": kernel == 0, "sop": bool(style & 2), "eph": bool(style & 4), "cblkw": 1 << (cw + 2), "cblkh": 1 << (ch + 2)}
        elif name == "SOT":
            break
    return out if "components" in out else None


def write_header(info: dict) -> bytes:
    """SOC, SIZ and COD for the same fields."""
    comps = b"".join(struct.pack("BBB", (c["prec"] - 1) | (0x80 if c["sgnd"] else 0), c["dx"], c["dy"]) for c in info["components"])
    siz = struct.pack(">HIIIIIIIIH", 0, info["x1"], info["y1"], info["x0"], info["y0"], info["tw"], info["th"], info["tx0"], info["ty0"], len(info["components"])) + comps
    cod = struct.pack(">BBHBBBBBB", 2 * info["sop"] + 4 * info["eph"], ORDERS.index(info["order"]), info["layers"], info["mct"], info["numres"] - 1, info["cblkw"].bit_length() - 3, info["cblkh"].bit_length() - 3, 0, 0 if info["irreversible"] else 1)
    seg = lambda code, body: struct.pack(">HH", code, len(body) + 2) + body
    return b"\xff\x4f" + seg(0xFF51, siz) + seg(0xFF52, cod)


def boxes(data: bytes, lo: int = 0, hi: int | None = None, level: int = 0) -> Iterator[tuple[int, str, int, int]]:
    """Level, type, place and length of each box, superboxes opened: a tree as rows."""
    hi = len(data) if hi is None else hi
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1 and lo + 16 <= hi:
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        end = hi if size == 0 else lo + size
        if end > hi or end < lo + head:
            return
        name = kind.decode("latin-1")
        yield level, name, lo, end - lo
        if name in SUPERBOXES:
            yield from boxes(data, lo + head, end, level + 1)
        lo = end


def box(kind: str, body: bytes) -> bytes:
    return struct.pack(">I4s", len(body) + 8, kind.encode("latin-1")) + body


def _each(files: DataFrame, key: str, content: str, schema: str, rows) -> DataFrame:
    ship(files.sparkSession)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = [(k, *r) for r in rows(data or b"")]
                if got:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in got])

    return files.select(F.col(key).cast("string").alias("path"), F.col(content)).mapInArrow(run, schema)


def marker_rows(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """path, marker, pos and length of every marker segment of every file."""
    return _each(files, key, content, "path string, marker string, pos long, length long", scan)


def box_rows(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    return _each(files, key, content, "path string, level long, box string, pos long, length long", boxes)


def images(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row of geometry and coding style for each file with a header."""

    def rows(data):
        h = header(data)
        if h:
            yield tuple(h.get(k, 0) for k in ("x0", "y0", "x1", "y1", "tw", "th", "numcomps", "layers", "numres", "mct"))

    return _each(files, key, content, "path string, x0 long, y0 long, x1 long, y1 long, tw long, th long, numcomps long, layers long, numres long, mct long", rows)


def components(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    def rows(data):
        for i, c in enumerate((header(data) or {}).get("components", [])):
            yield i, c["prec"], c["sgnd"], c["dx"], c["dy"]

    return _each(files, key, content, "path string, comp long, prec long, sgnd boolean, dx long, dy long", rows)


def decompact(runs: DataFrame, count: str = "n", value: str = "v") -> DataFrame:
    """Run-length tables of a movie (entry, n, v) as one row for each frame, numbered through."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum(count).over(W.partitionBy("movie").orderBy("entry").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = runs.withColumn("first", before.cast("long")).where(F.col(count) > 0)
    return placed.select("movie", F.explode(F.sequence(F.col("first"), F.col("first") + F.col(count) - 1)).alias("frame"), F.col(value))


def url_parts(url: Column) -> dict[str, Column]:
    """Scheme, bucket and key of a path in an object store, in the forms scheme://bucket/key and /vsiXX/bucket/key."""
    vsi = F.regexp_extract(url, r"^/vsi(s3|gs|az|adls)/([^/]+)/?(.*)$", 1)
    plain = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/]+)/?(.*)$"
    pick = lambda i: F.when(vsi != "", F.regexp_extract(url, r"^/vsi(s3|gs|az|adls)/([^/]+)/?(.*)$", i)).otherwise(F.regexp_extract(url, plain, i))
    return {"scheme": pick(1), "bucket": pick(2), "object": pick(3)}


def read_files(spark, path: str, glob: str = "*.j2k") -> DataFrame:
    """A folder of files, each as one row; any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
