"""PNM, PAM, PGX, BMP and raw rasters: bytes to samples and back, and a writer of files as a data source."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tessera.functions.workers import ship


#: Bytes of samples in a part of a file, which is the most that a task holds of it at once.
PART = 1 << 18
#: Images whose sizes come to the driver; the sizes of more than that are joined.
MANY_IMAGES = 10_000


@dataclass(frozen=True)
class Layout:
    """Where a file's samples lie: from byte ``start`` on, ``h`` lines of ``step`` bytes with ``n`` samples for each of ``w`` places, stored in the order ``comps``."""

    start: int
    n: int
    w: int
    h: int
    prec: int
    kind: str = "u1"
    padded: int = 0
    upward: bool = False
    comps: tuple[int, ...] = ()
    colours: np.ndarray | None = None

    @property
    def size(self) -> int:
        return np.dtype(self.kind).itemsize

    @property
    def step(self) -> int:
        return self.padded or self.w * self.n * self.size

    def read(self, data: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """comp, y, x and v of the samples in ``data``, which begins (at a sample's start) so many bytes behind the first sample."""
        held = np.frombuffer(data, self.kind, len(data) // self.size)
        line, place = np.divmod(np.arange(at, at + len(held) * self.size, self.size), self.step)
        if self.step > self.w * self.n * self.size:
            inside = place < self.w * self.n * self.size
            held, line, place = held[inside], line[inside], place[inside]
        x, comp = np.divmod(place // self.size, self.n)
        v, y = held.astype(np.int64), self.h - 1 - line if self.upward else line
        if self.comps:
            comp = np.array(self.comps)[comp]
        if self.colours is not None:
            n = self.colours.shape[1]
            comp, y, x, v = np.tile(np.arange(n), len(v)), np.repeat(y, n), np.repeat(x, n), self.colours[v].reshape(-1)
        return comp.astype(np.int32), y, x, v

    def planes(self, data: bytes) -> np.ndarray:
        if len(data) < self.start + self.step * self.h:
            raise ValueError(f"a file of {len(data)} bytes, where {self.start + self.step * self.h} are needed")
        comp, y, x, v = self.read(data[self.start : self.start + self.step * self.h], 0)
        out = np.zeros((self.n if self.colours is None else self.colours.shape[1], self.h, self.w), np.int64)
        out[comp, y, x] = v
        return out


def _interleaved(planes: np.ndarray, prec: int) -> bytes:
    return np.ascontiguousarray(planes.transpose(1, 2, 0)).astype(np.uint8 if prec <= 8 else np.dtype(">u2")).tobytes()


def pnm_head(n: int, h: int, w: int, prec: int) -> bytes:
    if n not in (1, 3):
        raise ValueError("PNM holds one or three components")
    return f"P{5 if n == 1 else 6}\n{w} {h}\n{(1 << prec) - 1}\n".encode()


def encode_pnm(planes: np.ndarray, prec: int) -> bytes:
    """planes (comps, h, w), one or three components."""
    return pnm_head(*planes.shape, prec) + _interleaved(planes, prec)


def pnm_layout(data: bytes) -> Layout:
    m = re.match(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if not m:
        raise ValueError("no binary PNM")
    top = int(m[4])
    return Layout(m.end(), 1 if m[1] == b"5" else 3, int(m[2]), int(m[3]), top.bit_length(), "u1" if top < 256 else ">u2")


def decode_pnm(data: bytes) -> tuple[np.ndarray, int]:
    own = pnm_layout(data)
    return own.planes(data), own.prec


def pam_head(n: int, h: int, w: int, prec: int) -> bytes:
    kind = {1: "GRAYSCALE", 2: "GRAYSCALE_ALPHA", 3: "RGB", 4: "RGB_ALPHA"}.get(n, "SAMPLES")
    return f"P7\nWIDTH {w}\nHEIGHT {h}\nDEPTH {n}\nMAXVAL {(1 << prec) - 1}\nTUPLTYPE {kind}\nENDHDR\n".encode()


def encode_pam(planes: np.ndarray, prec: int) -> bytes:
    return pam_head(*planes.shape, prec) + _interleaved(planes, prec)


def pam_layout(data: bytes) -> Layout:
    end = data.find(b"ENDHDR\n")
    if end < 0:
        raise ValueError("no PAM")
    found = dict(x.split(None, 1) for x in data[:end].decode("latin-1").splitlines()[1:] if x.strip() and not x.startswith("#"))
    n, h, w, top = (int(found[k]) for k in ("DEPTH", "HEIGHT", "WIDTH", "MAXVAL"))
    return Layout(end + 7, n, w, h, top.bit_length(), "u1" if top < 256 else ">u2")


def decode_pam(data: bytes) -> tuple[np.ndarray, int]:
    own = pam_layout(data)
    return own.planes(data), own.prec


def bmp_head(n: int, h: int, w: int, prec: int = 8) -> bytes:
    if n not in (1, 3):
        raise ValueError("BMP holds one or three components here")
    size = -(-w * n // 4) * 4 * h
    colours = b"".join(bytes((i, i, i, 0)) for i in range(256)) if n == 1 else b""
    start = 54 + len(colours)
    if start + size >= 1 << 32:
        raise ValueError(f"a BMP file of {start + size} bytes, more than its header can state")
    return struct.pack("<2sIHHI", b"BM", start + size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 * n, 0, size, 2835, 2835, len(colours) // 4, 0) + colours


def encode_bmp(planes: np.ndarray) -> bytes:
    """Uncompressed, bottom line first, lines of a multiple of four bytes: 8 bits with a grey palette, or 24 bits."""
    n, h, w = planes.shape
    head = bmp_head(n, h, w)
    lines = np.zeros((h, -(-w * n // 4) * 4), np.uint8)
    lines[:, : w * n] = planes[::-1, ::-1].transpose(1, 2, 0).reshape(h, w * n) if n == 3 else planes[0, ::-1]
    return head + lines.tobytes()


def bmp_layout(data: bytes) -> Layout:
    """Uncompressed files of 8 (through their palette), 24 or 32 bits, in either order of lines."""
    start, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24, 32):
        raise ValueError(f"no uncompressed BMP of 8, 24 or 32 bits: {bits} bits, compression {packed}")
    step, upward = -(-w * bits // 32) * 4, h > 0
    if bits > 8:
        return Layout(start, bits // 8, w, abs(h), 8, padded=step, upward=upward, comps=(2, 1, 0, 3))
    entries = struct.unpack_from("<I", data, 46)[0] or 256
    colours = np.frombuffer(data, np.uint8, 4 * entries, 14 + size).reshape(-1, 4)[:, 2::-1].astype(np.int64)
    grey = (colours == colours[:, :1]).all()
    return Layout(start, 1, w, abs(h), 8, padded=step, upward=upward, colours=colours[:, :1] if grey else colours)


def decode_bmp(data: bytes) -> tuple[np.ndarray, int]:
    own = bmp_layout(data)
    return own.planes(data), own.prec


def encode_pgx(plane: np.ndarray, prec: int, signed: bool) -> bytes:
    h, w = plane.shape
    kind = {1: "i1" if signed else "u1", 2: ">i2" if signed else ">u2"}.get((prec + 7) // 8, ">i4")
    return f"PG ML {'-' if signed else '+'} {prec} {w} {h}\n".encode() + plane.astype(kind).tobytes()


def pgx_layout(data: bytes) -> Layout:
    m = re.match(rb"PG (ML|LM) ?([+-]?) ?(\d+) (\d+) (\d+)\s", data)
    if not m:
        raise ValueError("no PGX")
    prec = int(m[3])
    size = 1 if prec <= 8 else 2 if prec <= 16 else 4
    return Layout(m.end(), 1, int(m[4]), int(m[5]), prec, (">" if m[1] == b"ML" else "<") + ("i" if m[2] == b"-" else "u") + str(size))


def decode_pgx(data: bytes) -> tuple[np.ndarray, int, bool]:
    own = pgx_layout(data)
    return own.planes(data)[0], own.prec, np.dtype(own.kind).kind == "i"


def layout(data: bytes) -> Layout:
    """Of a PNM, PAM, BMP or PGX file, from its first bytes."""
    kind = bytes(data[:2])
    return (pnm_layout if kind in (b"P5", b"P6") else pam_layout if kind == b"P7" else bmp_layout if kind == b"BM" else pgx_layout)(bytes(data))


def encode_raw(planes: np.ndarray, prec: int, signed: bool, big: bool = True) -> bytes:
    """Component after component."""
    size = 1 if prec <= 8 else 2
    return planes.astype((">" if big else "<") + ("i" if signed else "u") + str(size)).tobytes()


def decode_raw(data: bytes, comps: int, w: int, h: int, prec: int, signed: bool, big: bool = True) -> np.ndarray:
    size = 1 if prec <= 8 else 2
    return np.frombuffer(data, (">" if big else "<") + ("i" if signed else "u") + str(size), comps * w * h).reshape(comps, h, w).astype(np.int64)


def pack_bits(values: np.ndarray, prec: int) -> bytes:
    """Samples of 1 to 16 bits, most significant bit first, without padding between them."""
    bits = (values.reshape(-1, 1).astype(np.int64) >> np.arange(prec - 1, -1, -1)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1)).tobytes()


def unpack_bits(data: bytes, prec: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))[: n * prec].reshape(n, prec).astype(np.int64)
    return bits @ (1 << np.arange(prec - 1, -1, -1))


def read_samples(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """path, comp, y, x, v of PNM, PAM, BMP and PGX files. A row is a file, or with columns head and start (see ``to_parts``) a part of one; its samples leave as they are decoded."""
    ship(files.sparkSession)
    parts = "head" in files.columns and "start" in files.columns

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                k, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                head, first = (batch.column(2)[i].as_py(), batch.column(3)[i].as_py()) if parts else (data, 0)
                own = layout(head)
                end = own.start + own.step * own.h
                if not parts and len(data) < end:
                    raise ValueError(f"{k}: a file of {len(data)} bytes, where {end} are needed")
                at = max(first, own.start)
                for low in range(at, min(first + len(data), end), PART):
                    part = data[low - first : min(low + PART, end) - first]
                    comp, y, x, v = own.read(part, low - own.start)
                    if len(v):
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(k, pa.string()), len(v)), pa.array(comp), pa.array(y), pa.array(x), pa.array(v)], names=["path", "comp", "y", "x", "v"])

    columns = [F.col(key).cast("string"), F.col(content), *((F.col("head"), F.col("start")) if parts else ())]
    return files.select(*columns).mapInArrow(run, "path string, comp int, y long, x long, v long")


def to_parts(samples: DataFrame, prec: int, key: str = "image_id", kind: str = "pnm") -> DataFrame:
    """name, head, start, content: a file (pnm, pam or bmp) for each image, in parts of ``PART`` bytes, so that a task's memory doesn't grow with the image.

    The contents in the order of their start are the file; head is what precedes the samples, so a part can be read alone. What an image lacks is 0.
    """
    ship(samples.sparkSession)
    size = 2 if prec > 8 and kind != "bmp" else 1
    make = {"pnm": pnm_head, "pam": pam_head, "bmp": bmp_head}[kind]
    n, h, w = (F.col(c) for c in ("_n", "_h", "_w"))
    step = F.ceil(w * n / 4) * 4 if kind == "bmp" else w * n * size
    sizes = samples.groupBy(key).agg(*((F.max(c) + 1).cast("long").alias(f"_{a}") for c, a in (("comp", "n"), ("y", "h"), ("x", "w")))).where("_n > 0 and _h > 0 and _w > 0")
    known = sizes.limit(MANY_IMAGES + 1).collect()
    if len(known) <= MANY_IMAGES:
        sizes = samples.sparkSession.createDataFrame(known, sizes.schema).coalesce(1)
        own = samples.join(F.broadcast(sizes), key)
    else:
        own = samples.join(sizes, key)
    line = h - 1 - F.col("y") if kind == "bmp" else F.col("y")
    comp = F.when(n == 3, 2 - F.col("comp")).otherwise(F.col("comp")) if kind == "bmp" else F.col("comp")
    at = (line * step + (F.col("x") * n + comp) * size).cast("long")
    held = own.where("comp >= 0 and y >= 0 and x >= 0").select(key, "_n", "_h", "_w", at.alias("_at"), F.col("v").cast("long").alias("_v")).where("_v is not null")
    # Every part has a row of its own, whether or not it has samples.
    starts = F.sequence(F.lit(0).cast("long"), (h * step - 1).cast("long"), F.lit(PART).cast("long"))
    marks = sizes.select(key, "_n", "_h", "_w", F.explode(starts).alias("_at"), F.lit(None).cast("long").alias("_v"))
    pieces = held.unionByName(marks).withColumn("_part", F.floor(F.col("_at") / PART).cast("long"))

    def build(table: pa.Table) -> pa.Table:
        k, n, h, w, part = (table.column(c)[0].as_py() for c in (key, "_n", "_h", "_w", "_part"))
        total = h * (-(-w * n // 4) * 4 if kind == "bmp" else w * n * size)
        out = np.zeros(-(-min(PART, total - part * PART) // size), np.uint8 if size == 1 else np.dtype(">u2"))
        some = table.filter(table.column("_v").is_valid())
        out[(some.column("_at").to_numpy() - part * PART) // size] = some.column("_v").to_numpy().astype(out.dtype)
        head = make(n, h, w, prec)
        name = f"{k}." + (("pgm" if n == 1 else "ppm") if kind == "pnm" else kind)
        start = len(head) + part * PART if part else 0
        return pa.table({"name": [name], "head": pa.array([head], pa.binary()), "start": pa.array([start], pa.int64()), "content": pa.array([(b"" if part else head) + out.tobytes()], pa.binary())})

    return pieces.groupBy(key, "_part").applyInArrow(build, "name string, head binary, start long, content binary")


def to_files(samples: DataFrame, prec: int, key: str = "image_id", kind: str = "pnm") -> DataFrame:
    """name, start, content: the parts of each image's file, those of a file in one partition and in order, as the file sink takes them."""
    return to_parts(samples, prec, key, kind).select("name", "start", "content").repartition("name").sortWithinPartitions("name", "start")


class FileSink(DataSource):
    """Writes rows (name, start, content) as files of a folder: df.write.format("files").mode("append").save(folder). The parts of a file follow each other in order in one partition."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, start long, content binary"

    def writer(self, schema, overwrite):
        return _FileWriter(self.options["path"])


class _FileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows) -> WriterCommitMessage:
        import uuid

        from pyarrow import fs

        store, root = (fs.LocalFileSystem(), "/" + self.folder.removeprefix("file:").lstrip("/")) if self.folder.startswith(("/", "file:")) else fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        name, mine, f = None, None, None
        for row in rows:
            if f is not None and row["start"] == 0:
                f.close()
                store.move(mine, f"{root}/{name}")
                f = None
            if f is None:
                name = row["name"]
                mine = f"{root}/.{name}.{uuid.uuid4().hex}"
                f = store.open_output_stream(mine)
            if row["name"] != name or row["start"] != f.tell():
                f.close()
                raise ValueError(f"{row['name']}: a part from byte {row['start']} on, not in its order")
            f.write(bytes(row["content"]))
        if f is not None:
            f.close()
            store.move(mine, f"{root}/{name}")
        return WriterCommitMessage()
