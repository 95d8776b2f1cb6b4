"""Shared pieces: durable tables, vectorised word hashing, Arrow slicing."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.workers import ship

#: Bytes of text that a Python step looks at in one go; longer texts get a slice of their own.
SLICE_BYTES = 1 << 20
#: Texts of a slice at most.
SLICE_ROWS = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one is set if all runs in one local process, and an error raised otherwise."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Folders that this thread has made since its last call of ``forget``.
_here = threading.local()


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _here.made = [*getattr(_here, "made", []), path]
    return path


def forget() -> list[str]:
    """The intermediate folders made since the last call, for ``discard`` once nothing reads them any more."""
    out, _here.made = getattr(_here, "made", []), []
    return out


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders, in whatever store they lie."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, for Python workers, and the path there."""
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % F.lit(n)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- word hashing

_M = np.uint64(0xBF58476D1CE4E5B9)
_N = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    got = _powers.get(kind)
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES + 4096)
        step = np.full(size, _BASE if kind == "up" else _BASE_INV, np.uint64)
        step[0] = 1
        got = np.multiply.accumulate(step)
        if size <= 8 * SLICE_BYTES:
            _powers[kind] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * _M
    h = (h ^ (h >> np.uint64(27))) * _N
    return h ^ (h >> np.uint64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some UTF-8 texts that lie one after another in ``buf``.

    starts, ends: byte ranges; first: for each text the index of its first word, and a last entry with the number of words;
    doc: the text of each word. ``hashes`` are 64 bits of each word's bytes, A-Z lower-cased if asked for.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets
        solid = (buf != 0x20) & (buf - np.uint8(9) > 4)
        before = np.empty(len(buf) + 1, bool)
        before[0], before[1:] = False, solid
        cuts = offsets[(offsets > 0) & (offsets < len(buf))]
        head = solid & ~before[:-1]
        head[cuts] = solid[cuts]
        tail = np.empty(len(buf), bool)
        if len(buf):
            tail[-1] = solid[-1]
            tail[:-1] = solid[:-1] & ~solid[1:]
            tail[cuts - 1] = solid[cuts - 1]
        self.starts, self.ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._sums: dict[bool, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def _sum(self, lower: bool) -> np.ndarray:
        if lower not in self._sums:
            out = np.zeros(len(self.buf) + 1, np.uint64)
            (_BYTE_LOWER if lower else _BYTE).take(self.buf, out=out[1:], mode="clip")  # in place, as fresh memory costs more than the sums
            out[1:] *= _power("up", len(self.buf))[: len(self.buf)]
            np.cumsum(out[1:], out=out[1:])
            self._sums[lower] = out
        return self._sums[lower]

    def hashes(self, lower: bool = True, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        if not len(starts):
            return np.zeros(0, np.uint64)
        s = self._sum(lower)
        return mix((s[ends] - s[starts]) * _power("down", len(self.buf) + 1)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def text(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def word_hash(word: bytes) -> int:
    """The hash that ``Words.hashes`` gives to one word, lower-cased."""
    w = Words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
    return int(w.hashes()[0])


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several in order."""
    h = np.full(len(parts[0]), 0x2545F4914F6CDD1D, np.uint64)
    for p in parts:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + p)
    return h


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a binary column with their bytes and offsets, about ``limit`` bytes at a time; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + SLICE_ROWS)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def text_of(df: DataFrame, key: str = "doc_id", text: str = "text", *more: str, lower: bool = False) -> DataFrame:
    """The key, further columns and the text as bytes under fixed names; whatever else ``df`` holds stays out. lower: all letters, not A-Z alone."""
    ship(df.sparkSession)
    return df.select(F.col(key).alias("key"), *(F.col(c) for c in more), (F.lower(F.col(text).cast("string")) if lower else F.col(text).cast("string")).cast("binary").alias("body"))


def keep_rows(docs: DataFrame, wanted: Callable[["Words"], np.ndarray], text: str = "text", lower: bool = False) -> DataFrame:
    """The rows of ``docs``, as they are, for whose texts ``wanted`` gives true; rows without id and repeated rows are judged like others."""
    ship(docs.sparkSession)

    @F.arrow_udf("boolean")
    def verdict(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for body in bodies:
            masks = [wanted(Words(buf, offsets)) for _, _, buf, offsets in slices(body)]
            yield pa.array(np.concatenate(masks) if masks else np.zeros(0, bool))

    body = F.col(text).cast("string")
    # Only the text goes to Python, and only the verdict comes back.
    return docs.where(verdict((F.lower(body) if lower else body).cast("binary")))


def ragged_bytes(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose row i holds the bytes of values[bounds[i]:bounds[i+1]]."""
    values = np.ascontiguousarray(values)
    at = (bounds.astype(np.int64) * values.dtype.itemsize)
    if at[-1] < 2**31 - 1:
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
    return pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
