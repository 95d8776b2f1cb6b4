"""WARC archives with a two-level capture index.

Writing: pages are dealt out by ranges of their key (host reversed, then the rest of the URL, then the page's number), sorted, and
written as one archive for each range, every record a gzip member of its own. Beside each archive lies its index: sorted
lines (key, offset, length, digest, type) in gzip blocks of ``BLOCK_LINES`` lines. A sparse directory holds each block's first
key and byte range, one row for a block. Reading: a binary search in the directory finds the block, one in the block's lines
finds the capture, and one range read fetches the record.

Payloads that occur again are written as revisits of the record with the largest page number; payloads of fewer than
``min_revisit`` bytes are all written as responses. Archives lie in the shared folder, under a temporary name until a task is
done, so a repeated task replaces its own file. A null page number is written as an empty one and read as null; such pages are always
responses and come first among a key's captures. A null URL has the empty key, null html is an empty payload, repeated rows are written
each, an empty table gives no archives and an empty result, and further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.common import load, materialise, open_folder, shared_path, ship

BLOCK_LINES = 256
#: Payload bytes that one archive holds, about.
ARCHIVE_BYTES = 64 << 20
DIRECTORY = "first string, last string, n int, archive string, index_offset long, index_length long"
CAPTURE = "page_id long, key string, archive string, offset long, length long, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def key_of(url: Column) -> Column:
    """Reversed host and the rest of the URL without its scheme, as one sortable text."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.translate(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", "")), "\n\r\t ", "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload of its own."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    return ("\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    names = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    number = lambda x: int(n) if (n := x.rpartition(":")[2].rstrip(">")) else None
    body = rest[: int(names["content-length"])]
    return {
        "page_id": number(names["warc-record-id"]), "record_type": names["warc-type"], "payload_digest": names["warc-payload-digest"].removeprefix("sha1:"),
        "payload_bytes": int(names["x-payload-length"]), "refers_to": number(names["warc-refers-to"]) if "warc-refers-to" in names else None, "payload": body,
    }


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def line_of(url: Column, page: Column) -> Column:
    """The key that records are sorted by: the URL's, then the page's number."""
    return F.concat(key_of(url), F.lit(" "), F.coalesce(F.lpad(page.cast("long").cast("string"), 19, "0"), F.lit("")))


def captures(pages: DataFrame, min_revisit: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page, line (the sortable key with the page's number), url, payload, digest and refers_to, which is null for responses."""
    body = F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b""))
    base = pages.select(F.col(key).cast("long").alias("page"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"))
    base = base.withColumn("sha", F.sha1("payload"))
    # Only digests that occur again are joined back; a digest's rows may be split over tasks (AQE), for each needs one value.
    again = base.where(F.octet_length("payload") >= min_revisit).groupBy("sha").agg(F.max("page").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("sha", "keeper")
    held = materialise(again, "warc-again")
    joined = base.join(F.broadcast(held) if held.count() <= 200_000 else held, "sha", "left")
    refers = F.when((F.col("keeper") != F.col("page")) & (F.octet_length("payload") >= min_revisit), F.col("keeper"))
    return joined.select("page", line_of(F.col("url"), F.col("page")).alias("line"), "url", "payload", refers.alias("refers_to"))


def write(caps: DataFrame, folder: str | None = None, archives: int | None = None) -> DataFrame:
    """Writes archives and their indexes; returns the directory, one row for each index block."""
    spark = caps.sparkSession
    ship(spark)
    folder = folder or shared_path(spark, "warc")
    n = archives or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        mine = f"{root}/.{name}.{uuid.uuid4().hex}"
        out, idx, at, place = None, None, 0, 0
        lines: list[str] = []
        rows: list[tuple] = []

        def close_block():
            nonlocal place
            data = _member("".join(lines).encode())
            idx.write(data)
            rows.append((lines[0].split("\t")[0], lines[-1].split("\t")[0], len(lines), name, place, len(data)))
            place += len(data)
            lines.clear()

        for batch in batches:
            if batch.num_rows and out is None:
                out, idx = store.open_output_stream(mine), store.open_output_stream(mine + ".idx")
            for page, line, url, payload, refers in zip(*(batch.column(c) for c in ("page", "line", "url", "payload", "refers_to")), strict=True):
                body = payload.as_py()
                digest = digest_of(body)
                raw = _member(record(page.as_py(), url.as_py().replace("\r", "").replace("\n", ""), body, digest, refers.as_py()))
                out.write(raw)
                lines.append(f"{line.as_py()}\t{at}\t{len(raw)}\t{digest}\n")
                at += len(raw)
                if len(lines) == BLOCK_LINES:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            out.close()
            idx.close()
            store.move(mine, f"{root}/{name}")
            store.move(mine + ".idx", f"{root}/{name}.idx")
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema([("first", pa.string()), ("last", pa.string()), ("n", pa.int32()), ("archive", pa.string()), ("index_offset", pa.int64()), ("index_length", pa.int64())]))

    dealt = caps.repartitionByRange(n, "line").sortWithinPartitions("line")
    blocks = materialise(dealt.mapInArrow(run, DIRECTORY), "warc-directory")
    return blocks.select("first", "last", "n", F.concat(F.lit(folder + "/"), "archive").alias("archive"), "index_offset", "index_length")


def find(directory: DataFrame, lines: DataFrame) -> DataFrame:
    """Every record whose sortable key is among ``lines`` (line), once for each such record.

    The driver holds one key for each archive, of ``ARCHIVE_BYTES`` or so. Requests go to their archive's task in the order of their keys, behind that
    archive's part of the directory: a binary search there finds the block, one in the block's lines finds the captures, and one range read fetches each run
    of records that lie together.
    """
    spark = directory.sparkSession
    ship(spark)
    tops = sorted((r["first"], r["last"], r["archive"]) for r in directory.groupBy("archive").agg(F.min("first").alias("first"), F.max("last").alias("last")).collect())
    least, names = [t[0] for t in tops], [x.split(" ")[0] for x in CAPTURE.split(", ")]

    def place(batches):
        for batch in batches:
            rows = []
            for line in batch.column("line").to_pylist():
                at = bisect.bisect_right(least, line) - 1
                while at >= 0 and tops[at][1] >= line:  # more than one archive may hold a key that many records have
                    rows.append((tops[at][2], line))
                    at -= 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["archive", "line"])

    def run(batches):
        archive, blocks, wanted = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != archive:
                    yield from fetch(archive, blocks, wanted)
                    archive, blocks, wanted = row["archive"], [], []
                if row["n"]:
                    blocks.append((row["line"], row["last"], row["index_offset"], row["index_length"]))
                else:
                    wanted.append(row["line"])
                    if len(wanted) >= 16 * BLOCK_LINES:
                        yield from fetch(archive, blocks, wanted)
                        wanted = []
        yield from fetch(archive, blocks, wanted)

    def fetch(archive: str | None, blocks: list[tuple], wanted: list[str]):
        """wanted: sorted distinct keys."""
        if not wanted or not blocks:
            return
        store, path = open_folder(archive)
        first, last = [b[0] for b in blocks], [b[1] for b in blocks]
        with store.open_input_file(path + ".idx") as index:
            for at in range(bisect.bisect_left(last, wanted[0]), bisect.bisect_right(first, wanted[-1])):
                mine = wanted[bisect.bisect_left(wanted, first[at]) : bisect.bisect_right(wanted, last[at])]
                if not mine:
                    continue
                lines = [x.split("\t") for x in gzip.decompress(index.read_at(blocks[at][3], blocks[at][2])).decode().splitlines()]
                keys = [x[0] for x in lines]
                hits = [lines[i] for key in mine for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key))]
                if hits:
                    yield from _fetch(store, path, hits, archive, names)

    asked = lines.select("line").distinct().mapInArrow(place, "archive string, line string")
    none = (F.lit(None).cast(t).alias(c) for c, t in (("last", "string"), ("n", "int"), ("index_offset", "long"), ("index_length", "long")))
    blocks = directory.select("archive", F.col("first").alias("line"), "last", "n", "index_offset", "index_length")
    both = blocks.unionByName(asked.select("archive", "line", *none))
    n = max(len(tops), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return both.repartition(n, "archive").sortWithinPartitions("archive", F.col("n").isNull(), "line").mapInArrow(run, CAPTURE)


def read(directory: DataFrame) -> DataFrame:
    """Every record, block by block of the index, with one range read for each run of records that lie together."""
    ship(directory.sparkSession)
    names = [x.split(" ")[0] for x in CAPTURE.split(", ")]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_folder(row["archive"])
                with store.open_input_file(path + ".idx") as f:
                    lines = gzip.decompress(f.read_at(row["index_length"], row["index_offset"])).decode().splitlines()
                yield from _fetch(store, path, [x.split("\t") for x in lines], row["archive"], names)

    n = max(1, int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return directory.repartition(n).mapInArrow(run, CAPTURE)


def _fetch(store: fs.FileSystem, path: str, lines: list[list[str]], archive: str, names: list[str]):
    with store.open_input_file(path) as f:
        lo, hi = int(lines[0][1]), int(lines[-1][1]) + int(lines[-1][2])
        near = hi - lo <= sum(int(x[2]) for x in lines)
        raw = f.read_at(hi - lo, lo) if near else b""
        rows, held = [], 0
        for line, offset, length, _ in lines:
            a, size = int(offset), int(length)
            got = parse(gzip.decompress(raw[a - lo : a - lo + size] if near else f.read_at(size, a)))
            if got["record_type"] == "response" and digest_of(got["payload"]) != got["payload_digest"]:
                raise ValueError(f"{archive}: the payload at {a} doesn't have the digest {got['payload_digest']}")
            held += len(got["payload"])
            rows.append([got["page_id"], line, archive, a, size, got["record_type"], got["payload_digest"], got["payload_bytes"], got["refers_to"], got["payload"]])
            if held > 4 << 20:
                yield _batch(rows, names)
                rows, held = [], 0
        if rows:
            yield _batch(rows, names)


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.string())) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


class CaptureIndex:
    """Look-ups by URL: the directory stays a table, of which a look-up takes the blocks that may hold its key."""

    def __init__(self, directory: DataFrame):
        self.directory = directory

    def lookup(self, key: str) -> list[dict]:
        """All captures of a key (as ``key_of`` makes it), in the order of their page numbers."""
        low, high = key + " ", key + " ~"
        out = []
        for block in self.directory.where((F.col("first") <= high) & (F.col("last") >= low)).orderBy("first", "archive", "index_offset").collect():
            store, path = open_folder(block["archive"])
            with store.open_input_file(path + ".idx") as f:
                lines = [x.split("\t") for x in gzip.decompress(f.read_at(block["index_length"], block["index_offset"])).decode().splitlines()]
            keys = [x[0] for x in lines]
            with store.open_input_file(path) as f:
                for line in lines[bisect.bisect_left(keys, low) : bisect.bisect_right(keys, high)]:
                    out.append(parse(gzip.decompress(f.read_at(int(line[2]), int(line[1])))))
        return out


def archive(pages: DataFrame, min_revisit: int = 0, folder: str | None = None) -> DataFrame:
    """The directory of the archives written for ``pages``."""
    size = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("b")).first()["b"]
    least = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write(captures(pages, min_revisit), folder, max(least, size // ARCHIVE_BYTES))


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, looked up through the index; a stored payload is measured anew, and its digest was checked."""
    pages = load(spark, sf_dir, "pages")
    back = find(archive(pages), pages.select(line_of(F.col("url"), F.col("page_id")).alias("line")))
    own = F.col("record_type") == "response"
    size = F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return back.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
k as (select h, max(page_id) as keeper from p group by h)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, {base32} as payload_digest,
  case when page_id = keeper then 'response' else 'revisit' end as record_type,
  case when page_id <> keeper then keeper end as refers_to
from p join k using (h)
"""
_FIVE = "list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(((('0x' || substr(h || '0000', 1 + (i * 5) // 4, 2))::int) >> (3 - (i * 5) % 4)) & 31 as int), 1)), 'string_agg', '')"
SQL = SQL.format(base32=_FIVE)
