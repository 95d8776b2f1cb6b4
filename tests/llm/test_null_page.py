"""Pages without a number."""

from pyspark.sql import functions as F
from tessera.llm import warc


def test_null_page_id(spark):
    rows = [(1, "http://b.test/x", "<p>a</p>"), (None, "http://b.test/x", "<p>a</p>"), (None, "http://b.test/x", "<p>b</p>"), (None, None, None), (2, "http://c.test/", "<p>b</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    directory = warc.archive(pages).cache()
    got = warc.read(directory).collect()
    assert sorted((r.page_id or 0, r.record_type, bytes(r.payload), r.refers_to) for r in got) == sorted((i or 0, "response", (h or "").encode(), None) for i, _, h in rows)
    assert [x["page_id"] for x in warc.CaptureIndex(directory).lookup("test,b)/x")] == [None, None, 1]


def test_found_by_key(spark):
    """Look-ups of some keys, missing and repeated ones among them, give just their records, over several archives and blocks."""
    rows = [(i, f"http://h{i % 7}.test/p{i // 3}", f"<p>{i % 400}</p>") for i in range(2000)] + [(5, "http://h5.test/p1", "<p>5</p>"), (None, None, None), (None, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    directory = warc.archive(pages).cache()
    assert directory.count() > 7
    lines = pages.select("page_id", warc.line_of(F.col("url"), F.col("page_id")).alias("line"))
    got = warc.find(directory, lines.where("page_id % 5 = 0 or page_id is null").select("line").union(spark.createDataFrame([("test,h1)/none 0000000000000000001",), ("",), ("zz",)], "line string")))
    want = sorted([(p, h or "") for p, _, h in rows if p is None or p % 5 == 0], key=str)
    by = {r.page_id: r.payload for r in warc.read(directory).where("record_type = 'response'").collect()}
    assert sorted([(r.page_id, bytes(r.payload if r.record_type == "response" else by[r.refers_to]).decode()) for r in got.collect()], key=str) == want


def test_long_payload(spark):
    """A payload of several slices, and its revisit."""
    body = "long text \n" * 500_000
    pages = spark.createDataFrame([(1, "http://a.test/", body), (2, "http://b.test/", body)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.find(warc.archive(pages), pages.select(warc.line_of(F.col("url"), F.col("page_id")).alias("line"))).collect()}
    assert got[2].record_type == "response" and bytes(got[2].payload).decode() == body and got[1].refers_to == 2 and got[1].payload_bytes == len(body)
