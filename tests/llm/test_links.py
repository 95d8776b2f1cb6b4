"""Link targets that are no pages, and relative ones."""

from urllib.parse import urljoin

from pyspark.sql import functions as F
from tessera.llm import url_filters


def test_targets_outside_the_table(spark):
    link, refresh = "<link rel=canonical href='{0}'>", '<meta http-equiv=refresh content="0; url={0}">'
    rows = [
        (1, "http://a.test/1", link.format("http://x.net/gone")), (2, "http://b.test/", refresh.format("http://x.net/other")), (3, "http://b.test/2", refresh.format("http://b.test/")),
        (4, "http://c.net.test/", link.format("http://example.net/en/1")), (5, "http://d.net/", link.format("http://example.net/en/1")),
        (6, "http://www.example.com/a/b", link.format("../de/x.html")), (7, "http://www.example.com/de", link.format("de/")), (8, "http://e.test/a", link.format("b?to=http://x.net/")),
        (9, "http://f.test/a", link.format("mailto:x@y.net")), (10, "http://g.test/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pairs = spark.createDataFrame([("http://g.test/", "http://y.net/1")], "from_url string, to_url string")
    want = {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "block"}
    for rules in (url_filters.RULES, [*url_filters.RULES, *((f"h{i}.test", "/", "block") for i in range(400))]):
        got = url_filters.judge(pages, rules, pairs).collect()
        assert len(got) == len(rows) and {r.page_id: r.verdict for r in got} == want


def test_resolved_as_by_the_standard(spark):
    pages = ["http://h.test", "http://h.test/", "http://h.test/a/b/c?q=/x/y#f", "http://h.test/a/b/"]
    hrefs = ["x.html", "./x", "../x", "../../../x", "..", ".", "a/./b/../c?z=../q", "/r/../s", "/", "?k=1", "x?u=http://n.net/", "//n.test/p", "https://n.test/p", "x/", "../x#f"]
    df = spark.createDataFrame([(p, h) for p in pages for h in hrefs], "url string, href string")
    got = df.select("url", "href", url_filters.node_of(url_filters._target(F.col("href"), F.col("url"))).alias("n"))
    ideal = spark.createDataFrame([(p, h, urljoin(p, h)) for p in pages for h in hrefs], "url string, href string, to string").select("url", "href", url_filters.node_of(F.col("to")).alias("n"))
    assert {(r.url, r.href): r.n for r in got.collect()} == {(r.url, r.href): r.n for r in ideal.collect()}


def test_every_link(spark):
    """Several links of a kind, and & written as an entity."""
    html = "<link rel=canonical href='http://a.test/1'><meta http-equiv=refresh content='0; url=http://x.net/'><link rel=canonical href='http://b.test/?a=1&amp;b=2'>"
    pages = spark.createDataFrame([(1, "http://c.test/", html), (2, "http://a.test/1", None), (3, "http://b.test/?a=1&b=2", None), (4, "http://d.test/", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.component) for r in url_filters.judge(pages).collect()}
    assert got[4] == ("allow", None) and {got[i] for i in (1, 2, 3)} == {("block", got[1][1])} and got[1][1] is not None
