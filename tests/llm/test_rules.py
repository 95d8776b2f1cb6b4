import re
from collections import Counter

from tessera.llm import quality_rules, url_filters
from tessera.llm.components import connected_components


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_and_verdicts(make, words, odd):
    rows = [(i, words(80, i)) for i in range(120)] + odd
    rows += [(500, "a b\na b\n \na b c d e\n"), (501, " ".join(f"{w}***" for w in words(80, 7).split())), (502, words(30, 1) + " " + words(30, 1)), (503, "x y z v w " * 3000)]
    got = {r.doc_id: r for r in quality_rules.filter_documents(make(rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(t), t
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert all(got[i].kept for i in range(120)) and not got[501].kept
    assert quality_rules.filter_documents(make([])).count() == 0


def test_sketches_merge(make, words):
    rows = [(i, words(30 + i, i)) for i in range(60)]
    whole = quality_rules.sketches(quality_rules.measure(make(rows)))
    parts = quality_rules.sketches(quality_rules.measure(make(rows[:25]))).union(quality_rules.sketches(quality_rules.measure(make(rows[25:]))))
    key = ["lang", "source", "measure", "bucket"]
    assert sorted(whole.collect()) == sorted(parts.groupBy(*key).agg({"n": "sum"}).collect())


def test_rules(spark):
    urls = ["http://a.net", "http://a.net/", "HTTP://WWW.Example.NET/en/x?q", "https://example.net/enx", "https://u.example.com/de/#f", "https://example.com/de", "http://x.org/fr/1", "nothing", None, "", "http://planet/", "http://net/x"]
    pages = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages).collect()}
    assert got[0] == ("a.net", "", None, "allow") and got[1] == ("a.net", "/", "net/", "block")
    assert got[2] == ("www.example.net", "/en/x", "example.net/en/", "allow") and got[3][2:] == ("net/", "block")
    assert got[4] == ("u.example.com", "/de/", "example.com/de/", "block") and got[5][2:] == (None, "allow")
    assert got[6][2:] == ("org/fr/", "allow") and got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10][2:] == (None, "allow") and got[11][2:] == ("net/", "block")
    assert url_filters.judge(pages.limit(0)).count() == 0
    many = [*url_filters.RULES, *((f"h{i}.test", "/", "block") for i in range(400))]
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, many).collect()} == got


def test_classes(spark):
    link = '<html><head><link href="{0}" rel=canonical></head>'
    rows = [
        (1, "http://a.test/1", link.format("http://b.net/x")), (2, "http://b.net/x", ""), (3, "http://c.test/", '<meta http-equiv="refresh" content="0; url=http://a.test/1">'),
        (4, "http://d.test/", link.format("http://example.net/en/1")), (5, "http://example.net/en/1", link.format("http://b.net/y")), (6, "http://b.net/y", None), (7, "http://e.test/", link.format("/other")), (8, "http://f.test/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filters.judge(pages).collect()}
    assert [got[i] for i in range(1, 9)] == ["block", "block", "block", "allow", "allow", "block", "allow", "allow"]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 199), (None, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 199: 199, 200: 199}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
