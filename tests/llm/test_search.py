import random

import numpy as np
from tessera.llm import decontamination as D
from tessera.llm import warc


def test_leaks(spark, make, words, odd):
    rng = random.Random(4)
    items = [(i, words(20 + i, 500 + i)) for i in range(20)] + [(90, ""), (91, None)]
    rows, want = list(odd), set()
    for i in range(300):
        t = words(150, 9000 + i).split()
        if i % 10 == 0:
            j = i // 10 % 20
            leak = items[j][1].split()
            if i % 20 == 10:  # a paraphrase: some words replaced, the end kept
                for k in rng.sample(range(len(leak) - 6), len(leak) // 6):
                    leak[k] = f"other{k}"
            at = rng.randrange(100)
            t[at:at] = [w.upper() for w in leak] if i % 30 == 0 else leak
            want.add((i, j))
        rows.append((i, " ".join(t)))
    rows.append((700, " ".join(items[3][1].split()[:8])))  # a third of an item is none
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.decontaminate(make(rows), bench).collect()}
    assert not set(got) - want
    assert len(set(got) & want) >= 0.9 * len(want)
    assert {r.kind for r in got.values()} == {"verbatim", "paraphrase"} or all(r.lcs_share >= D.VERBATIM for r in got.values())
    assert D.decontaminate(make([]), bench).count() == 0
    assert D.decontaminate(make(rows), bench.limit(0)).count() == 0


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert D.lcs(a, b) == row[-1]


def test_sketch_finds_singular_vectors():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 5)) @ np.diag([30, 20, 10, 5, 2]) @ np.linalg.qr(rng.normal(size=(D.TERMS, 5)))[0].T
    z = a.T @ (a @ D.random_test_matrix().astype(float))
    v, s = D.singular_vectors(z, 5)
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False)[:5], rtol=1e-6)
    assert np.allclose(np.abs(np.linalg.svd(a @ v, compute_uv=False)), s, rtol=1e-6)


PAGES = [(1, "http://b.test/x?q=1", "<p>é</p>"), (2, None, None), (3, "http://a.b.test/", "<p>é</p>"), (4, "http://B.test/x?q=1", ""), (5, "nothing", "<p>é</p>"), (6, "http://b.test/x?q=1", "y" * 5000), (7, "http://b.test/a\nb", "z")]


def test_archives(spark):
    pages = spark.createDataFrame([(*p, "k") for p in PAGES], "page_id long, url string, html string, line string")
    directory = warc.archive(pages).cache()
    got = {r.page_id: r for r in warc.read(directory).collect()}
    assert set(got) == {p[0] for p in PAGES}
    body = {p[0]: (p[2] or "").encode() for p in PAGES}
    for i, r in got.items():
        keeper = max(j for j in body if body[j] == body[i])
        assert (r.record_type, r.refers_to) == (("response", None) if keeper == i else ("revisit", keeper))
        assert r.payload_bytes == len(body[i]) and r.payload_digest == warc.digest_of(body[i])
        assert bytes(r.payload) == (body[i] if keeper == i else b"")
    index = warc.CaptureIndex(directory)
    assert [x["page_id"] for x in index.lookup("test,b)/x?q=1")] == [1, 4, 6]
    assert [x["page_id"] for x in index.lookup("test,b,a)/")] == [3] and index.lookup("test,c)/") == []
    assert warc.read(warc.archive(pages.limit(0))).count() == 0


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read(warc.archive(pages, min_revisit=100)).collect()}
    assert set(got.values()) == {"response"}


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    pages = spark.range(200).selectExpr("id as page_id", "concat('http://h', id % 13, '.test/', id % 3) as url", "concat('<p>', id % 50) as html")
    directory = warc.archive(pages).cache()
    assert directory.count() >= 200 / 7
    index = warc.CaptureIndex(directory)
    assert [x["page_id"] for x in index.lookup("test,h5)/1")] == [i for i in range(200) if i % 13 == 5 and i % 3 == 1]
    assert warc.read(directory).count() == 200
