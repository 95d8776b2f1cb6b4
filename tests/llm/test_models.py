import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tessera.llm import katz, quality_classifier, toxicity
from tessera.llm.common import Words


def text_words(text):
    raw = text.encode()
    return Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))


# ------------------------------------------------------------ quality


@pytest.fixture(scope="module")
def graded(words):
    """Ids, texts and quality: shouting and marked words are bad."""
    out = []
    for i in range(600):
        t = words(60, i)
        out.append((i, " ".join(w.upper() + "!!" if i % 5 == 0 else w + "***" if i % 5 == 1 else w for w in t.split()), int(i % 5 > 1)))
    return out


def test_quality(spark, make, graded, odd):
    docs = make([(i, t) for i, t, _ in graded] + odd)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in graded[:400]] + [(5, None, 0), (None, 1, 0), (7, graded[7][2], 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).collect()}
    assert len(got) == len(graded) + len(odd)
    held = [i for i, _, _ in graded if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i].held_out} == {i for i in got if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([got[i].predicted == graded[i][2] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_quality_without_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make([(1, "a b"), (2, None)])
    assert {r.score for r in quality_classifier.classify(docs, quality_classifier.fit(docs, none)).collect()} == {0.5}
    assert quality_classifier.classify(make([]), quality_classifier.fit(make([]), none)).count() == 0


# ------------------------------------------------------------ toxicity


@pytest.fixture(scope="module")
def insults(words):
    rng = random.Random(9)
    bad = ["blockhead", "nitwit", "scoundrel", "dimwit"]
    out = []
    for i in range(900):
        w = words(50, 3000 + i).split()
        if i % 4 == 0:
            w[rng.randrange(50)] = rng.choice(bad)
            w[rng.randrange(50)] = rng.choice(bad)
        out.append((i, " ".join(w), int(i % 4 == 0)))
    return out


def test_toxicity(spark, make, words, insults, odd):
    seen = [(2000, "st4rt " + words(20, 1) + " n1tw1t " + words(5, 2)), (2001, words(9, 3) + " d i m w i t"), (2002, "b.l.o.c.k.h.e.a.d " + words(9, 4)), (2003, "scounnnnndrel"), (2004, words(30, 5) + " r2d2 user@mail.test 10.0.0.1 a b c"), (2005, "NITWIT!")]
    docs = make([(i, t) for i, t, _ in insults] + seen + odd)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in insults] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model.names) == {"blockhead", "nitwit", "scoundrel", "dimwit"}
    got = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    assert all(got[i].predicted == y for i, _, y in insults)
    assert [got[i].predicted for i in (2000, 2001, 2002, 2003, 2004, 2005)] == [1, 1, 1, 1, 0, 1]
    assert all(got[i].predicted == 0 for i, _ in odd) and len(got) == len(insults) + len(seen) + len(odd)
    back = {r.doc_id: r.restored for r in toxicity.restore(docs, model).collect()}
    assert "dimwit" in back[2001] and "nitwit" in back[2000]


def test_copies_teach_nothing(spark, make, words):
    copies = [(i, words(40, 1)) for i in range(80)] + [(i, words(40, i)) for i in range(80, 300)]
    labels = spark.createDataFrame([(i, 1, int(i < 80)) for i, _ in copies], "doc_id long, quality int, toxic int")
    assert not [e for e in toxicity.learn(make(copies), labels)[0] if e.sure >= toxicity.STRONG]


def test_toxicity_without_rows(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.classify(make([]), toxicity.fit(make([]), none)).count() == 0
    assert {r.score for r in toxicity.classify(make([(1, "x")]), toxicity.fit(make([(1, "x")]), none)).collect()} == {0.0}


# ------------------------------------------------------------ language model


def katz_by_hand(rows):
    k = katz.K
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    train = [t for i, t in tokens if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    one, two = Counter(), Counter()
    for t in train:
        one.update(t)
        two.update(zip([0, *t[:-1]], t, strict=True))
    n = sum(one.values())

    def discount(counts):
        of = Counter(counts.values())
        part = of[1] / (of[1] + 2 * of[2]) if of[2] else 0.5
        d = {r: (r - part) / r if of[1] else 1.0 for r in range(1, k + 1)}
        a = (k + 1) * of[k + 1] / of[1] if of[1] else 1
        if a < 1 and all(of[r] for r in range(1, k + 2)):
            good = {r: ((r + 1) * of[r + 1] / of[r] / r - a) / (1 - a) for r in d}
            d |= {r: g for r, g in good.items() if 0 < g <= 1}
        return lambda c: d.get(c, 1.0)

    d1, d2 = discount(one), discount(two)
    lost = 1 - sum(d1(c) * c for c in one.values()) / n
    p1 = lambda w: d1(one[w]) * one[w] / n if w in one else lost
    seen = defaultdict(list)
    for (h, w), c in two.items():
        seen[h].append((w, c))

    def p(h, w):
        if h not in seen:
            return p1(w)
        total, kept, mass = sum(c for _, c in seen[h]), sum(d2(c) * c for _, c in seen[h]), sum(p1(x) for x, _ in seen[h])
        full = total - kept <= 1e-12 * total
        den = total + full
        return d2(two[h, w]) * two[h, w] / den if (h, w) in two else (1 if full else total - kept) / den / (1 - mass) * p1(w)

    return tokens, one, n, p


def test_katz(make, words, odd, monkeypatch):
    rows = [(i, words(15 + i % 30, i)) for i in range(150)] + [(i, words(40, 7)) for i in range(200, 212)] + [r for r in odd if r[0] is not None]
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 400)
    got = {r.doc_id: r for r in katz.score(make(rows)).collect()}
    tokens, one, n, p = katz_by_hand(rows)
    for i, t in tokens:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in one for w in t), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 0.1) / (n + 0.1 * (len(one) + 1))) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip([0, *t[:-1]], t, strict=True)))
    some = tokens[3][1][0]
    assert sum(p(some, w) for w in one) + p(some, b"never seen") == pytest.approx(1)


def test_katz_without_rows(make):
    assert katz.score(make([])).count() == 0
    assert len(katz.score(make([(None, "a b"), (None, None)])).collect()) == 2


def test_keys_round_trip():
    for keys in ([], [5], [0, 1, 2**40], [7, 2**20, 2**21]):
        k = np.array(keys, np.uint64)
        assert katz.unpack_keys(katz.pack_keys(k)).tolist() == keys if keys else True
    v = np.array([1, 2, 70000], np.uint32)
    assert katz.unpack(katz.pack(v)).tolist() == v.tolist()
