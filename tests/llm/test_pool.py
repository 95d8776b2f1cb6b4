import numpy as np
from tessera.llm import quality_classifier as qc
from tessera.llm.common import Words


def many(texts):
    raw = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def model():
    rng = np.random.default_rng(1)
    m = qc.Model(rng.normal(size=(qc.ROWS, qc.DIMS)))
    width = 3 * qc.DIMS + 3
    m.mean, m.scale = rng.normal(size=width) / 10, rng.uniform(0.5, 2, width)
    m.w1, m.b1, m.w2, m.b2 = rng.normal(size=(width, 24)) / 5, rng.normal(size=24), rng.normal(size=24), 0.1
    return m


def plain(m, text):
    """Features of one text, a word at a time."""
    raw = text.encode().split()
    x, seen = np.zeros(3 * qc.DIMS + 3), set()
    before = None
    for k, w in enumerate(raw):
        one = many([w.decode()])
        own, look = int(one.hashes()[0] % np.uint64(qc.BUCKETS)), int(qc.shapes(one)[0])
        x[: qc.DIMS] += m.context[own]
        x[qc.DIMS : 2 * qc.DIMS] += m.context[qc.BUCKETS + look]
        x[2 * qc.DIMS : 3 * qc.DIMS] += qc.shape_index()[look]
        x[-3] += own == before
        before = own
        if k > 1:
            triple = tuple(r.lower() for r in raw[k - 2 : k + 1])
            x[-2] += triple in seen
            seen.add(triple)
    x /= max(len(raw), 1)
    x[-1] = np.log1p(len(raw)) / 10
    return x


def test_pool_and_folded_scores(words):
    texts = ["", "a", "a a a a b a a a", "Été ÜBER 12,5 (x) don't", " \n\t ", words(400, 1), words(3000, 2).upper() + " b", ""]
    m, w = model(), many(texts)
    x = m.pool(w)
    assert np.allclose(x, [plain(m, t) for t in texts], atol=1e-5)
    assert np.allclose(m.score_texts(w), m.score(x), atol=1e-5)
    alone = np.concatenate([m.score_texts(many([t])) for t in texts])
    assert np.array_equal(alone, m.score_texts(w))  # whatever lies beside a text in its slice


def test_shapes():
    got = qc.shapes(many(["ab Ab AB a1 a! !!!! x" + "y" * 300]))
    assert len(set(got.tolist())) == len(got)
