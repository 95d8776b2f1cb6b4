"""The decoder against all paths, trigrams whatever the cut of the table, and marks at the ends of words."""

import itertools
import random

import numpy as np
from tessera.llm import toxicity as T
from tessera.llm.common import Words


def many(texts):
    raw = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def cost(parts, logp):
    """Log score of one choice for each unit of a lattice, and the text."""
    x = y = 0
    s = 0.0
    for text, c in parts:
        s -= c
        if text == " ":
            s += logp[x, y, 0] if (x, y) != (0, 0) else 0.0
            x = y = 0
        for ch in text if text != " " else "":
            z = T._code(ch)
            s += logp[x, y, z]
            x, y = y, z
    return s + (logp[x, y, 0] if (x, y) != (0, 0) else 0.0)


def test_viterbi_finds_the_best_path():
    rng = random.Random(1)
    for seed in range(40):
        logp = np.log(np.random.default_rng(seed).dirichlet(np.ones(32), (32, 32)))
        token = "".join(rng.choice("abto01$@.*!tt") for _ in range(rng.randrange(1, 8)))
        units = T.lattice(token)
        best = max(itertools.product(*units), key=lambda parts: cost(parts, logp), default=())
        got = T.viterbi(token, logp)
        reached = [p for p in itertools.product(*units) if "".join(t for t, _ in p) == got]
        assert abs(max(cost(p, logp) for p in reached) - cost(best, logp)) < 1e-9, token


def test_trigrams_stay_within_texts():
    texts = ["abc", "", "é…ß", "a", "xyz “quoted” words — dash", "ab", "cd", "中文字"]
    w = many(texts)
    alone = sum((T.trigrams(*(lambda v: (v.buf, v.offsets))(many([t]))) for t in texts), np.zeros(1 << 15, np.int64))
    assert np.array_equal(T.trigrams(w.buf, w.offsets), alone)
    one = T.trigrams(*(lambda v: (v.buf, v.offsets))(many(["éab"])))
    assert one.sum() == 1 and one[(27 << 10) + (1 << 5) + 2] == 1  # a letter of two bytes is one character


def test_marks_at_the_ends():
    w = many(["“word” word… «word» ¡word! —word— word!!!!!!!! (word) 'été' 「word」 … ---"])
    starts, ends = T.cores(w)
    assert [w.buf[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["word"] * 7 + ["été", "word", "", ""]


def test_mixture_and_scores():
    kinds = T.mixture(np.array([1.0, 0, 12, 4, 1]), np.array([9.0, 10, 0, 0, 0]), np.array([500.0, 4000, 20, 10, 40]))
    sure = kinds.sure(np.array([12.0, 4, 1, 3, 0]), np.array([1.0, 0, 0, 30, 9]))
    assert sure[0] > 0.99 and sure[1] > 0.5 and sure[2] == 0 and sure[3] < 0.01 and sure[4] == 0
    model = T.Model(np.sort(many(["nitwit"]).hashes()), np.array([0.99]), np.array([0.2]), np.array([1e-6]), 0.1, base=T.BASE, names=["nitwit"])
    short, long, none = model.score(many(["a nitwit", "a nitwit " + "b " * 400_000, "a b"]))
    assert short > 0.9 > 0.5 > long > none - 1e-9 and abs(none - T.BASE) < 1e-9  # in a long text a word is likelier there by chance
