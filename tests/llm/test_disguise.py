"""Disguised words between others, beyond a few marks, in long words, and large lexicons."""

import numpy as np
import pytest
from tessera.llm import toxicity
from tessera.llm.common import Words


@pytest.fixture(scope="module")
def model(spark, make, words):
    bad = ["blockhead", "nitwit", "scoundrel", "dimwit"]
    docs = [(i, words(50, 3000 + i) + (f" {bad[i // 4 % 4]} {bad[i % 3]} " if i % 4 == 0 else " a such ") + words(9, i)) for i in range(900)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in docs], "doc_id long, quality int, toxic int")
    return toxicity.fit(make(docs), labels)


def score(model, *texts):
    raw = [t.encode() for t in texts]
    return model.score(Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))


def test_found(model, words):
    plain = words(30, 70)
    for text in (
        "such a d i m w i t", "d i m w i t n i t w i t", "I y a o n i t w i t y", "d i m w i t t a", "nitwit!!!!!", "!!!!!!!!nitwit!!!!!!?", "n1tw1t!!!!!", "n1tw1t!", "nit!!!wit", "((((((dimwit))))))",
        ".".join(plain.split() * 4 + ["n1tw1t"] + plain.split() * 4), ".".join(plain.split() * 4 + ["nitwit"] + plain.split()), "-" * 500 + "d.i.m.w.i.t" + "-" * 500,
    ):
        assert score(model, text)[0] > 0.5, text


def test_left_alone(model, words):
    plain = words(200, 71)
    assert (score(model, plain, " ".join(plain), ".".join(plain.split()), "!" * 3000, "a b c d", "r2d2 user@mail.test 10.0.0.1", "") < 0.5).all()


def test_long_words_take_linear_time(model):
    assert score(model, "x1" * 30000)[0] < 0.5


def test_more_entries_than_512(spark, make, words):
    def name(k):
        return "".join(chr(97 + k // 26**j % 26) for j in range(3)) * 2 + "zq"

    docs = [(i, " ".join(f"{w} {name((i // 2 * 30 + j) % 600)}" if i % 2 else w for j, w in enumerate(words(30, 5000 + i).split()))) for i in range(2000)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in docs], "doc_id long, quality int, toxic int")
    assert {name(k) for k in range(600)} <= {e.word for e in toxicity.learn(make(docs), labels)[0]}
