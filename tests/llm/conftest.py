import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, body int"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (id, text) pairs, with extra columns whose names clash with inner ones."""

    def build(rows, parts=3):
        return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), "x", 1) for i, t in rows], SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def words():
    """Texts of invented words."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def text(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(n))

    return text


ODD = [(901, None), (902, ""), (903, " \t\n "), (904, "one"), (905, "one two"), (906, "one two"), (907, "é ü ß 中文 🙂"), (None, "a row without id"), (908, "tie tie tie tie tie tie")]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
