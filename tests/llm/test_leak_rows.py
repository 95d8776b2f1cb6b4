"""Rows that repeat an id or have none, clashing columns, long texts, and the cosine cut against a search of every window."""

import numpy as np
from pyspark.sql import functions as F
from tessera.llm import decontamination as D


def test_rows_match_for_themselves(spark, make, words):
    items = [(1, words(30, 1)), (2, words(25, 2)), (2, words(25, 2)), (None, words(28, 3))]
    rows = [(500, words(60, 10) + " " + items[0][1])] * 2 + [(None, items[0][1] + " " + words(40, 11)), (None, words(9, 12) + " " + items[1][1]), (7, items[3][1])]
    rows += [(i, words(80, 100 + i)) for i in range(50)] + [(8, words(150_000, 13) + " " + items[0][1])]
    docs = make(rows).withColumn("fit_key", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("item", F.lit(0))
    got = sorted(((r.doc_id, r.item_id) for r in D.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == sorted([(500, 1), (500, 1), (None, 1), (None, 2), (None, 2), (7, None), (8, 1)], key=str)


def test_against_every_window(make, words, monkeypatch):
    """Whatever the checks accept in any window is found behind the cosine cut."""
    texts, items = [], [(i, words(12 + i, 700 + i), None) for i in range(30)]
    for i in range(120):
        own = words(100, 9000 + i).split()
        if i % 2:
            leak = items[i % 30][1].split()
            for k in range(0, len(leak) - 6, 3 + i % 4):
                leak[k] = "other"
            own[i % 90 : i % 90] = leak
        texts.append(" ".join(own))
    projection = D.project(make(list(enumerate(texts))))
    held = D.benchmark_items(items, projection)
    raw = [t.encode() for t in texts]
    words_, h = D._words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = D.matches(words_, h, held, projection)
    monkeypatch.setattr(D, "COSINE", -2.0)
    full = D.matches(words_, h, held, projection)
    assert set(got) <= set(full) and len(full) > 40 and len(got) >= 0.95 * len(full)
    one = {(t, i): v for t in range(len(raw)) for (_, i), v in D.matches(*D._words(np.frombuffer(raw[t], np.uint8), np.array([0, len(raw[t])])), held, projection).items()}
    assert one == full  # whatever lies beside a text in its slice
