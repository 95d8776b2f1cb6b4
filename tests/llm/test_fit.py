"""The index is fitted on every passage, whatever ids the rows have."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import decontamination as D


def test_words_of_few_documents(spark, words):
    """Twenty items whose words lie only in the documents with the greatest hashes, behind 20,480 short ones."""
    items = [(i, words(30, 60_000 + i)) for i in range(20)]
    ids = [r.id for r in spark.range(20_500).orderBy(F.xxhash64("id").desc(), "id").limit(20).collect()]
    held = spark.createDataFrame([(d, f"{words(40, 70_000 + i)} {t}") for d, (i, t) in zip(ids, items)], "id long, leak string")
    docs = spark.range(20_500).join(F.broadcast(held), "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("leak", F.lit("short text")).alias("text"))
    got = {(r.doc_id, r.item_id) for r in D.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, (i, _) in zip(ids, items)}


@pytest.mark.parametrize("key", [None, 7])
def test_rows_without_ids_of_their_own(spark, make, words, key):
    item = words(30, 1)
    docs = make([(key, words(60, 10) + " " + item), *((key, words(80, 100 + i)) for i in range(40))])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.decontaminate(docs, bench).collect()] == [(key, 1)]


def test_sketch_is_of_all_passages(make, words, odd):
    rows = [*odd, *((1000 + i, words(20 + 7 * i, 500 + i)) for i in range(60))]
    docs = make(rows)
    df, n = D.document_frequencies(docs)
    idf = np.log((n + 1) / (df + 0.5))
    a = []
    for _, text in rows:
        h = D._hash(text)
        a += [np.bincount(D._terms(h[k : k + D.PASSAGE]), minlength=D.TERMS) for k in range(0, len(h), D.PASSAGE)]
    a = np.array(a)
    assert n == len(a) and np.array_equal(df, (a > 0).sum(0))
    a = a * idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = a.T @ (a @ D.random_test_matrix().astype(float))
    assert np.allclose(D.sketch(docs, idf), z, atol=1e-4)


def test_words_without_their_marks(words, odd):
    texts = [*(t or "" for _, t in odd), "“word” word… (a) -- 'tis x! 9 a9 été! «f»", words(500, 5), "!!", "a"]
    raw = [t.lower().encode() for t in texts]
    both = D.Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    mine, plain = D._cores(both), D.cores(both)
    full = plain[1] > plain[0]
    assert np.array_equal(mine[1] > mine[0], full) and all(np.array_equal(a[full], b[full]) for a, b in zip(mine, plain))


def test_stage_of_the_pipeline(spark, words, tmp_path):
    """The pipeline's stage drops a contaminated row where hardly any row has an id."""
    leak = words(30, 80_000)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{words(40, 80_001)} {leak}"), *((None, words(70, 81_000 + i)) for i in range(30))]
    docs = spark.createDataFrame([*rows, (5, "short text")], "doc_id long, text string")
    got = corpus_pipeline.benchmark_passages(spark, docs, str(tmp_path))
    assert sorted(r.text for r in got.collect()) == sorted([t for _, t in rows[1:]] + ["short text"])
