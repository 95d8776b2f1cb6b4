import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, make, words, tmp_path_factory):
    """A small corpus with one case for each stage."""
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, words(70, i)) for i in range(400)]
    rows = [(i, " ".join(w.upper() + "!!" for w in t.split()) if i % 5 == 0 else t + " blockhead nitwit" if i % 7 == 0 else t) for i, t in rows]
    leak = words(30, 777)
    rows += [(1000, words(70, 2)), (1001, words(70, 2) + " end"), (1002, words(40, 901) + " " + leak + " " + words(40, 902)), (1003, None), (1004, "")]
    make(rows).drop("key", "body").write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 5 != 0), int(i % 7 == 0 and i % 5 != 0)) for i in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialise(stage(spark, docs, folder), "stage")
        if i < 4:
            assert out.columns == docs.columns
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
        docs = out
    assert {i for i in range(0, 400, 5)}.isdisjoint(kept[0]) and {i for i in range(400) if i % 5} <= kept[0]
    assert {i for i in range(400) if i % 7 == 0}.isdisjoint(kept[1])
    assert 2 in kept[2] and not {1000, 1001} & kept[2]
    assert 1002 in kept[2] and 1002 not in kept[3] and kept[4] == kept[3]
    assert {i for i in range(400) if i % 5 and i % 7} <= kept[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == kept[4]


def test_rows_without_id_and_repeated_rows(spark, folder, make, words):
    """Each stage judges rows, not ids; further columns go along."""
    clean, bad, loud = words(70, 5000), words(70, 5001) + " blockhead nitwit", " ".join(w.upper() + "!!" for w in words(70, 5002).split())
    leak = words(30, 777)
    more = [(None, clean), (None, clean), (3000, words(70, 5003)), (3000, words(70, 5003)), (3000, words(70, 5004)), (None, bad), (None, loud), (None, words(70, 1)), (None, leak + " " + words(50, 5005)), (None, None), (None, None), (3001, bad), (3001, clean + " x")]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    docs = make([(r.doc_id, r.text) for r in docs] + more)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), "stage")
        assert docs.columns == make([]).columns
    got = [(r.doc_id, r.text) for r in docs.where("doc_id is null or doc_id >= 3000").collect()]
    assert sorted(got, key=str) == sorted([x for x in [(3000, words(70, 5003)), (3000, words(70, 5004)), (3001, clean + " x"), *[(None, None)] * empty(docs)]], key=str)


def empty(docs):
    """Whether the classifier keeps empty documents; near copies keep all of them."""
    return docs.where("text is null and doc_id is null").count()


def test_empty_table(spark, folder, make):
    docs = make([])
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), "stage")
    assert docs.count() == 0
