import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(0)
    vocabulary = [f"word{i}" for i in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, labels, items = [], [], [(i, make(30)) for i in range(5)]
    for i in range(200):
        t = make(60)
        if i % 10 == 3:
            t = f"{t} idiot {make(5)} moron"
            labels.append((i, 0, 1))
        else:
            labels.append((i, 1, 0))
        docs.append((i, t, "en", "s", len(t)))
    t = docs[2][1]
    docs += [(500, t, "en", "s", len(t)), (501, t, "en", "s", len(t)), (502, make(20) + " " + items[2][1], "en", "s", 9), (503, None, None, None, None), (504, make(40) + " id1ot m0ron", "en", "s", 9)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_keeps_what_is_clean(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    want = {i for i in range(200) if i % 10 != 3} | {503}
    assert sorted(r.doc_id for r in rows) == sorted(want)
    assert all(r.n_tokens == len(r.ids) for r in rows)


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.names == docs.schema.names, name
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_run_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
