import pathlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import toxicity

CLEAN = "the weather is fine and we walk in the garden with our friends every morning before work".split()
RUDE = ["idiot", "moron", "stupid", "scum"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(CLEAN, 30))
        if toxic := i % 5 == 0:
            words[3], words[17] = rng.choice(RUDE, 2)
        rows.append((i, " ".join(words), f"x{i}"))
        labels.append((i, int(toxic)))
    extra = [(1000, "you are an 1d10t and a m0r0n"), (1001, "such an i d i o t and s t u p i d too"), (1002, "stuuuupid $cum"), (1003, "the weather is fine"), (1004, ""), (1005, None)]
    docs = spark.createDataFrame(rows + [(i, t, "") for i, t in extra], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([*labels, (0, 1), (7, None)], "doc_id long, toxic int")


def test_scores_find_altered_words(corpus):
    rows = {r.doc_id: r for r in toxicity.scores(*corpus).collect()}
    assert len(rows) == 406
    assert all(rows[i].predicted == 1 for i in (1000, 1001, 1002)) and all(rows[i].predicted == 0 for i in (1003, 1004, 1005))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out and rows[i].predicted == (i % 5 == 0) for i in held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_drop_toxic_keeps_columns_and_clean_rows(corpus):
    docs, labels = corpus
    kept = toxicity.drop_toxic(docs.withColumn("_score", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "lang", "_score"]
    assert kept.where("doc_id < 400 AND doc_id % 5 != 0").count() == 320 and kept.where("doc_id < 400 AND doc_id % 5 = 0").count() == 0


def test_held_out_labels_are_not_read(spark, corpus):
    docs, labels = corpus
    turned = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x) for x in (labels, turned))
    assert a.weights == b.weights and a.intercept == b.intercept


@pytest.mark.parametrize("token, words", [("m0r0n", ("moron",)), ("i.d.i.o.t", ("idiot",)), ("idiooot", ("idiot",)), ("2024", ()), ("garden,", ("garden",)), ("well-known", ("well", "known")), ("fine###", ("fine",))])
def test_channel(token, words):
    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    c = toxicity.encode("  " + "  ".join((CLEAN + RUDE) * 20) + "  ")
    np.add.at(counts, (c[:-2] * 64 + c[1:-1]) * 64 + c[2:], 1)
    assert toxicity.Channel(counts).words(token) == words


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, toxicity.SYMBOLS**3)
    channel = toxicity.Channel(counts)
    for token in ("1d1", "a4$", "x1|"):
        paths = [("", 0.0)]
        for options in channel.options(token):
            paths = [(read + o, cost + c) for read, cost in paths for o, c in options]

        def score(read, cost):
            s = [0, 0, *(int(toxicity.CODES[ord(x)]) for x in read + " ")]
            return sum(channel.log[a][b][c] for a, b, c in zip(s, s[1:], s[2:])) - cost

        assert channel.decode(token) == max(paths, key=lambda p: score(*p))[0]


def test_scores_match_brute_force(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    channel = toxicity.Channel(model.counts)
    long = "fine " * 40_000 + "1d10t"
    rows = [("".join(t), i) for i, t in enumerate(["an 1d10t", "an 1d10t", "i\td  i o\nt here", "$ c u m", long, "", "the weather 1 2 3 4"])] + [(None, 99)]
    df = spark.createDataFrame(rows, "text string, doc_id long").withColumn("_score", F.lit("x"))
    scored = toxicity._scored(df.select("doc_id", "text"), "text", model)
    got = {r.doc_id: r._score for r in scored.collect()}
    for t, i in rows:
        x = model.intercept + sum(model.weights.get(f, 0.0) for f in toxicity.features(channel, t))
        assert abs(got[i] - 1 / (1 + np.exp(-x))) < 1e-9
    assert got[0] == got[1] > 0.5 and min(got[2], got[3], got[4]) > 0.5 and max(got[5], got[6], got[99]) < 0.5
    assert toxicity.drop_toxic(df, labels).columns == ["text", "doc_id", "_score"]


def test_finds_held_out_rows_of_the_test_tables(spark):
    folder = pathlib.Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.scores(docs, labels).join(labels.where("toxic IS NOT NULL"), "doc_id").where("held_out").collect()
    found = [r for r in rows if r.predicted]
    # of 97 rows labelled toxic nine hold no word that marks any other
    assert sum(r.toxic for r in found) >= 0.97 * len(found) and sum(r.toxic for r in found) >= 0.88 * sum(r.toxic for r in rows)


def test_repeated_ids_are_learned_from_the_text_of_least_hash(spark, corpus):
    docs, labels = corpus
    again = docs.where("doc_id < 50").withColumn("text", F.concat(F.lit("other words "), "text", F.lit(" moron")))
    parts = [docs.unionByName(again).repartition(7), again.repartition(3, "text").unionByName(docs)]
    models = [toxicity.fit(d, labels) for d in parts]
    assert models[0].weights == models[1].weights and models[0].intercept == models[1].intercept
    rows = [sorted(map(tuple, toxicity.scores(d, labels).collect())) for d in parts]
    assert rows[0] == rows[1] and len(rows[0]) == 456


def test_fit_matches_brute_force(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    channel, marked = toxicity.Channel(model.counts), {}
    for r in labels.collect():
        if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            marked[r.doc_id] = max(r.toxic, marked.get(r.doc_id, 0))
    sets = {r.doc_id: toxicity.features(channel, r.text) for r in docs.collect() if r.doc_id in marked}
    y = np.array([marked[i] for i in sets], float)
    names = []
    for f in sorted(set().union(*sets.values())):
        has = np.array([f in s for s in sets.values()])
        share = has.mean()
        z = abs(has[y == 1].mean() - has[y == 0].mean()) / np.sqrt(share * (1 - share) * (1 / (y == 1).sum() + 1 / (y == 0).sum()) + 1e-12)
        if has.sum() >= toxicity.LEAST_DOCS and z >= toxicity.LEAST_Z:
            names.append(f)
    x = np.array([[f in s for f in names] for s in sets.values()], float)
    assert set(model.weights) == set(names) and len(names) >= 4
    ones, w = np.c_[x, np.ones(len(x))], np.zeros(len(names) + 1)
    penalty = np.r_[np.full(len(names), toxicity.RIDGE), 1e-12]
    for _ in range(200):  # damped Newton steps to the same penalised optimum
        p = 1 / (1 + np.exp(-ones @ w))
        step = np.linalg.solve((ones * (p * (1 - p))[:, None]).T @ ones + np.diag(penalty), ones.T @ (p - y) + penalty * w)
        w -= step * min(1, 1 / np.abs(step).max())
    want = 1 / (1 + np.exp(-ones @ w))
    got = np.array([1 / (1 + np.exp(-model.intercept - sum(model.weights[f] for f in s if f in model.weights))) for s in sets.values()])
    assert np.abs(got - want).max() < 0.02


def test_other_id_columns(spark, corpus):
    docs, labels = corpus
    named = toxicity.scores(docs.withColumnRenamed("doc_id", "name"), labels.withColumnRenamed("doc_id", "name"), doc_id="name")
    assert named.where("predicted = 1").count() >= 80


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)]):
        rows = toxicity.scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(rows) == 2 and all(r.score <= 0.5 for r in rows)


def test_empty_table(spark):
    assert toxicity.scores(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
