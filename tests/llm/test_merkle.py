import hashlib
import random

from pyspark.sql import functions as F

from millrace.llm import merkle


def fixture():
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("ab é\n\n😀 ") + rng.choice("cd ") for _ in range(n))
    return [(i * 3 - 20, make(rng.randint(0, 300))) for i in range(700)]


def edited(a, b):
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def test_edits_follow_ascending_ids(spark):
    rows = fixture() + [(5000, None), (6000, "")]
    order = sorted((i, t or "") for i, t in rows)
    follows = {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    got = {r.doc_id: r for r in merkle.compare_edits(spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, key string")).collect()}
    assert len(got) == len(rows)
    for i, t in order:
        r = got[i]
        e = edited(t, follows[i])
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint == r.edited_fingerprint) == (e == t) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.changed_paragraph is None) == (e == t)
        if e != t:
            k = next(k for k, (x, y) in enumerate(zip(t.split("\n") + [None], e.split("\n") + [None])) if x != y)
            assert (r.changed_paragraph, r.changed_section) == (k, k // merkle.SECTION)


def test_fingerprints_are_equal_for_equal_texts_only(spark):
    texts = ["a b c d e", "a b c d e", "a b c d  e", " a b c d e", "a b c d e ", "a b c d e\n", "", " ", "  ", "\n", "A b c d e"]
    df = merkle.fingerprinted(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "own")
    prints = {r.i: r.f for r in df.select("i", merkle.fingerprint("own").alias("f")).collect()}
    assert all((prints[i] == prints[j]) == (texts[i] == texts[j]) for i in prints for j in prints)


def test_likeness_follows_shared_text(spark):
    rng = random.Random(3)
    words = [f"w{rng.random()}" for _ in range(2000)]
    a, b = " ".join(words), " ".join(words[:1000] + [w + "x" for w in words[1000:]])
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    r = merkle.compare_edits(df).orderBy("doc_id").first()
    assert abs(r.near_next - 0.5) < 0.2
    same = merkle.compare_edits(spark.createDataFrame([(1, a), (2, a)], "doc_id long, text string")).first()
    assert same.near_next == 1.0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "x y"), (1, "a b c d"), (2, "q r s t"), (None, "n n"), (None, "n n")], "doc_id long, text string")
    rows = merkle.compare_edits(df).collect()
    assert len(rows) == 5 and sum(r.doc_id is None for r in rows) == 2
    sha = {(r.doc_id, r.n_chars): r.edited_sha256 for r in rows}
    assert sha[None, 3] == hashlib.sha256(b"n a").hexdigest()  # the next document is 1, whose first text is "a b c d"
    assert sha[2, 7] == hashlib.sha256(b"q r n n").hexdigest()


def test_neighbours_need_no_single_task(spark):
    got = {r.key: r.next_key for r in merkle.neighbours(spark.range(0, 9000, 3).select(F.col("id").alias("key"))).collect()}
    assert got == {k: (k + 3) % 9000 for k in range(0, 9000, 3)}


def test_empty_table(spark):
    assert merkle.compare_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
