import hashlib
import random
import re

from millrace.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        p = words(t)
        m = min(10, len(p))
        for k in range(len(p) - m + 1 if p else 0):
            for s in range(len(w) - m + 1):
                if w[s : s + m] == p[k : k + m]:
                    hit.update(range(s, s + m))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def fixture():
    rng = random.Random(2)
    vocabulary = ["a", "b", "Cc", "dé", "e1", "ß"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([12, 10, 25, 3, 1, 2, 9, 11, 0, 40, 10, 10])] + [(50, None), (51, "zz"), (52, items_copy := make(14)), (53, items_copy)]
    docs = [(i, make(rng.randint(0, 120))) for i in range(40)] + [(100, None), (101, ""), (102, "…—"), (103, "A-b,CC dÉ"), (104, items_copy * 1), (105, "q " + items[2][1].upper() + "! q " + items[9][1])]
    docs += [(106, "n" * 10000), (107, "zz,zz")]
    return docs, items


def check(spark, **how):
    docs, items = fixture()
    for chosen in (items, [x for x in items if len(words(x[1])) >= 9], []):
        d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, _extra string")
        b = spark.createDataFrame(chosen, "item_id long, text string")
        got = decontaminate.contamination(d, b, **how).collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(dict(docs)[r.doc_id], chosen), r


def test_matches_brute_force(spark):
    check(spark)


def test_blocks_of_patterns(spark):
    for most in (1, 7, 40):
        check(spark, most=most)


def test_blocks_are_bounded_and_whole(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500))), (2, "a b c"), (3, ""), (4, None), (5, " ".join(f"v{i}" for i in range(10)))], "item_id long, text string")
    found = list(decontaminate.blocks(items, most=50))
    windows = lambda t: {tuple(w[i : i + 10]) for w in [decontaminate.words(t)] for i in range(max(len(w) - 9, min(1, len(w))))}
    assert all(sum(len(windows(t)) for _, t in b) <= 50 for b in found)
    assert set().union(*(windows(t) for b in found for _, t in b)) == set().union(*(windows((r.text or "").encode()) for r in items.collect()))


def test_random_patterns_match_brute_force():
    rng = random.Random(8)
    for size in (2, 3, 30):
        vocabulary = [f"w{i}" for i in range(size)]
        make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
        items = [(i, make(rng.choice([1, 2, 5, 9, 10, 11, 30]))) for i in range(12)] + [(90, "w1 " * 300), (91, "w1 " * 12), (90, "w0 " * 10)]
        patterns = decontaminate.Patterns([(str(i), t.encode()) for i, t in items])
        for n in (0, 1, 2, 9, 10, 50, 200):
            text = make(n) + " other " + make(n)
            ranges, names = patterns.find(decontaminate.words(text.encode()))
            _, n_hit, n_items, *_ = brute(text, items)
            assert (sum(z - a for a, z in ranges), len(names)) == (n_hit, n_items)


def test_tables_are_compact():
    rng = random.Random(1)
    vocabulary = [b"w%d" % i for i in range(5000)]
    items = [(str(i), b" ".join(rng.choices(vocabulary, k=60))) for i in range(2000)] + [(f"copy {i}", b"one and the same passage that every one of these items has got") for i in range(5000)]
    (search,) = decontaminate.Patterns(items).searches
    assert len(search.start) == 2000 * 51 + 4 and len(search.item) == 2000 * 51 + 5000 * 4  # equal windows are one pattern
    size = sum(x.nbytes for x in (search.bucket, search.start, search.item, search.first)) + len(search.shift) + len(search.filled)
    assert size < 48 * len(search.item)


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    item = " ".join(f"word{i}" for i in range(10))
    long = "filler " * 60_000 + item
    d = spark.createDataFrame([(1, long, 5), (1, long, 5), (2, "filler", 6)], "doc_id long, text string, ranges int").withColumnRenamed("doc_id", "items")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.search(d, b)
    assert found.columns == ["items", "text", "ranges", "n_words", "ranges_", "items_"]
    assert sorted((r["items"], r["ranges"], r["n_words"], r["ranges_"], r["items_"]) for r in found.collect()) == [(1, 5, 60_010, [60_000, 60_010], ["1"])] * 2 + [(2, 6, 1, [], [])]


def test_decontaminate_keeps_clean_rows(spark):
    docs, items = fixture()
    items = [x for x in items if len(words(x[1])) >= 9]
    d = spark.createDataFrame(docs, "text_id long, text string").withColumnRenamed("text_id", "_ranges")
    kept = decontaminate.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(i for i, t in docs if not brute(t, items)[4])


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(d, b).count() == 0
