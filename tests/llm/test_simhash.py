import random

import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash


def brute(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    out = ["", None, "one", "one two", "A b C", "a B c", "x" * 5000, " \t\n"]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        out.append(" ".join(base))
        out += [out[-1]] * rng.randint(0, 2)
        if rng.random() < 0.7:
            base[rng.randrange(len(base))] = "changed"
            out.append(" ".join(base))
    return out


def test_components_match_brute_force(spark):
    rows = list(enumerate(texts()))
    prints = {i: brute(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == find(r.doc_id)


def test_links_cover_two_bits_at_any_place(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 3, base ^ (1 << 63) ^ 1, base ^ 7, base ^ 7 ^ (1 << 40)]
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "doc_id long, _fp long, _row long")
    found = simhash.components_of(df).select("component_id").distinct().collect()
    assert [r.component_id for r in found] == [0]


def test_long_chain_is_one_component(spark):
    chain = [0]
    for k in range(20):
        chain.append(chain[-1] ^ (0b11 << 2 * k))
    df = spark.createDataFrame([(i + 5, p, i) for i, p in enumerate(chain)], "doc_id long, _fp long, _row long")
    assert {r.component_id for r in simhash.components_of(df).collect()} == {5}


def test_deduplicate_keeps_columns_and_one_of_each(spark):
    rows = [(3, "a b c d", 1), (1, "a b c d", 2), (None, "a b c d", 3), (2, "q r s t u", 4), (2, "q r s t u", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _fp int")
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d", 2), (2, "q r s t u", 4)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(df).count() == 0 and simhash.deduplicate(df).count() == 0
