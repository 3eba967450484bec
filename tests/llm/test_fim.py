import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import fim


def texts():
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("ab é😀\n\n\r\x85 <>") for _ in range(n))
    return ["", None, "\n", "\n\n\n", "a", "no end", "a\n", "x<P>y\nz", "x<S>", "<M>\n", "<\nP>\n>", "a<\n<S\n", "line\n" * 5000, "long line " * 3000] + [make(rng.randint(0, 200)) for _ in range(150)]


def expected(doc_id, text, rate=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in fim.MARKERS) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, **settings):
    df = spark.createDataFrame([(t, i, "own", 5) for i, t in rows], "text string, doc_id long, form string, n int")
    made = fim.transform(df, **settings)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form_"))).collect()
    assert len(got) == len(rows) and all(r.form == "own" and r.n == 5 for r in got)
    for r in got:
        assert (r.n_, r.form_, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text, **settings), r.doc_id
        assert r.back == (r.text or "")


def test_outputs_match_brute_force(spark):
    check(spark, list(enumerate(texts())) + [(3, "again\nthe same id"), (None, "no id\nat all\n"), (2**60, "x\ny\n")])
    check(spark, list(enumerate(texts())), rate=40, spm=10)


def test_texts_go_to_the_library_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 7)
    split = fim.pre_tokenizers.Split(fim.Regex(fim.LINES), "isolated")
    for t in filter(None, texts()):
        ends = [m.end() for m in re.finditer(fim.LINES, t)]
        assert list(fim.unit_ends(t[:3000], split)) == [m.end() for m in re.finditer(fim.LINES, t[:3000])], ends[:5]


def test_digests(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(t, i, 0) for i, t in rows], "text string, doc_id long, output_sha256 int")
    got = {r.doc_id: r for r in fim.digests(df).collect()}
    for i, t in rows:
        n, form, p, m, output = expected(i, t)
        want = (n, form, p, m, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n, got[i].form, got[i].prefix_chars, got[i].middle_chars, got[i].output_sha256, got[i].restored_sha256) == want
    assert fim.digests(df.limit(0)).count() == 0


def test_markers_that_overlap_are_an_error(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for markers in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.transform(df, markers=markers)
    assert fim.transform(df, markers=("[pre]", "[suf]", "[mid]")).count() == 1
