import pytest
from pyspark.sql import functions as F

from millrace.llm import urls

URLS = [None, "", "no scheme", "http://", "https://Example.ORG/es/x", "https://a.example.org/en/12?q=/es/", "http://org/", "http://x.org", "http://x.org?y", "http://b.com/fr/1", "http://com/de/2#f", "http://notcom/de/", "http://m.ads-track.example.com/en/", "http://ads-track.example.com/fr/", "http://bads-track.example.com/en/", "ftp://spam-farm.example.net", "x://a..b//c", "http://A.B/p\nq", "http://spam-farm.example.net/"]


def expected(url, listed):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in urls.RULES if (host == r[0].split("/", 1)[0] or host.endswith("." + r[0].split("/", 1)[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
    if fits:
        rule, verdict = max(fits, key=lambda r: len(r[0]))
        return host, path, rule, verdict
    return host, path, None, "block" if any(host == d or host.endswith("." + d) for d in listed) else "allow"


@pytest.mark.parametrize("most", [urls.MOST_KEYS, 5])
def test_verdicts(spark, most):
    urls_ = [*URLS, *URLS, "http://ads-track.example.net/" + "long/" * 50_000, "http://" + "a." * 500 + "spam-farm.example.org"]
    rows = [(i, u, "extra") for i, u in enumerate(urls_)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.judge(pages, urls.listing(spark, urls.LISTED), most_keys=most).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == expected(rows[r.page_id][1], urls.LISTED)


@pytest.mark.parametrize("share", [0.1, 0.5])
def test_cascade_is_exact(spark, monkeypatch, share):
    monkeypatch.setattr(urls, "PASS", share)
    keys = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = urls.Cascade(keys)
    assert len(cascade.levels) > 2
    assert sum(level.bits for level in cascade.levels) < 64 * 40_000 / 7
    assert keys.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0


def test_size_follows_the_list_not_the_corpus(spark):
    sizes = []
    for n in (2_000, 200_000):
        keys = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") < 20).alias("listed"))
        cascade = urls.Cascade(keys)
        assert keys.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
        sizes.append(sum(level.bits for level in cascade.levels))
    assert sizes[1] <= 20 * 64 + 64 * len(cascade.levels)


def test_null_and_upper_case_keys(spark):
    listed = spark.createDataFrame([(None,), ("Bad.Example",)], "key string")
    pages = spark.createDataFrame([(1, "http://x.bad.example/"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in urls.judge(pages, listed).orderBy("page_id").collect()] == ["block", "allow"]


def test_empty_list_and_table(spark):
    pages = spark.createDataFrame([(1, "http://q.net/")], "page_id long, url string")
    assert urls.judge(pages, urls.listing(spark, [])).first().verdict == "allow"
    assert urls.judge(pages.limit(0), urls.listing(spark, urls.LISTED)).count() == 0
