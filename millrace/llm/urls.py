"""URL filter by rules and a Bloom filter cascade, in DataFrame functions only.

The longest rule that fits a url decides. Else its host's suffixes (``a.b.c``, ``b.c``, ``c``) are looked up in a list of
blocked domains. The list is a cascade of Bloom filters: the first encodes the listed keys; the second those other keys
of the corpus that pass the first; the third those listed keys that pass the second, and so on, until no key passes
wrongly. As the cascade is built over the complete key universe (every suffix of every host in the corpus, and the list),
membership is exact, and needs no join. Each row is decided by itself, so a host that holds a third of all pages is no
matter; distinct hosts are pre-aggregated.

Levels travel in the plan, so their size must not follow the corpus. The first gives each listed key enough bits that
about as many other keys pass it as are listed, however many there are; from then on a level lets a tenth pass. So a
cascade has about 1.44 log2(others / listed) + 6 bits for each listed key, which is below 64 for any corpus. A list of
more than ``MOST_KEYS`` is dealt by hash to several cascades of that size at most, and a key is listed if any holds it.

A null url, or one without ``://``, has an empty host and path: no rule fits and it is allowed. Repeated rows get equal
results; so do very long urls, which are read whole. An empty list blocks nothing, an empty table gives no rows. Null keys
of the list are left out. Columns besides those named are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise

#: (rule, verdict): a host, then a path that starts with a slash.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Blocked domains of the query.
LISTED = tuple(f"{name}.example.{zone}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for zone in ("com", "net", "org"))
#: Listed keys of a cascade at most.
MOST_KEYS = 1 << 17
#: Share of keys that pass a level after the first wrongly.
PASS = 0.1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(name: Column) -> Column:
    """``a.b.c``, ``b.c`` and ``c`` of ``a.b.c``; none of an empty name."""
    labels = F.split(name, r"\.")
    each = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(each)


def rule_of(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none fits."""
    which = verdict = F
    for rule, decision in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + rest)
        which, verdict = which.when(fits, F.lit(rule)), verdict.when(fits, F.lit(decision))
    return (which, verdict) if rules else (F.lit(None).cast("string"),) * 2


class Level:
    """A Bloom filter as a column of 64-bit words, of a size that lets about ``share`` of other keys pass."""

    def __init__(self, keys: DataFrame, count: int, share: float, salt: int):
        self.salt = salt
        self.hashes = max(1, round(-math.log2(share)))
        self.words = max(1, math.ceil(count * -math.log2(share) / math.log(2) / 64))
        self.bits = self.words * 64
        place = keys.select(F.explode(self.places(F.col("key"))).alias("at"))
        word = place.select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
        filled = word.groupBy("word").agg(F.bit_or("bit").alias("bits"))
        zero = keys.sparkSession.range(self.words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        full = filled.unionByName(zero).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        joined = full.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"].cast("string")), ","))
        self.text = joined.first()[0]

    def places(self, key: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(self.hashes)), lambda j: F.pmod(F.xxhash64(key, F.lit(self.salt), j), F.lit(self.bits)))

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(self.text), ",").cast("array<bigint>")  # folded to a constant when the plan is optimised
        return F.forall(self.places(key), lambda at: F.getbit(F.element_at(words, (F.floor(at / 64) + 1).cast("int")), (at % 64).cast("int")) == 1)


class Cascade:
    """Exact membership of keys of ``universe``: rows (key, listed)."""

    def __init__(self, universe: DataFrame):
        encoded, other = universe.where("listed"), universe.where(~F.col("listed"))
        counts = [encoded.count(), other.count()]
        self.levels: list[Level] = []
        while counts[0]:
            share = PASS if self.levels else min(PASS, counts[0] / max(1, counts[1]))
            level = Level(encoded, counts[0], share, len(self.levels))
            self.levels.append(level)
            encoded, other = other.where(level.holds(F.col("key"))), encoded
            counts = [encoded.count(), counts[0]]

    def holds(self, key: Column) -> Column:
        """The first level that a key fails decides: after an odd one it isn't listed, after an even one it is."""
        found = F.lit(len(self.levels) % 2 == 1)
        for n, level in reversed([*enumerate(self.levels)]):
            found = F.when(~level.holds(key), F.lit(n % 2 == 1)).otherwise(found)
        return found


def cascades(universe: DataFrame, listed: int, most: int = MOST_KEYS) -> list[Cascade]:
    """Cascades that together hold the listed keys; each part of the list is told apart from all other keys."""
    parts = max(1, -(-listed // most))
    part = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts))
    return [Cascade(universe.withColumn("listed", F.col("listed") & (part == k)) if parts > 1 else universe) for k in range(parts)]


def listing(spark: SparkSession, domains) -> DataFrame:
    """A DataFrame (key) of a Python list of domains."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, domains))).alias("key")) if domains else spark.range(0).select(F.lit("").alias("key"))


def judge(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, most_keys: int = MOST_KEYS) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits) and verdict."""
    named = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    listed = listed.select(F.translate("key", _UPPER, _LOWER).alias("key")).where("key IS NOT NULL").distinct()
    corpus = named.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct().select("key", F.lit(False).alias("listed"))
    universe = corpus.unionByName(listed.select("key", F.lit(True).alias("listed"))).groupBy("key").agg(F.max("listed").alias("listed"))
    universe = materialise(universe, "universe")
    parts = cascades(universe, universe.where("listed").count(), most_keys)
    blocked = F.exists(suffixes(F.col("host")), lambda key: functools.reduce(lambda a, b: a | b, (c.holds(key) for c in parts)))
    rule, decision = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(decision, F.when(blocked, "block").otherwise("allow"))
    return named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def sql(domains=LISTED, rules=RULES) -> str:
    listed = ", ".join(f"('{d}')" for d in domains)
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[k]}'" for r in sorted(rules, key=lambda r: -len(r[0]))) + " END"
    return f"""
WITH listed(name) AS (VALUES {listed}),
split AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {case(0)} AS rule,
  coalesce({case(1)}, CASE WHEN EXISTS (SELECT 1 FROM listed WHERE host = name OR ends_with(host, '.' || name)) THEN 'block' ELSE 'allow' END) AS verdict
FROM split
"""
