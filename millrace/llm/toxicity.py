"""Toxicity of texts behind leetspeak, spacing and repetition, read through a noisy channel.

A character language model (trigrams, counted over every text) and a channel say how a word could have been written:
letters as look-alike digits and signs, letters apart, letters repeated. Tokens that look altered become a lattice of
readings; Viterbi decoding, over all of its states, finds the most likely one. The restored words are scored by a logistic regression over words
and word beginnings, fitted in numpy on a bounded sample of labelled rows (``MOST_TOXIC`` and ``MOST_CLEAN``, taken in
the order of a hash of the id); its features are those whose document frequency differs significantly with the label.

Null and empty texts have no words and get the score of the intercept. Labels that are null are skipped; repeated
labels of an id count once, as toxic if any is; of a labelled id with several texts the one of least hash is learned from. Without labels of both kinds every score is the smoothed share of toxic
ones. Equal texts, and so repeated rows, get equal scores. Texts are scored whole, however long; an empty table gives no
rows. Columns besides those named, whatever their names, are ignored by ``scores`` and kept by ``drop_toxic``. Labels name
their rows by a column of the same name as the documents' id.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import materialise, release, slices

#: Labelled rows of each kind that the regression is fitted on, at most.
MOST_TOXIC, MOST_CLEAN = 4000, 8000
#: Words remembered by a worker; at the bound the memory starts anew.
REMEMBER = 100_000
#: Least documents and standard deviations of a feature, strength of the penalty.
LEAST_DOCS, LEAST_Z, RIDGE = 8, 4.0, 0.004
#: Word beginnings that are features, besides the word itself.
BEGINNINGS = (4, 5)

# Letters that each sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
# Letters of other alphabets that look like Latin ones.
ALIKE = dict(zip("асеһіјкмнорѕтухвαονρτυ", "acehijkmhopstyxbaovptu"))
#: Letters that a mask may stand for.
MASKS, MASKED = "*#", "aeiou"
SEPARATORS = " .-_*~/\\,'·"

SYMBOLS = 64
_EDGE, _OTHER, _DIGIT, _SIGN = 0, 59, 60, 61
_BEYOND = 0x180


def _codes() -> np.ndarray:
    """Symbol of each code point up to ``_BEYOND``: edge, a to z, letters from 0xDF to 0xFF, other letters, digits, signs."""
    out = np.zeros(_BEYOND + 1, np.int64)
    for p in range(_BEYOND + 1):
        c = chr(p).lower()[0]
        if "a" <= c <= "z":
            out[p] = ord(c) - 96
        elif c.isalpha():
            out[p] = 27 + ord(c) - 0xDF if 0xDF <= ord(c) <= 0xFE else _OTHER
        elif c.isdigit():
            out[p] = _DIGIT
        elif c in SIGNS or c in MASKS:
            out[p] = _SIGN
    out[_BEYOND] = _OTHER
    return out


CODES = _codes()


def encode(text: str) -> np.ndarray:
    return CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), _BEYOND)]


def trigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts (code, n) of symbol trigrams over all texts; at most 64 cubed rows."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                c = encode("  ".join(["", *(t for t in batch.column(0).to_pylist() if t), ""]))
                if len(c) > 2:
                    total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["code", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Channel:
    """Reads altered tokens by the most likely path through their lattice."""

    def __init__(self, counts: np.ndarray):
        n3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        n2 = n3.sum(0)
        bigram = (n2 + 0.5) / (n2 + 0.5).sum(1, keepdims=True)
        self.log = np.log((n3 + bigram[None]) / (n3.sum(2, keepdims=True) + 1)).tolist()
        self.known: dict[str, tuple[str, ...]] = {}

    def options(self, text: str) -> list[list[tuple[str, float]]]:
        """Readings of each character, with costs: letters it may stand for, a space, or nothing."""
        out = []
        for i, c in enumerate(text):
            before = text[i - 1] if i else ""
            if c in SIGNS:
                o = [(x, 0.3) for x in SIGNS[c]]
            elif c in ALIKE:
                o = [(ALIKE[c], 0.3), (c, 1.0)]
            elif c in MASKS and 0 < i < len(text) - 1 and text[i + 1].isalpha() and before.isalpha():
                o = [(x, 1.0) for x in MASKED] + [("", 1.0)]
            elif c.isalpha():
                o = [(c, 0.0)]
            elif c == " ":
                o = [("", 0.0), (" ", 2.0)]
            else:
                o = [("", 0.2), (" ", 1.0)]
            if c == before and c != " " and text[max(0, i - 2) : i + 2].count(c) > 2:
                o = [*o, ("", 0.3)]
            out.append(o)
        return out

    def decode(self, text: str) -> str:
        """The likeliest reading: words apart by spaces."""
        log = self.log
        best = {(_EDGE, _EDGE): (0.0, "")}  # of all paths that end in two symbols, which is what the trigrams see
        for options in [*self.options(text), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, read) in best.items():
                for letter, cost in options:
                    if letter:
                        c = int(CODES[min(ord(letter), _BEYOND)])
                        s, key, now = score + log[a][b][c] - cost, (b, c), read + letter
                    else:
                        s, key, now = score - cost, (a, b), read
                    if key not in new or s > new[key][0]:
                        new[key] = (s, now)
            best = new
        return max(best.values())[1].strip()

    def words(self, token: str) -> tuple[str, ...]:
        """Restored words of a lower-case token without white space."""
        if (found := self.known.get(token)) is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            found = self.known[token] = self._words(token)
        return found

    def _words(self, token: str) -> tuple[str, ...]:
        if token.isalpha() and not _REPEATED.search(token):
            return (token,) if token.isascii() or not (_ALIKE.search(token) and _LATIN.search(token)) else (self.decode(token),)
        token = _ENDS.sub("", token).strip(_PUNCTUATION)
        token = token.rstrip("!")
        parts = [p for p in _BETWEEN.split(token) if p]
        if len(parts) >= 3 and sum(len(p) == 1 for p in parts) * 2 > len(parts):
            return tuple(self.decode(token).split())
        out: list[str] = []
        for p in re.split(r"[.\-_~/\\,'·:;]+", token):
            letters = sum(map(str.isalpha, p))
            if letters == len(p) and not _REPEATED.search(p):
                out += [p] if p else []
            elif letters >= 2 and letters * 3 >= len(p) or letters and any(c in SIGNS for c in p) or len(p) > 2 and any(c in SIGNS and not c.isdigit() for c in p):
                out += self.decode(p).split()
        return tuple(out)

    def spaced(self, text: str) -> list[str]:
        """Restored words of runs of single characters."""
        return [w for m in _SPACED.finditer(text) for w in self.decode(" ".join(m[0].split())).split()]


_ALIKE = re.compile("[" + "".join(ALIKE) + "]")
_LATIN = re.compile("[a-z]")
_REPEATED = re.compile(r"(.)\1\1")
_ENDS = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")
_BETWEEN = re.compile("[" + re.escape(SEPARATORS) + "]+")
_PUNCTUATION = ".,;:?\"'()[]{}<>…«»„“”‘’`´=&%^~"
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?:\s+(?:[^\W_]|[@$!|+])){2,}(?!\S)")


def features(channel: Channel, text: str | None) -> set[str]:
    """Words and beginnings of the restored text."""
    text = (text or "").lower()
    tokens = set(text.split())
    found: set[str] = set()
    words = channel.words
    for t in tokens:
        found.update(words(t))
    if sum(len(t) == 1 for t in tokens) > 1:
        found.update(channel.spaced(text))
    return {x for w in found for x in (w, *(f"{w[:k]}~" for k in BEGINNINGS if len(w) > k))}


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def sample(labels: DataFrame, doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """A bounded sample (doc_id, toxic) of the labels that may be learned from."""
    usable = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & (remainder(F.col(doc_id)) != 0))
    usable = usable.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    order = F.xxhash64(F.col("doc_id"))
    parts = [usable.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(most) for k, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    return parts[0].unionByName(parts[1])


class Model:
    def __init__(self, counts: np.ndarray, weights: dict[str, float], intercept: float):
        self.counts, self.weights, self.intercept = counts, weights, intercept

    def scorer(self):
        channel, weights, words = Channel(self.counts), self.weights, {}

        def active(token: str) -> tuple[str, ...]:
            return tuple(x for w in channel.words(token) for x in (w, *(f"{w[:k]}~" for k in BEGINNINGS if len(w) > k)) if x in weights)

        def score(text: str | None) -> float:
            text = (text or "").lower()
            tokens = set(text.split())
            found: set[str] = set()
            single = 0
            for t in tokens:
                if (a := words.get(t)) is None:
                    if len(words) >= REMEMBER:
                        words.clear()
                        channel.known.clear()
                    a = words[t] = active(t)
                if a:
                    found.update(a)
                if len(t) == 1:
                    single += 1
            if single > 1:
                for w in channel.spaced(text):
                    found.update(active(w))
            x = self.intercept + math.fsum(weights[f] for f in found)
            return 1 / (1 + math.exp(-x)) if x > -700 else 0.0

        return score


def regression(rows: list[list[int]], labels: np.ndarray, size: int, ridge: float = RIDGE, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic regression on sets of features, by accelerated gradient descent."""
    index = np.fromiter(itertools.chain.from_iterable(rows), np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(size), 0.0
    v, vb = w.copy(), b
    most = max(1, np.bincount(owner, minlength=1).max(initial=1))
    per = np.bincount(index, minlength=size) if len(index) else np.zeros(size)
    rate = 1 / (0.25 * per * most + ridge + 1e-9)
    rate_b = 1 / (0.25 * len(rows) * 4)
    for k in range(1, steps + 1):
        x = vb + np.bincount(owner, v[index], len(rows)) if len(index) else np.full(len(rows), vb)
        error = 1 / (1 + np.exp(-np.clip(x, -50, 50))) - labels
        old, old_b = w, b
        w = v - rate * (np.bincount(index, error[owner], size) + ridge * v) if len(index) else v
        b = vb - rate_b * error.sum()
        pace = (k - 1) / (k + 2)
        v, vb = w + pace * (w - old), b + pace * (b - old_b)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = np.zeros(SYMBOLS**3, np.int64)
    for code, n in trigrams(named).collect():
        counts[code] = n
    chosen = sample(labels, doc_id)
    # of an id's texts the one of least hash, so that what is learned doesn't depend on the order of tasks
    own = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("own")
    taken = materialise(named.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(own).select("doc_id", "own.text", "toxic"), "labelled")
    shared = spark.sparkContext.broadcast(counts)

    def spread(batches):
        channel = Channel(shared.value)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = [sorted(features(channel, t)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.list_(pa.string()))], ["doc_id", "toxic", "features"])

    id_type = named.schema["doc_id"].dataType.simpleString()
    sets = materialise(taken.repartition(32).mapInArrow(spread, f"doc_id {id_type}, toxic int, features array<string>"), "features")
    sizes = dict(sets.groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(counts, {}, math.log((toxic + 0.5) / (clean + 0.5)))
    per = sets.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    share = (F.col("a") + F.col("b")) / (toxic + clean)
    z = F.abs(F.col("a") / toxic - F.col("b") / clean) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean) + 1e-12)
    picked = [r[0] for r in per.where(F.col("a") + F.col("b") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").select("feature").collect()]
    place = {f: i for i, f in enumerate(picked)}
    known = spark.sparkContext.broadcast(place)

    def active(batches):
        for batch in batches:
            rows = [[known.value[f] for f in fs if f in known.value] for fs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "features"])

    rows = sets.orderBy("doc_id").select("toxic", "features").mapInArrow(active, "toxic int, features array<int>").toPandas()
    weights, intercept = regression([list(r) for r in rows["features"]], rows["toxic"].to_numpy(np.float64), len(picked))
    return Model(counts, {f: float(w) for f, w in zip(picked, weights) if w}, intercept)


def _scored(docs: DataFrame, text: str, model: Model) -> DataFrame:
    """All columns, named by place, and ``_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())])

    def run(batches):
        score = shared.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([score(t) for t in batch.column(place).to_pylist()], pa.float64())], schema.names)
        del score
        release()

    return docs.mapInArrow(run, schema)


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on)."""
    scored = _scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", fit(docs, labels, doc_id, text))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with a score below 0.5, with their columns as they were."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    scored = _scored(docs.toDF(*own), own[docs.columns.index(text)], fit(docs, labels, doc_id, text))
    return scored.where(F.col("_score") < 0.5).select(*own).toDF(*docs.columns)
