"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ten consecutive words of a benchmark item, or the whole of a shorter item. Patterns of one
length form one search: a table holds, for each block of two words, how far the search may move on before a pattern
could end there; where that is nothing, the bucket of the block's hash, split by the pattern's first block, selects the
patterns to compare, and direct comparison confirms each occurrence.

Null and empty texts have no words. Items without words have no pattern; items that share a window, or have the same id,
are all reported, an id once. Documents are read whole, however long; repeated rows are each reported, with equal results;
an empty benchmark finds nothing, an empty table gives no rows. Columns besides those named, whatever their names, are
kept by ``search`` and ``decontaminate`` and ignored by ``contamination``.

The benchmark is cut into blocks of ``MOST_WINDOWS`` windows, an item of more into several with the windows between them.
The tables of each block are built once and written to the shared folder. A task holds those of one block: with one block
a worker reads them once; with more, it reads one block after another for each ``_HELD`` bytes of texts, so documents are
gone through once whatever the benchmark's size.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import LOWER, release, shared_dir, shared_files, slices, utf8

WINDOW = 10
#: Windows that one task holds as patterns at a time, about 40 bytes each, and the benchmark's distinct words.
MOST_WINDOWS = 1_000_000
_ODD, _MASK = 0x9E3779B97F4A7C15 >> 34 | 1, (1 << 32) - 1
#: Bytes of texts that a task holds as words while it reads one block after another.
_HELD = 16 << 20
#: Lower-cases A-Z and turns every byte that isn't a digit, a letter or beyond ASCII into a space.
_FOLD = bytes(LOWER[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _spread(*places):
    """One number of many bits for a block's words, or for two blocks' words; of plain numbers as of arrays."""
    out = 0
    for p in places:
        out = ((out ^ p) * _ODD) & _MASK
        out ^= out >> 15
    return out


class Search:
    """Occurrences of patterns of one length, given as places in a stream of word numbers.

    The tables take about 40 bytes a pattern: one byte for each of at least eight slots of shifts, as many marks of the
    buckets that aren't empty, and of each pattern its bucket, place and item, sorted by bucket.
    """

    def __init__(self, stream: np.ndarray, starts: np.ndarray, items: np.ndarray, length: int):
        self.m, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.slots = (1 << max(10, (8 * len(starts) - 1).bit_length())) - 1
        words = [stream[starts + i].astype(np.int64) for i in range(length)]
        shift = np.full(self.slots + 1, min(self.default, 255), np.uint8)
        for end in range(self.block, length + 1):  # nearer the end, smaller: what is written last stays
            shift[_spread(*words[end - self.block : end]) & self.slots] = min(length - end, 255)
        bucket = _spread(*words[-self.block :], *words[: self.block])
        content = _spread(*words[::-1]) << 32 | _spread(*words)  # of equal bucket and content, nearly always equal words
        order = np.lexsort((items, content, bucket))
        bucket, content, starts, items = (x[order] for x in (bucket, content, starts, items))
        new = np.ones(len(order), bool)
        same = (bucket[1:] == bucket[:-1]) & (content[1:] == content[:-1])
        for i in range(length):
            same &= stream[starts[1:] + i] == stream[starts[:-1] + i]
        new[1:] = ~same
        kept = new.copy()
        kept[1:] |= items[1:] != items[:-1]
        self.bucket, self.start, self.item = bucket[new], starts[new].astype(np.int32), items[kept].astype(np.int32)
        #: Where each pattern's items begin in ``item``.
        self.first = np.append(np.flatnonzero(new[kept]), kept.sum()).astype(np.int32)
        filled = np.zeros(self.slots + 1, np.uint8)
        filled[bucket & self.slots] = 1
        self.shift, self.filled = shift.tobytes(), filled.tobytes()

    def find(self, text: list[int | None], stream: np.ndarray, found: set[int]) -> list[tuple[int, int]]:
        """Word ranges of the occurrences; adds their items to ``found``. Words of no pattern are None."""
        m, b, shift, filled, slots, default = self.m, self.block, self.shift, self.filled, self.slots, self.default
        ranges, end, n = [], m, len(text)
        while end <= n:
            if (last := text[end - 1]) is None:
                end += m  # no pattern holds this word
                continue
            if b == 2:
                if (before := text[end - 2]) is None:
                    end += default
                    continue
                key = ((((before * _ODD) & _MASK) ^ (((before * _ODD) & _MASK) >> 15)) ^ last) * _ODD & _MASK
            else:
                key = (last * _ODD) & _MASK
            key ^= key >> 15
            if step := shift[key & slots]:
                end += step
                continue
            start = end - m
            first = text[start : start + b]
            if None not in first:
                for p in first:
                    key = ((key ^ p) * _ODD) & _MASK
                    key ^= key >> 15
                if filled[key & slots]:
                    self._compare(key, start, text, stream, ranges, found)
            end += 1
        return ranges

    def _compare(self, key: int, start: int, text: list, stream: np.ndarray, ranges: list, found: set[int]) -> None:
        a, z = np.searchsorted(self.bucket, [key, key + 1])
        if a < z and None not in (own := text[start : start + self.m]):
            same = (stream[self.start[a:z, None] + np.arange(self.m)] == own).all(1)
            for i in (np.flatnonzero(same) + a).tolist():
                found.update(self.item[self.first[i] : self.first[i + 1]].tolist())
                ranges.append((start, start + self.m))


class Patterns:
    """All windows of benchmark items, one search for each length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.place: dict[bytes, int] = {}
        place, streams, by, size = self.place, [], {}, 0
        for name, text in items:
            w = words(text)
            if not w:
                continue
            streams.append(np.fromiter((place.setdefault(x, len(place)) for x in w), np.int32, len(w)))
            length = min(window, len(w))
            starts = np.arange(size, size + len(w) - length + 1)
            by.setdefault(length, []).append((starts, np.full(len(starts), number[name])))
            size += len(w)
        self.stream = np.concatenate([np.zeros(0, np.int32), *streams])
        self.searches = [Search(self.stream, *map(np.concatenate, zip(*parts)), length) for length, parts in sorted(by.items())]

    def find(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges that are hit, and the items found."""
        found: set[int] = set()
        numbers = list(map(self.place.get, text))
        ranges = [r for s in self.searches for r in s.find(numbers, self.stream, found)]
        return merge(ranges), {self.names[i] for i in found}


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS = [
    T.StructField("_n_words", T.LongType()),
    T.StructField("_ranges", T.ArrayType(T.LongType())),
    T.StructField("_items", T.ArrayType(T.StringType())),
]


def blocks(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most: int = MOST_WINDOWS):
    """Lists of (id, text) of about ``most`` windows, read from the table one after another."""
    named = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    held: list[tuple[str, bytes]] = []
    size = 0
    for r in named.toLocalIterator():
        w = words(r["text"].encode())
        for i in range(0, max(min(len(w), 1), len(w) - window + 1), most):
            part = w[i : i + most + window - 1]
            if size and size + len(part) > most + window - 1:
                yield held
                held, size = [], 0
            held.append((r["id"], b" ".join(part)))
            size += len(part)
    yield held


_tables: dict[str, Patterns] = {}


def _tabled(path: str) -> Patterns:
    """Tables of a block; a worker keeps those that it read last."""
    if path not in _tables:
        _tables.clear()
        system, own = shared_files(path)
        with system.open_input_stream(own) as f:
            _tables[path] = pickle.loads(f.read())
    return _tables[path]


def written(benchmark: DataFrame, item_id: str, item_text: str, window: int, most: int) -> list[str]:
    """Paths in the shared folder of the tables of each block."""
    folder = f"{shared_dir(benchmark.sparkSession)}/patterns-{uuid.uuid4().hex}"
    system, own = shared_files(folder)
    system.create_dir(own)
    paths = []
    for block in blocks(benchmark, item_id, item_text, window, most):
        with system.open_output_stream(f"{own}/{len(paths)}") as f:
            f.write(pickle.dumps(Patterns(block, window), pickle.HIGHEST_PROTOCOL))
        paths.append(f"{folder}/{len(paths)}")
    return paths


def _search(docs: DataFrame, text: str, paths: list[str]) -> DataFrame:
    """Adds the columns of ``_HITS``; ``_ranges`` holds starts and ends by turns."""
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *_HITS])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, 1 << 20 if len(paths) == 1 else _HELD):
                texts = [words(t) for t in utf8(batch.column(place))]
                ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
                items: list[set[str]] = [set() for _ in texts]
                for path in paths:
                    patterns = _tabled(path)
                    for w, r, i in zip(texts, ranges, items):
                        found, names = patterns.find(w)
                        r += found
                        i |= names
                hits = [pa.array(map(len, texts), pa.int64()), pa.array([[x for r in merge(rs) for x in r] for rs in ranges], pa.list_(pa.int64())), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *hits], schema.names)
        release()

    return docs.mapInArrow(run, schema)


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most: int = MOST_WINDOWS) -> DataFrame:
    """The columns of ``docs`` and three more, after them: words, places of hits (starts and ends by turns), and items found.

    They are named ``n_words``, ``ranges`` and ``items``, with underscores after that where ``docs`` has such a column.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]  # names of the caller can't clash with ours
    found = _search(docs.toDF(*own), own[docs.columns.index(text)], written(benchmark, item_id, item_text, window, most))
    names = [*docs.columns]
    for name in ("n_words", "ranges", "items"):
        while name in names:
            name += "_"
        names.append(name)
    return found.toDF(*names)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside occurrences), n_items, items_sha256 and contaminated."""
    found = search(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, **how)
    hit = F.aggregate("ranges", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("sign")), lambda s, x: F.struct((s["n"] + s["sign"] * x).alias("n"), (-s["sign"]).alias("sign")), lambda s: s["n"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents in which no benchmark window occurs, with their columns as they were."""
    found = search(docs, benchmark, text=text, **how)
    own = [f"c{i}" for i in range(len(docs.columns))]
    return found.toDF(*own, "n_words", "ranges", "items").where(F.size("ranges") == 0).select(*own).toDF(*docs.columns)


SQL = """
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
pattern AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p FROM item, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM pattern),
place AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p FROM doc, sizes, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m),
met AS (SELECT place.doc_id, place.i, place.m, pattern.item_id FROM place JOIN pattern USING (m, p)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM met, unnest(range(i, i + m)) AS t(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
