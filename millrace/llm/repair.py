"""Token-id files compressed by Re-Pair grammars, written in document order and read back.

Documents are dealt by ranges of their ids, encoded, and written as shards of about ``SHARD_IDS`` ids, one grammar each:
rounds replace the frequent pairs of neighbouring symbols (``LEAST_COUNT`` in the shard) by nonterminals, until no pair is
frequent. A pair never crosses a document's end, so a document's symbols can be found and expanded by themselves, with
the stored expansion lengths. All documents of the table are written; a shard's file name holds its task and number, so a
task that runs again after a lost executor writes the same file again, and files are renamed into place when whole.

Null and empty texts have the end id only. Documents go in ascending doc_id order, nulls first; rows of equal id follow
each other in the order of their texts' hash and are each kept. A text longer than a shard makes a shard of its own.
Columns besides those named are ignored, whatever their names. An empty table writes no file.

File format (little endian): ``RPR1``; u32 counts of documents, rules and symbols, and the first nonterminal; u64 ids;
u32 task and shard number; rules as u32 pairs; u32 expansion length of each rule; per document i64 id, u8 whether the id
is null, u32 ids and u32 symbols; then symbols of three bytes each.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import materialise, shared_dir, slices

END = 2
SHARD_IDS = 2_000_000
#: Bytes of text encoded at a time.
SLICE = 16 << 20
#: Occurrences of a frequent pair in a shard at least.
LEAST_COUNT = 24
#: Units remembered by a worker; at the bound the memory starts anew.
REMEMBER = 1_500_000
_MAGIC, _HEAD = b"RPR1", struct.Struct("<4s4IQ2I")


class Encoder:
    """Ids of texts by units between ASCII white space; repeated units are looked up in arrays.

    That is right for a tokenizer that takes each run of letters, each number and each run of other signs for itself and
    drops white space, as its file must say; texts go to any other tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.splits, self.lowers = splits(parts), lowers(parts)
        suffix = parts["model"].get("end_of_word_suffix")
        #: Whether an id ends a word, if the vocabulary says so.
        self.ends = np.zeros(self.library.get_vocab_size() if suffix else 0, bool)
        if suffix:
            self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.flat, self.bounds = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _code(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def code(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, and how many each has; words of letters go in one text, as each ends with the id that ends a word."""
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for start in range(0, len(units), 1000):
            some = units[start : start + 1000]
            if len(self.ends) and all(map(str.isalpha, some)):
                ids, _ = self._code([" ".join(some)])
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) != len(some):
                    ids, n = self._code(some)
                else:
                    n = np.diff(np.r_[0, ends])
            else:
                ids, n = self._code(some)
            flat.append(ids)
            lengths.append(n)
        return np.concatenate(flat), np.concatenate(lengths)

    def look_up(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known units one after another, and how many each has."""
        starts, n = self.bounds[place], (self.bounds[1:] - self.bounds[:-1])[place]
        ends = np.cumsum(n)
        at = np.repeat((starts - ends + n).astype(np.int32), n)  # of one batch's ids and the remembered ones
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], n

    def add(self, units: pa.Array, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, units])
        self.flat = np.concatenate([self.flat, flat])
        self.bounds = np.r_[self.bounds, self.bounds[-1] + np.cumsum(lengths)]

    def learn(self, units: pa.Array) -> np.ndarray:
        """Adds units that aren't known yet; their places."""
        # letters and the mark after them are never one token, so such a unit is its word and the mark
        marked, plain = [], []
        for u in units.to_pylist():
            word = u[:-1]
            (marked if u[-1:] in (",", ".") and word.isalpha() and word.lower().isalpha() else plain).append(u)
        parts = pa.array([*{x for u in marked for x in (u[:-1], u[-1])}], pa.string())
        place = dict(zip(parts.to_pylist(), pc.index_in(parts, value_set=self.words).to_pylist()))
        plain = [*dict.fromkeys([*plain, *(x for x, at in place.items() if at is None)])]
        plain.sort(key=str.isalpha, reverse=True)
        place.update(zip(plain, itertools.count(len(self.words))))
        self.add(pa.array(plain, pa.string()), *self.code(plain))
        if marked:
            flat, n = self.look_up(np.fromiter((place[x] for u in marked for x in (u[:-1], u[-1])), np.int64, 2 * len(marked)))
            place.update(zip(marked, itertools.count(len(self.words))))
            self.add(pa.array(marked, pa.string()), flat, n[::2] + n[1::2])
        return np.fromiter(map(place.__getitem__, units.to_pylist()), np.int64, len(units))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has.

        A tokenizer that lower-cases gets A-Z lowered first, which makes fewer units; not where a special token's
        spelling could appear by that.
        """
        if not self.splits:
            return self._code(texts.to_pylist())
        if self.lowers:
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        each = pc.ascii_split_whitespace(texts)
        coded = each.flatten().dictionary_encode()
        if len(self.words) + len(coded.dictionary) > REMEMBER:
            self.forget()
        found = pc.index_in(coded.dictionary, value_set=self.words)
        unknown = found.is_null()
        place = found.fill_null(0).to_numpy().astype(np.int64)
        if found.null_count:
            place[unknown.to_numpy(zero_copy_only=False)] = self.learn(coded.dictionary.filter(unknown))
        ids, n = self.look_up(place[coded.indices.to_numpy()])
        return ids, np.diff(np.r_[0, np.cumsum(n)][each.offsets.to_numpy()])


#: Patterns of which none takes letters and other signs, or white space, in one.
_SAFE = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+"}


def splits(parts: dict) -> bool:
    """Whether a tokenizer file says that letters, numbers and other signs are taken apart and white space is dropped."""
    before = parts.get("pre_tokenizer") or {}
    first, *others = before.get("pretokenizers") or [before]
    apart = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and {*first["pattern"].get("Regex", "").split("|")} <= _SAFE
    whole = parts.get("normalizer") or {}
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} for n in whole.get("normalizers") or ([whole] if whole else []))
    return bool(apart) and plain and all(o.get("type") == "ByteLevel" and not o.get("use_regex") and not o.get("add_prefix_space") for o in others)


def lowers(parts: dict) -> bool:
    whole = parts.get("normalizer") or {}
    return any(n["type"] == "Lowercase" for n in whole.get("normalizers") or ([whole] if whole else []))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def compress(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, symbols of each document, rules (pairs) and the first nonterminal of documents of the given lengths.

    A round replaces all frequent pairs, of overlapping ones every other, the leftmost first. The rounds after it look at
    pairs that wait and at those beside a new symbol; when none of them is frequent, all pairs are looked at once more.
    """
    symbols = ids.astype(np.uint32)
    first = int(symbols.max(initial=0)) + 1
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(lengths) - 1] = True
    numbers: dict[tuple[int, int], int] = {}
    at = None  # places whose pair, with the symbol after, may be frequent; none given: all
    while len(symbols) > 1 and first + len(numbers) < 1 << 23:
        kind, shift = (np.uint32, 16) if first + len(numbers) < 1 << 16 else (np.uint64, 24)
        none = np.iinfo(kind).max  # no pair, as no symbol is so large
        key = (symbols[:-1] if at is None else symbols[at]).astype(kind)
        key <<= shift
        key |= symbols[1:] if at is None else symbols[at + 1]
        if at is None:
            key[last[:-1]] = none
        pairs = np.sort(key)
        starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[starts, len(pairs)])
        often = np.flatnonzero((counts >= LEAST_COUNT) & (pairs[starts] != none))
        if not len(often):
            if at is None:
                break
            at = None
            continue
        often = often[np.argsort(counts[often], kind="stable")]
        pairs = pairs[starts[often]]
        table = np.full(1 << _SLOTS, -1, np.int16 if len(pairs) < 1 << 15 else np.int32)
        table[_slot(pairs)] = np.arange(len(pairs))  # of two in a slot the more frequent stays, the other waits for a look at all
        which = table[_slot(key)]
        found = pairs[which] == key
        at, which = np.flatnonzero(found) if at is None else at[found], which[found]
        # leftmost first: within a run of overlapping pairs, every other one
        run = np.r_[True, np.diff(at) != 1]
        order = np.arange(len(at), dtype=np.int32)
        order -= np.maximum.accumulate(np.where(run, order, np.int32(0)))
        chosen, rest = np.flatnonzero((order & 1) == 0), np.flatnonzero(order & 1)
        waiting, at, which = at[rest], at[chosen], which[chosen]
        number = np.zeros(len(pairs), np.uint32)
        used = np.flatnonzero(np.bincount(which, minlength=len(pairs)))
        for w, a, b in zip(used.tolist(), (pairs[used] >> shift).tolist(), (pairs[used] & ((1 << shift) - 1)).tolist()):
            number[w] = numbers.setdefault((a, b), first + len(numbers))
        symbols[at] = number[which]
        last[at] |= last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        look = np.zeros(len(symbols), bool)
        look[waiting] = look[at] = look[at - (at > 0)] = True
        # the symbol before a new one is two places back where that was the end of a pair itself
        back = at[(at > 1) & ~keep[at - 1]] - 2
        look[back] = True
        kept = np.flatnonzero(keep)
        symbols, last, look = symbols[kept], last[kept], look[kept]
        at = np.flatnonzero(look & ~last)
    ends = np.flatnonzero(last) + 1
    return symbols.astype(np.int64), np.diff(np.r_[0, ends]), np.array([*numbers], np.int64).reshape(-1, 2), first


_SLOTS = 20


def _slot(key: np.ndarray) -> np.ndarray:
    """A multiplicative hash of pairs."""
    if key.dtype == np.uint32:
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOTS)
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)


def _expansions(rules: np.ndarray, first: int) -> list[bytes]:
    """What each rule stands for, as little-endian unsigned 32-bit integers."""
    out: list[bytes] = []
    for a, b in rules.tolist():
        left = out[a - first] if a >= first else a.to_bytes(4, "little")
        out.append(left + (out[b - first] if b >= first else b.to_bytes(4, "little")))
    return out


def pack(doc_ids: list[int | None], flat: np.ndarray, lengths: np.ndarray, task: int, shard: int) -> bytes:
    symbols, per, rules, first = compress(flat, lengths)
    sizes = np.array([len(x) // 4 for x in _expansions(rules, first)], np.int64)
    head = _HEAD.pack(_MAGIC, len(lengths), len(rules), len(symbols), first, len(flat), task, shard)
    return b"".join([
        head, rules.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        lengths.astype("<u4").tobytes(), per.astype("<u4").tobytes(),
        np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes(),
    ])


class Shard:
    """A file's content; ``document(i)`` decodes one document without the others."""

    def __init__(self, raw: bytes):
        magic, docs, rules, symbols, first, self.ids, self.task, self.shard = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", rules * 2).reshape(-1, 2).astype(np.int64)
        sizes = take("<u4", rules).astype(np.int64)
        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, null)]
        self.lengths = take("<u4", docs).astype(np.int64)
        self.offsets = np.r_[0, np.cumsum(take("<u4", docs).astype(np.int64))]
        packed = np.zeros((symbols, 4), np.uint8)
        packed[:, :3] = take("u1", symbols * 3).reshape(-1, 3)
        self.symbols = packed.view("<u4").ravel().astype(np.int64)
        parts = _expansions(self.rules, first)
        self.sizes = np.r_[np.ones(first, np.int64), sizes]
        self.starts = np.r_[np.arange(first), first + np.r_[0, np.cumsum(sizes)[:-1]]] if rules else np.arange(first)
        self.flat = np.concatenate([np.arange(first, dtype="<u4"), np.frombuffer(b"".join(parts), "<u4")])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.sizes[symbols]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[symbols] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.offsets[i] : self.offsets[i + 1]])

    def documents(self):
        """Id and ids of every document, decoded a million symbols at a time at most, or one document."""
        i = 0
        while i < len(self.doc_ids):
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + 1_000_000, "right")) - 1)
            some = self.expand(self.symbols[self.offsets[i] : self.offsets[j]])
            at = 0
            for k in range(i, j):
                yield self.doc_ids[k], some[at : at + self.lengths[k]]
                at += self.lengths[k]
            i = j


def _files(folder: str):
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write(docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Write all documents to a new folder that executors share; returns the written manifest (task, shard, docs, ids, bytes)."""
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = named.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    schema = "task int, shard int, docs long, ids long, bytes long"

    def run(batches):
        from pyspark import TaskContext

        task, shard = TaskContext.get().partitionId(), 0
        code = encoder(tokenizer)
        system, path = _files(folder)
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[int] = []
        size = 0

        def flush():
            raw = pack(doc_ids, np.concatenate(held), np.array(lengths, np.int64), task, shard)
            name = f"{path}/{task:07d}-{shard:06d}.rpr"
            beside = f"{path}/_{uuid.uuid4().hex}"
            with system.open_output_stream(beside) as out:
                out.write(raw)
            system.move(beside, name)
            return pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "shard": pa.array([shard], pa.int32()), "docs": [len(lengths)], "ids": [size], "bytes": [len(raw)]})

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids, counts = code.encode(batch.column(1))
                bounds = np.cumsum(counts + 1)
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end))
                start = 0  # of what isn't held yet
                for i, (d, n) in enumerate(zip(batch.column(0).to_pylist(), (counts + 1).tolist())):
                    if size and size + n > SHARD_IDS:
                        held.append(ids[start : bounds[i] - n])
                        start = bounds[i] - n
                        yield flush()
                        doc_ids, held, lengths, size, shard = [], [], [], 0, shard + 1
                    doc_ids.append(d)
                    lengths.append(n)
                    size += n
                held.append(ids[start:])
        if lengths:
            yield flush()

    system, path = _files(folder)
    system.create_dir(path, recursive=True)
    return materialise(dealt.mapInArrow(run, schema), "manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """Ids before each shard (task, shard, first): sums within a task after the sums of the tasks before it."""
    per_task = manifest.groupBy("task").agg(F.sum("ids").alias("n"))
    before = per_task.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))
    inner = F.sum("ids").over(Window.partitionBy("task").orderBy("shard")) - F.col("ids")
    return manifest.withColumn("inner", inner).join(before, "task").select("task", "shard", (F.col("base") + F.col("inner")).alias("first"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of all files: task, shard, doc_id, at (ids before it in its shard), n_tokens and ids_crc32, from decoded ids."""
    schema = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("shard", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("doc_id", "at", "n_tokens", "ids_crc32"))])

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                shard = Shard(raw.as_py())
                rows, at = [], 0
                for d, ids in shard.documents():
                    rows.append((shard.task, shard.shard, d, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.int64()] * 4))], schema.names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.rpr").load(folder).select("content").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write, read back, and report per document: doc_id, start, n_tokens and ids_crc32."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write(docs, tokenizer, folder, doc_id, text)
    found = read(spark, folder).join(starts(manifest), ["task", "shard"])
    return found.select(F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
