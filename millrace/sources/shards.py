"""Raw files of token ids: read by ranges of bytes, cut into documents, and listed.

A stream of ids is one file or several parts one after another, as ``sink`` writes them. ``files`` is a list of streams, each
a pair (path, size in bytes) or a list of such pairs; ``path_idx`` is a stream's place in it.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from millrace.operators.documents import boundaries, end_places, fragments, pair_places
from millrace.operators.sampling import read_ranges
from millrace.operators.sums import sorted_sums

#: Ids of a range.
CHUNK = 1 << 20


def file_system(path: str):
    """The Arrow file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Stream:
    """Ids of parts one after another, of which any range can be read; no part is read whole for it."""

    def __init__(self, parts: list, kind: np.dtype):
        self.kind, self.parts, at = kind, [], 0
        for path, size in parts:
            self.parts.append((path, at, size // kind.itemsize))
            at += size // kind.itemsize
        self.items = at

    def path_at(self, place: int) -> str:
        return next(path for path, base, n in self.parts if base <= place < base + n)

    def read(self, start: int, end: int) -> np.ndarray:
        found = [np.zeros(0, self.kind)]
        for path, base, n in self.parts:
            low, high = max(start, base), min(end, base + n)
            if low < high:
                system, place = file_system(path)
                with system.open_input_file(place) as f:
                    found.append(np.frombuffer(f.read_at((high - low) * self.kind.itemsize, (low - base) * self.kind.itemsize), self.kind))
        return np.concatenate(found) if len(found) > 2 else found[-1]


def _streams(files: str, width: str) -> list[Stream]:
    kind = np.dtype(f"<{width}") if width != "bool" else np.dtype(bool)
    return [Stream(f if f and isinstance(f[0], list) else [f] if f else [], kind) for f in json.loads(files)]


class _Pruned(DataSourceReader):
    """Ranges of streams that comparisons of ``path_idx`` and of the range's start leave; Spark applies the filters again."""

    start = "chunk_start"

    def __init__(self, options):
        self.chunk, self.task = int(options.get("chunk", CHUNK)), int(options.get("task", 0))
        self.streams = _streams(options["files"], options["width"])
        self.bounds: dict[str, list] = {"path_idx": [0, len(self.streams) - 1], self.start: [0, max((s.items for s in self.streams), default=0)]}
        self.chosen: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.bounds:
                low, high = self.bounds[name]
                match f:
                    case EqualTo() | EqualNullSafe() if f.value is not None:
                        self.bounds[name] = [max(low, f.value), min(high, f.value)]
                    case GreaterThan():
                        self.bounds[name] = [max(low, f.value + 1), high]
                    case GreaterThanOrEqual():
                        self.bounds[name] = [max(low, f.value), high]
                    case LessThan():
                        self.bounds[name] = [low, min(high, f.value - 1)]
                    case LessThanOrEqual():
                        self.bounds[name] = [low, min(high, f.value)]
                    case In():
                        self.chosen[name] = self.chosen.get(name, set(f.value)) & set(f.value)
            yield f

    def meets(self, k: int, start: int, end: int) -> bool:
        """Whether a range can hold rows that the filters leave."""
        low, high = self.bounds["path_idx"]
        return low <= k <= high and k in self.chosen.get("path_idx", {k}) and self.bounds[self.start][0] < end and start <= self.bounds[self.start][1]

    def partitions(self):
        whole = ((k, start, min(start + self.chunk, s.items)) for k, s in enumerate(self.streams) for start in range(0, s.items, self.chunk))
        found = [x for x in whole if self.meets(*x)]
        each = max(1, self.task // self.chunk)
        return [InputPartition(found[i : i + each]) for i in range(0, len(found), each)]

    def read(self, partition):
        for part in partition.value if partition else ():  # there is none if no range is left
            yield from self.read_range(*part)


class TokenRanges(DataSource):
    """Headerless arrays of ids, read by ranges of bytes: rows (path_idx, path, chunk_start, ids, follows).

    Options: ``files`` (JSON), ``width``, ``chunk`` (ids a row), ``task`` (ids a task: it reads so many ranges one after
    another, else one). Of a range one id more is read, ``follows``, which is
    null at a stream's end. Filters on ``path_idx`` and ``chunk_start`` choose the ranges that are read at all.
    """

    @classmethod
    def name(cls) -> str:
        return "tokens"

    def schema(self) -> str:
        return "path_idx int, path string, chunk_start long, ids array<bigint>, follows bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Ranges(self.options)


class _Ranges(_Pruned):
    def meets(self, k: int, start: int, end: int) -> bool:
        low, high = self.bounds["chunk_start"]
        return super().meets(k, start, end) and low <= start <= high and start in self.chosen.get("chunk_start", {start})

    def read_range(self, k: int, start: int, end: int):
        stream = self.streams[k]
        ids = stream.read(start, end + 1).astype(np.int64)
        after = int(ids[end - start]) if len(ids) > end - start else None
        values = pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), pa.array(ids[: end - start]))
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([stream.path_at(start)]), pa.array([start], pa.int64()), values, pa.array([after], pa.int64())], ["path_idx", "path", "chunk_start", "ids", "follows"])


class TokenDocuments(DataSource):
    """Documents of streams of ids: rows (path_idx, start, end, ids, mask), each made by the task in whose range it starts.

    A range is read on past its end until its last document ends, so documents need no shuffle, however ranges cut them.
    Options as above, and ``masks`` (files of a byte an id), ``end``, ``begin``, ``close``, ``most`` and ``strategy``.
    """

    @classmethod
    def name(cls) -> str:
        return "token_documents"

    def schema(self) -> str:
        return "path_idx int, start long, end long, ids array<bigint>, mask array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        return _Documents(self.options)


class _Documents(_Pruned):
    start = "start"

    def __init__(self, options):
        super().__init__(options)
        self.masks = _streams(options["masks"], "bool") if "masks" in options else None
        if self.masks is not None and [s.items for s in self.masks] != [s.items for s in self.streams]:
            raise ValueError("masks and ids differ in length")
        self.end, self.begin = int(options["end"]), int(options["begin"]) if "begin" in options else None
        self.close, self.most, self.strategy = options.get("close") == "true", int(options.get("most", 0)), options.get("strategy", "truncate")

    def ends(self, ids: np.ndarray, base: int, total: int) -> np.ndarray:
        """Places after the ids that end a document; with a begin token the id after the last must be known, or be none."""
        at = np.flatnonzero(ids == self.end) + 1
        if self.begin is not None:
            after = np.append(ids, self.begin if base + len(ids) == total else -1)[at]
            at = at[(after == self.begin) & ((at < len(ids)) | (base + len(ids) == total))]
        return base + at

    def read_range(self, k: int, low: int, high: int):
        stream = self.streams[k]
        more = self.begin is not None  # one id more than is looked at
        base = max(low - 1, 0)
        ids = stream.read(base, high + more)
        ends = self.ends(ids, base, stream.items)
        ends = ends[ends <= high]
        starts = ends[(ends >= low) & (ends < high)]
        if low == 0:
            starts = np.append(0, starts)
        if not len(starts):
            return
        pieces, at = [ids], base + len(ids)
        after, looked = ends[ends > starts[-1]], high
        while not len(after) and looked < stream.items:  # the last document goes on
            step = min(looked + self.chunk, stream.items)
            block = stream.read(looked, step + more)
            after = self.ends(block, looked, stream.items)
            after = after[(after > starts[-1]) & (after <= step)][:1]
            pieces.append(block[at - looked :])
            at, looked = looked + len(block), step
        tail = int(after[0]) if len(after) else stream.items if self.close else None
        stops = np.append(starts[1:], tail if tail is not None else starts[-1])
        some = stops > starts
        starts, stops = starts[some], stops[some]
        if self.most and self.strategy == "truncate":
            stops = np.minimum(stops, starts + self.most)
        elif self.most:
            counts = -(-(stops - starts) // self.most)
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            last = np.repeat(stops, counts)
            starts = np.repeat(starts, counts) + inner * self.most
            stops = np.minimum(last, starts + self.most)
        if not len(starts):
            return
        ids = np.concatenate(pieces)
        first, last = int(starts[0]), int(stops[-1])
        columns = [ids[first - base : last - base].astype(np.int64)]
        if self.masks is not None:
            columns.append(self.masks[k].read(first, last).astype(np.int64))
        if (starts[1:] != stops[:-1]).any():  # cut ones leave gaps
            inside = np.zeros(last - first + 1, np.int64)
            np.add.at(inside, starts - first, 1)
            np.add.at(inside, stops - first, -1)
            columns = [c[np.cumsum(inside)[:-1] > 0] for c in columns]
        bounds = pa.array(np.append(0, np.cumsum(stops - starts)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(c)) for c in columns]
        mask = lists[1] if len(lists) > 1 else pa.nulls(len(starts), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), k, np.int32)), pa.array(starts), pa.array(stops), lists[0], mask], ["path_idx", "start", "end", "ids", "mask"])


def _read(spark: SparkSession, source: type[DataSource], options: dict) -> DataFrame:
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(source.name()).options(**{k: v for k, v in options.items() if v is not None}).load()


def listed(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int]]:
    """Files of paths, patterns and folders in the order of their names, with their sizes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length")
    return sorted((r["path"], r["length"]) for r in files.collect())  # a row a file


def by_folder(files: list[tuple[str, int]]) -> list[tuple[str, list[tuple[str, int]]]]:
    """Streams (folder's name, its parts in order) of files, in the order of the names."""
    found: dict[str, list[tuple[str, int]]] = {}
    for path, size in sorted(files):
        found.setdefault(path.rsplit("/", 2)[1], []).append((path, size))
    return sorted(found.items())


def permuted(files: list, seed: int) -> list:
    """Files in an order that a seed gives, the same for the same files."""
    return sorted(files, key=lambda f: hashlib.sha256(f"{seed}:{f[0]}".encode()).digest())


def permuted_rows(files: DataFrame, path: str, seed: int) -> DataFrame:
    """Adds ``place`` (from 0), the same order for any number of files."""
    return sorted_sums(files.withColumns({"_key": F.sha2(F.concat_ws(":", F.lit(str(seed)), path), 256), "_one": F.lit(1).cast("long")}), [], ["_key", path], {"place": "_one"}).withColumn("place", F.col("place") - 1).drop("_key", "_one")


def token_ranges(spark: SparkSession, files: list, width: str, chunk: int = CHUNK, task: int | None = None) -> DataFrame:
    """Rows (path_idx, path, chunk_start, ids, follows) of streams of ids or, with ``bool``, of masks (0 or 1).

    Only the ranges that filters on ``path_idx`` and ``chunk_start`` leave are read, each by a task or as many as hold ``task`` ids.
    """
    return _read(spark, TokenRanges, {"files": json.dumps(files), "width": width, "chunk": chunk, "task": task})


def token_slices(spark: SparkSession, files: list, width: str, start: int, end: int, chunk: int = CHUNK) -> DataFrame:
    """Rows (path_idx, at, ids) of the ids [start, end) of every stream, ``at`` being a row's place; only ranges that meet them are read."""
    first = F.lit(max(start, 0) // chunk * chunk)
    rows = token_ranges(spark, files, width, chunk).where((F.col("chunk_start") >= first) & (F.col("chunk_start") < max(end, 0)))
    low, high = F.greatest("chunk_start", F.lit(start)), F.least(F.col("chunk_start") + F.size("ids"), F.lit(end))
    return rows.where(low < high).select("path_idx", low.alias("at"), F.slice("ids", (low - F.col("chunk_start") + 1).cast("int"), (high - low).cast("int")).alias("ids"))


def token_slice(spark: SparkSession, path: str, size: int, width: str, start: int, end: int) -> DataFrame:
    """One row (ids) with the ids [start, end) of a file; only the ranges that hold them are read."""
    cut = token_slices(spark, [(path, size)], width, start, end, max(1, end - start))
    return cut.agg(F.flatten(F.array_sort(F.collect_list(F.struct("at", "ids")))["ids"]).alias("ids"))  # the slice is one row


def token_documents(spark: SparkSession, files: list, width: str, end: int, begin: int | None = None, close: bool = True, most: int | None = None, strategy: str = "truncate", masks: list | None = None, chunk: int = CHUNK, task: int | None = None) -> DataFrame:
    """Documents (path_idx, start, end, n, ids, mask) of streams of ids, with label masks (0 or 1) if files of them are given.

    Ends are those tokens, or with ``begin`` those that a begin token follows; with ``close`` a stream's tail is a document.
    Longer documents are cut to ``most``, or split. Nothing is shuffled: each document is made where it starts.
    """
    options = {"files": json.dumps(files), "width": width, "chunk": chunk, "task": task, "end": end, "begin": begin, "close": str(close).lower(), "most": most, "strategy": strategy, "masks": masks and json.dumps(masks)}
    return _read(spark, TokenDocuments, options).withColumn("n", F.col("end") - F.col("start"))


def range_instances(ranges: DataFrame, size: int) -> DataFrame:
    """Instances (path_idx, instance, input_ids) of so many ids of each stream; what is left at its end is dropped.

    Ranges must begin at multiples of ``size``, so that no instance lies in two, and nothing is shuffled.
    """
    start = F.col("chunk_start")
    checked = F.when(start % size == 0, F.floor(start / size)).otherwise(F.raise_error(F.lit("ranges cut instances")).cast("long"))
    cut = ranges.where(F.size("ids") >= size).select("path_idx", checked.alias("_first"), "ids", F.explode(F.sequence(F.lit(0), F.floor(F.size("ids") / size).cast("int") - 1)).alias("_k"))
    return cut.select("path_idx", (F.col("_first") + F.col("_k")).alias("instance"), F.slice("ids", F.col("_k") * size + 1, size).alias("input_ids"))


def token_counts(spark: SparkSession, paths: str | list[str], width: str) -> DataFrame:
    """Rows (path, tokens) from file sizes alone."""
    size = np.dtype(f"<{width}").itemsize
    return spark.read.format("binaryFile").load(paths).select("path", F.expr(f"length div {size}").alias("tokens"))


def source_counts(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """Files and tokens of each source; ``sources`` has rows (source, path), and a path that isn't there is an error."""
    met = sources.join(counts, "path", "left")
    tokens = F.coalesce("tokens", F.raise_error(F.concat(F.lit("no such file: "), "path")).cast("long"))
    return met.groupBy("source").agg(F.count("*").alias("files"), F.sum(tokens).alias("tokens"))


def grouped_files(files: list[tuple[str, int]], each: int) -> list[tuple[str, int, int]]:
    """Files (path, size, group), so many in a group."""
    return [(path, size, k // each) for k, (path, size) in enumerate(files)]


def stream_documents(ranges: DataFrame, end: int, begin: int | None = None, close: bool = True, most: int | None = None, strategy: str = "truncate", mask: DataFrame | None = None) -> DataFrame:
    """Documents (path_idx, start, end, n, ids) of raw files, found range by range, with label masks (0 or 1) if given.

    Ends are those tokens, or with ``begin`` those that a begin token follows; with ``close`` a file's tail is a document.
    Longer documents are cut to ``most``, or split.
    """
    places = end_places(F.col("ids"), F.col("chunk_start"), end) if begin is None else pair_places(F.col("ids"), F.col("chunk_start"), F.col("follows"), end, begin)
    ends = ranges.select("path_idx", F.explode(places).alias("end"))
    totals = ranges.groupBy("path_idx").agg(F.max(F.col("chunk_start") + F.size("ids")).alias("tokens")) if close else None
    found = boundaries(ends, ["path_idx"], totals)
    found = fragments(found, most, strategy) if most else found
    tokens = ranges.select("path_idx", F.col("chunk_start").alias("start"), (F.col("chunk_start") + F.size("ids")).alias("end"), "ids")

    def gathered(streams: DataFrame) -> DataFrame:
        pieces = read_ranges(found, streams, ["path_idx"], grid=CHUNK)
        return pieces.groupBy("path_idx", "start", "end").agg(F.flatten(F.array_sort(F.collect_list(F.struct("at", "ids")))["ids"]).alias("ids"))

    docs = gathered(tokens).withColumn("n", F.col("end") - F.col("start"))
    if mask is not None:
        marks = gathered(mask.select("path_idx", F.col("chunk_start").alias("start"), (F.col("chunk_start") + F.size("ids")).alias("end"), "ids")).withColumnRenamed("ids", "mask")
        docs = docs.join(marks, ["path_idx", "start", "end"], "left")
    return docs


def checked_bounds(bounds: DataFrame, totals: DataFrame, by: str = "path_idx") -> DataFrame:
    """Bounds of documents of a sidecar; one beyond the tokens of its file is an error."""
    met = bounds.join(totals.select(by, "tokens"), by)
    wrong = F.raise_error(F.concat_ws(" ", F.lit("document beyond the file:"), F.col("start").cast("string"), F.col("end").cast("string"))).cast("long")
    inside = (F.col("start") < F.col("tokens")) & (F.col("end") <= F.col("tokens"))
    return met.withColumn("end", F.when(inside, F.col("end")).otherwise(wrong)).drop("tokens")


def sidecar_of(path: str) -> str | None:
    """Name of the bounds beside a file of ids; none for other names."""
    return f"{path[:-4]}.csv.gz" if path.endswith(".npy") else None


def labelled_files(manifest: DataFrame, spark: SparkSession) -> list[tuple[str, int, str]]:
    """Files of a manifest (path, size, label) in its order, patterns expanded in the order of names; one listing for all.

    A path, or pattern, that no file is there for is an error.
    """
    rows = sorted(manifest.collect(), key=lambda r: r["place"])  # a row a path of the manifest
    local = lambda p: re.sub("^file:/+", "/", p)
    files = {local(path): (path, size) for path, size in listed(spark, [r["path"] for r in rows])} if rows else {}
    found: list[tuple[str, int, str]] = []
    for r in rows:
        own = local(r["path"])
        if own in files:
            some = [own]
        else:
            fits = re.compile("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c in "[]" else re.escape(c) for c in own) + r"(?:/.*)?\Z")
            some = sorted(p for p in files if fits.match(p))
        if not some:
            raise FileNotFoundError(r["path"])
        found += [(*files[p], r["label"]) for p in some]
    return found
