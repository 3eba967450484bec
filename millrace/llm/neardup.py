"""Near duplicates: SimHash balls first, then an exact prefix join for what their radius can't reach.

Documents are near duplicates if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Fingerprints of
the sets within two bits meet in balls (``simhash``), and those pairs that are similar enough are linked. Pairs of that
similarity differ in up to about fifteen bits, so a prefix join finds the others; it skips what is linked already.

Texts of equal shingle sets collapse to one node first. Each node's shingles are put in one global order, rare ones
first, and only the first n - ceil(0.8 n) + 1 of n are listed: two sets that are similar enough share one of those, so
no pair is missed. The order comes from a table of counts in ``SLOTS`` slots; whatever the counts, any order is exact.
Rows of shingles that no other node lists go after one shuffle.

Nodes that meet in a shingle's bucket and aren't ruled out by their sizes and places are verified on their whole sets.
One leader of each bucket is tested against everybody in it first, and leaves it. Then small buckets test the pairs that
no link connects yet; in large ones two leaders are tested, which come from components with few members there. What
remains in a large bucket is tested in blocks of ``WIDE`` rows: a task holds two blocks and compares bitmaps of the sets,
whose distance is at most the number of shingles that only one of two sets has. So a pair is a row only if its bitmaps
don't rule it out, and it is verified on whole sets like any other.

Very large buckets, where comparing bitmaps costs more than making rows, are dealt anew by a second shared shingle: sets
that are similar enough share two of the first n - ceil(0.8 n) + 2, then three, four (``DEEPEST``). A row whose further
shingles are as many as its bucket's rows is tested against the bucket instead.

Texts of fewer words have one shingle of all their words; null and empty texts have none and are equal to each other.
Repeated rows and ties keep the row of the smallest id, null ids last; columns besides those named are kept, whatever
their names; an empty table gives no rows. Texts are read whole, however long.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from millrace.llm.common import LOWER, as_int64, materialise, release, shared_dir, shared_files, small_batches, utf8
from millrace.llm.simhash import connect, links, majority
from millrace.sources.shared import remove

WORDS = 5
#: Similarity as a fraction, so that bounds are exact.
OF, PARTS = 4, 5
SLOTS, BLOCK = 1 << 22, 1 << 16
#: Buckets up to this size test all pairs after their first round.
SMALL = 16
#: Buckets are dealt by one more shingle when that makes no more rows than pairs of bitmaps to compare, times this.
PATIENCE = 1 / 500
#: Rows of a block of a large bucket, pairs of bitmap words compared at once, and most bits of a bitmap.
WIDE, WORDS_AT_ONCE, BITS = 2048, 1 << 20, 4096
#: Shingles that name a bucket at most: two sets of similarity 0.8 or more that have fewer than four in common are equal.
DEEPEST = 4
#: Level (four times the logarithm of its documents) from which on a slot's shingles are dealt to many tasks.
HOT = 52
_CACHE = 1 << 18


class Shingler:
    def __init__(self, words: int = WORDS):
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the word shingles of a text."""
        tokens = (text or b"").translate(LOWER).split()
        if len(self.known) > _CACHE:
            self.known.clear()
        for t in set(tokens):
            if t not in self.known:
                self.known[t] = xxhash.xxh64_intdigest(t)
        h = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        if not len(h):
            return h
        width = min(self.words, len(h))
        s = np.zeros(len(h) - width + 1, np.uint64)
        for i in range(width):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(s)]
            s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(s ^ (s >> np.uint64(32)))


def slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(SLOTS - 1)).astype(np.int64)


def with_nodes(docs: DataFrame, text: str, words: int) -> DataFrame:
    """All columns, a row number ``_row``, ``_node``, a digest of the shingle set, and ``_fp``, its fingerprint."""
    kept = docs.columns
    schema = StructType([*docs.schema, *(T.StructField(n, T.LongType()) for n in ("_row", "_node", "_fp"))])

    def run(batches):
        from pyspark import TaskContext

        row, cut = TaskContext.get().partitionId() << 40, Shingler(words)
        for batch in batches:
            nodes, prints = [], []
            for t in utf8(batch.column("_text")):
                s = cut(t)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
                prints.append(majority(s[i : i + BLOCK] for i in range(0, len(s), BLOCK)))
            numbers = (pa.array(as_int64(np.array(x, np.uint64))) for x in (nodes, prints))
            columns = [*(batch.column(c) for c in kept), pa.array(np.arange(row, row + batch.num_rows)), *numbers]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, [*kept, "_row", "_node", "_fp"])
        release()

    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)


def prefix(shingles: np.ndarray, level: np.ndarray, shared: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in the global order, rare ones first, of which similar sets share as many as named, and their levels."""
    own = level[slot(shingles)]
    order = np.lexsort((shingles, own))[: len(shingles) + (-OF * len(shingles)) // PARTS + shared]
    return shingles[order], own[order]


def levels(prints: DataFrame, text: str, words: int) -> np.ndarray:
    """Per slot four times the logarithm of how many documents have a shingle there."""

    def count(batches):
        n, cut = np.zeros(SLOTS, np.uint32), Shingler(words)
        for batch in batches:
            for t in utf8(batch.column(0)):
                np.add.at(n, slot(cut(t)), 1)
        for i in range(0, SLOTS, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([zlib.compress(n[i : i + BLOCK].tobytes(), 1)])], ["block", "n"])
        del n
        cut.known.clear()
        release()

    def add(found: pa.Table) -> pa.Table:
        n = np.zeros(BLOCK, np.uint64)
        for x in found.column("n"):
            n += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        return pa.table({"block": found.column("block")[:1], "level": pa.array([(4 * np.log2(n + 1)).clip(max=255).astype(np.uint8).tobytes()])})

    rows = prints.select(text).mapInArrow(count, "block int, n binary").groupBy("block").applyInArrow(add, "block int, level binary")
    with small_batches(prints.sparkSession):
        rows = rows.collect()  # SLOTS bytes in all
    out = np.zeros(SLOTS, np.uint8)
    for r in rows:
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["level"], np.uint8)
    return out


class RowLists:
    """Row numbers in the shared folder, a file for each part of the rows, so a task reads those of its own part only.

    Rows of a written table are numbered by the part that wrote them, so choosing some moves none of their texts.
    """

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        self.path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
        parts = rows.select("_row", F.shiftright("_row", 40).alias("part"))
        parts.repartition("part").sortWithinPartitions("part", "_row").write.partitionBy("part").parquet(self.path)

    def chosen(self, rows: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
        """Whether each row number is listed; ``known`` holds what a task has read."""
        system, folder = shared_files(self.path)
        out = np.zeros(len(rows), bool)
        parts = rows >> 40
        for part in np.unique(parts).tolist():
            if part not in known:
                known.clear()  # rows come part after part
                files = [f.path for f in system.get_file_info(fs.FileSelector(f"{folder}/part={part}", allow_not_found=True)) if f.path.endswith(".parquet")]
                known[part] = np.concatenate([np.zeros(0, np.int64), *(pq.read_table(f, filesystem=system, partitioning=None).column("_row").to_numpy() for f in files)])
            own = parts == part
            out[own] = np.isin(rows[own], known[part])
        return out


def postings(prints: DataFrame, shared: Broadcast, text: str, words: int) -> DataFrame:
    """Rows (token, node, n, pos) of the shingles in a node's prefix that another node's prefix has as well.

    Rows are shuffled once, by shingle, and go through tasks as a stream, so no bucket is held. Shingles whose slot is
    very frequent are dealt to many tasks and kept without a look.
    """
    names = ["token", "node", "n", "pos", "salt"]

    def run(batches):
        level, cut = np.frombuffer(shared.value, np.uint8), Shingler(words)
        seen: set[int] = set()
        for batch in batches:
            for node, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if node in seen:
                    continue
                if len(seen) >= _CACHE:
                    seen.clear()
                seen.add(node)
                s = cut(t)
                n = len(s)
                if n:
                    first, own = prefix(s, level)
                    one = np.ones(len(first), np.int64)
                    salt = np.where(own >= HOT, 1 + (node & 63), 0).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(one * node), pa.array((one * n).astype(np.int32)), pa.array(np.arange(len(first), dtype=np.int32)), pa.array(salt)], names)
        seen.clear()
        cut.known.clear()
        release()

    listed = prints.select("_node", text).mapInArrow(grouped(run), "token long, node long, n int, pos int, salt int")
    dealt = listed.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
    return dealt.mapInArrow(met_again, "token long, node long, n int, pos int")


def met_again(batches):
    """Of rows sorted by token and node: those whose token has more than one node, or is salted; a row once."""
    held, live = None, None  # the last row, if it isn't decided yet; the last token that is known to have more nodes
    for batch in batches:
        rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0] if batch.num_rows else None
        if rows is None:
            continue
        token, node, salt = (rows.column(c).to_numpy() for c in ("token", "node", "salt"))
        new_token = np.r_[True, token[1:] != token[:-1]]
        fresh = new_token | np.r_[True, node[1:] != node[:-1]]
        starts = np.flatnonzero(new_token)
        many = np.add.reduceat(fresh.astype(np.int64), starts) > 1
        many |= (salt[starts] > 0) | (token[starts] == live if live is not None else False)
        if held is None and live is not None and token[0] == live and node[0] == last:
            fresh[0] = False  # a copy of the last row, which went out with its batch
        keep = fresh & np.repeat(many, np.diff(np.r_[starts, len(token)]))
        live, last = (token[-1], node[-1]) if many[-1] else (None, None)
        held = None if many[-1] else rows.slice(len(token) - 1, 1)
        if keep.any():
            yield rows.filter(pa.array(keep)).select(["token", "node", "n", "pos"])


def grouped(run, rows: int = 50_000):
    """The same batches joined to larger ones."""

    def joined(batches):
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.num_rows
            if size >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(PARTS * both >= OF * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.join(pairs.select(F.col(c).alias("node")), "node", "left_semi").select(F.col("node").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    met = pairs.join(left, "a").join(right, "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shingle_sets(prints: DataFrame, rows: RowLists, text: str, words: int) -> DataFrame:
    """Rows (node, shingles) of the listed rows."""

    def run(batches):
        cut, known = Shingler(words), {}
        for batch in batches:
            batch = batch.filter(pa.array(rows.chosen(batch.column(0).to_numpy(), known)))
            for node, t in zip(batch.column(1).to_pylist(), utf8(batch.column(2))):
                yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([cut(t).tobytes()])], ["node", "shingles"])
        cut.known.clear()
        release()

    return prints.select("_row", "_node", text).mapInArrow(grouped(run, 200), "node long, shingles binary")


def ball_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) whose fingerprints meet in a ball, enough of them to connect all that do."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(first, "fp").where("node != first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    near = links(first.select(F.col("fp").alias("_fp")))
    ends = [first.select(F.col("fp").alias(c), F.col("first").alias(n)) for c, n in (("a", "x"), ("b", "y"))]
    pairs = same.unionByName(near.join(ends[0], "a").join(ends[1], "b").select("x", "y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def further(rows: DataFrame, sets: DataFrame, shared: Broadcast, depth: int) -> DataFrame:
    """Rows (token, node, n, pos) of buckets named by ``depth`` shingles, dealt to buckets named by one more that follows."""

    def run(batches):
        level = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for node, held, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                s = np.frombuffer(held.as_buffer(), np.uint64)
                first, _ = prefix(s, level, depth + 1)
                for row in own:
                    rest = first[row["pos"] + 1 :]
                    token = (np.uint64(row["token"] & (1 << 64) - 1) ^ rest) * np.uint64(0x9E3779B97F4A7C15)
                    token = (token ^ (token >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + rest
                    one = np.ones(len(rest), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(one * node), pa.array((one * len(s)).astype(np.int32)), pa.array(np.arange(row["pos"] + 1, len(first), dtype=np.int32))], ["token", "node", "n", "pos"])
        release()

    own = rows.groupBy("node").agg(F.collect_list(F.struct("token", "pos")).alias("own"))  # a node's own shingles
    return sets.join(own, "node").select("node", "shingles", "own").mapInArrow(grouped(run), "token long, node long, n int, pos int")


def cheaper(large: DataFrame, rest: Column) -> bool:
    """Whether dealing buckets by one more shingle costs no more than comparing all bitmaps in each."""
    costs = large.agg(F.sum(F.least(rest, "size")), F.sum("size")).first()
    return costs[0] is not None and costs[0] <= PATIENCE * costs[1]


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A set as words of bits, each the parity of its shingles there; twice as many bits as shingles at least, up to ``BITS``.

    Folding a bitmap gives that of half as many bits. Two bitmaps differ in no more bits than their sets in shingles.
    """
    bits = min(BITS, max(64, 1 << (2 * len(shingles) - 1).bit_length()))
    places = np.bincount((shingles >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((places & 1).astype(np.uint8)).view(np.uint64)


def bitmaps(sets: DataFrame) -> DataFrame:
    """Rows (node, bits) of sets (node, shingles)."""

    def run(batches):
        for batch in batches:
            found = [bitmap(np.frombuffer(x.as_buffer(), np.uint64)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "bits"])
        release()

    return sets.select("node", "shingles").mapInArrow(run, "node long, bits binary")


def near_bitmaps(rows: pa.Table, depth: int) -> pa.Table:
    """Pairs (a, b) of a block's rows, or of two blocks' rows, that have other roots and aren't ruled out; at most one of each."""
    x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
    part, node, root = (rows.column(c).to_numpy() for c in ("part", "node", "root"))
    n, pos = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "pos"))
    held = rows.column("bits").to_pylist()
    wide = np.array([len(h) // 8 for h in held])
    words = {w: np.array([np.frombuffer(h, np.uint64) if len(h) == 8 * w else np.zeros(w, np.uint64) for h in held]) for w in np.unique(wide).tolist()}
    found = []
    for w in words:
        for v in (w, 2 * w):
            if v not in words:
                continue
            left, right = np.flatnonzero((wide == w) & (part == x)), np.flatnonzero((wide == v) & (part == y))
            turns = [(left, right)]
            if v != w and x != y:
                turns.append((np.flatnonzero((wide == w) & (part == y)), np.flatnonzero((wide == v) & (part == x))))
            for some, others in turns:
                if not len(some) or not len(others):
                    continue
                one = words[w][some]
                two = words[v][others]
                two = two if v == w else two[:, :w] ^ two[:, w:]
                step = max(1, WORDS_AT_ONCE // (len(others) * w))
                for low in range(0, len(some), step):
                    i = some[low : low + step, None]
                    apart = np.bitwise_count(one[low : low + step, None] ^ two[None]).sum(2, dtype=np.int64)
                    both = n[i] + n[others]
                    bound = np.minimum(n[i] - pos[i], (n - pos)[others]) + (depth - 1)
                    near = (apart * (OF + PARTS) <= both) & (bound * (OF + PARTS) >= both * OF) & (root[i] != root[others])
                    if x == y and v == w:
                        near &= i < others
                    at, to = np.nonzero(near)
                    found.append((some[low + at], others[to]))
    a, b = (node[np.concatenate([f[k] for f in found])] if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def block_pairs(large: DataFrame, sets: DataFrame, depth: int) -> DataFrame:
    """Pairs (a, b) of nodes of the same bucket that bitmaps and places don't rule out; buckets are gone through block by block."""
    parts = F.ceil(F.col("size") / WIDE).cast("int")
    maps = bitmaps(sets.join(large.select("node").distinct(), "node", "left_semi"))
    cut = large.select("token", "node", "n", "pos", "root", parts.alias("_parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part")).join(maps, "node")
    dealt = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("x", F.least("part", "_other")).withColumn("y", F.greatest("part", "_other"))
    return dealt.drop("_parts", "_other").groupBy("token", "x", "y").applyInArrow(lambda t: near_bitmaps(t, depth), "a long, b long")


def roots_of(prints: DataFrame, nodes: DataFrame, text: str, words: int) -> DataFrame:
    """Rows (node, root) for every node of ``nodes`` (node, row, fp) that is linked to another and isn't its root.

    A round reads what the one before wrote, whose other tables are deleted.
    """
    spark, paths = prints.sparkSession, []

    def write(df: DataFrame, name: str, **options) -> DataFrame:
        return materialise(df, name, written=paths, **options)

    shared = spark.sparkContext.broadcast(levels(prints, text, words).tobytes())
    live = write(postings(prints, shared, text, words), "live", compression="zstd")
    met = RowLists(live.select("node").distinct().join(nodes, "node").select(F.col("row").alias("_row")))
    whole: list[str] = []
    sets = materialise(shingle_sets(prints, met, text, words), "sets", written=whole)
    known = write(verified(write(ball_pairs(nodes.select("node", "fp")), "balls"), sets), "links")
    held: list[str] = []
    roots, leaders, small, depth = materialise(connect(known, held), "roots", written=held), 1, 0, 1
    # how many shingles follow a row's own among those of which similar sets share one more
    follow = F.expr(f"n - (n * {OF} + {PARTS - 1}) div {PARTS}") - F.col("pos")
    while not live.isEmpty():
        before, paths[:] = [*paths], []
        named = live.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        own = named.groupBy("token", "root").agg(F.count("*").alias("own"))
        sizes = own.groupBy("token").agg(F.sum("own").alias("size"), F.count("*").alias("roots")).where("roots > 1").select("token", "size")
        named = named.join(sizes, "token").join(own, ["token", "root"])
        named = write(named.select("token", "node", "n", "pos", "root", "size", "own"), "named")
        if named.isEmpty():
            break
        few = named.where(F.col("size") <= small).select("token", "node", "n", "pos", "root")
        large = named.where(F.col("size") > small)
        last = leaders > 2
        deal = 1 < leaders and depth < DEEPEST and cheaper(large, follow + depth)
        if deal:
            chosen = large.where(follow + depth >= F.col("size")).select("token", "node", "n", "pos", "root")
        elif last:
            chosen = large.limit(0).select("token", "node", "n", "pos", "root")
        else:
            part = F.pmod(F.xxhash64("node"), F.lit(leaders)).alias("part")
            least = large.groupBy("token", part).agg(F.min(F.struct("own", "node", "n", "pos", "root")).alias("x"))
            chosen = write(least.select("token", "x.node", "x.n", "x.pos", "x.root"), "leaders")
        first = few.unionByName(chosen).select("token", *(F.col(c).alias(f"_{c}") for c in ("node", "n", "pos", "root")))
        # the last shingle of those that name a bucket bounds what two sets can share from there on
        bound = F.least(F.col("n") - F.col("pos"), F.col("_n") - F.col("_pos")) + (depth - 1)
        pairs = first.join(named, "token").where((F.col("root") != F.col("_root")) & (bound * (OF + PARTS) >= (F.col("n") + F.col("_n")) * OF))
        pairs = pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b"))
        pairs = (pairs.unionByName(block_pairs(large, sets, depth)) if last and not deal else pairs).distinct()
        found = write(verified(write(pairs, "pairs"), sets), "links")
        if not found.isEmpty():
            known = roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(found)
            before, held = before + held, []
            roots = materialise(connect(known, held), "roots", written=held)
        if deal:
            live = write(further(large.where(follow + depth < F.col("size")), sets, shared, depth), "live", compression="zstd")
            leaders, depth = 1, depth + 1
        elif not last:
            live = write(large.select("token", "node", "n", "pos").join(chosen.select("token", "node"), ["token", "node"], "left_anti"), "live")
            leaders *= 2
        small = SMALL
        for path in before:
            remove(spark, path)
        if last and not deal:
            break
    shared.destroy()
    for path in [*paths, met.path, whole[0]]:
        remove(spark, path)
    return roots


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Keep one row of each group of near duplicates, the one with the smallest id, with its columns as they were."""
    own = [f"c{i}" for i in range(len(docs.columns))]  # names of the caller can't clash with ours
    back = dict(zip(docs.columns, own))
    prints = materialise(with_nodes(docs.toDF(*own), back[text], words), "prints", compression="zstd")
    order = F.struct(F.col(back[doc_id]).isNull().alias("n"), F.col(back[doc_id]).alias("id"), F.col("_row").alias("row"))
    first = materialise(prints.groupBy(F.col("_node").alias("node")).agg(F.min(order).alias("first"), F.min("_fp").alias("fp")), "nodes")
    roots = roots_of(prints, first.select("node", "first.row", "fp"), back[text], words)
    named = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = named.groupBy("root").agg(F.min("first").alias("stays"))
    kept = named.join(stays, "root").where(F.col("first.row") == F.col("stays.row")).select(F.col("node").alias("_node"), F.col("first.row").alias("_first"))
    gone = prints.select("_node", "_row").join(kept, "_node", "left").where(F.col("_first").isNull() | (F.col("_first") != F.col("_row"))).select("_row")
    lists = RowLists(gone)
    schema = StructType([prints.schema[c] for c in own])

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            yield batch.filter(pa.array(~lists.chosen(batch.column("_row").to_numpy(), known))).select(own)

    return prints.select(*own, "_row").mapInArrow(run, schema).toDF(*docs.columns)
