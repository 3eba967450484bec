"""Exact top-k search by inner product over a bit-sliced index.

Components become whole numbers. The index holds blocks of rows; of each component it has a bitmap over the block's rows
for each binary digit. A query's scores over a block are sums of those bitmaps, added by full adders on whole bitmaps: for
each digit of the query's components, the slices of the components that have it; negative ones add complemented slices,
and a constant sets that right. The best rows are selected from the highest digit of the sums downward, so no score of
any other row is ever formed; rows on the boundary, which tie with the last that is taken, are then told apart by id.

Queries meet all rows in blocks: rows in lanes of ``LANE`` blocks of up to ``ROWS`` rows, queries in parts of about
``PART``, and each pair of a lane and a part is a group of bounded size. Each group gives its k best for a query, of which
a ranked window takes the best. Copies of one vector, however many, lie in blocks like any other rows.

Vectors that are null or hold null or non-finite components take no part. Vectors of other lengths count as filled with
zeros. Rows of a query's own id aren't its candidates; a query that is repeated is answered once, queries of one id with
different vectors each for themselves. Repeated rows each count. A null id is never a query's; as a candidate it comes
last among equal scores. Fewer candidates than k give fewer rows, an empty table none. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, matrix, whole_numbers

#: Rows of a block, blocks of a lane, queries of a part, and queries that make a part of their own where there are few.
ROWS, LANE, PART, LEAST = 1 << 14, 8, 512, 32


def sliced(numbers: np.ndarray) -> tuple[np.ndarray, int]:
    """Bit slices (component, digit, word) of a matrix of rows, each number raised by 2 ** (digits - 1), and the digits."""
    rows, wide = numbers.shape
    digits = 1 + int(max(numbers.max(initial=0), -1 - numbers.min(initial=0))).bit_length()
    raised = (numbers + (1 << (digits - 1))).T
    out = np.zeros((wide, digits, 8 * (-(-rows // 64))), np.uint8)
    for j in range(digits):
        packed = np.packbits((raised >> j & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, j, : packed.shape[1]] = packed
    return out.view("<u8"), digits


def added(levels: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sums of bitmaps, a digit each: ``levels[n]`` has stacks of bitmaps that count 2 ** n."""
    out: list[np.ndarray] = []
    carried: list[np.ndarray] = []
    while len(out) < len(levels) or carried:
        stacks = [*(levels[len(out)] if len(out) < len(levels) else []), *carried]
        carried = []
        if not stacks:
            out.append(None)
            continue
        stack = np.concatenate(stacks) if len(stacks) > 1 else stacks[0]
        while len(stack) > 2:
            t = len(stack) // 3
            a, b, c = stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t]
            odd = a ^ b
            carry = a & b
            carry |= odd & c
            odd ^= c
            carried.append(carry)
            stack = np.concatenate([odd, stack[3 * t :]]) if len(stack) > 3 * t else odd
        if len(stack) == 2:
            carried.append(stack[:1] & stack[1:])
            stack = stack[:1] ^ stack[1:]
        out.append(stack[0])
    empty = next((np.zeros_like(x) for x in out if x is not None), None)
    return [empty if x is None else x for x in out]


def scores(both: np.ndarray, digits: int, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Digits of the rows' scores, as bitmaps, and what they are too high by. ``both`` has slices and complemented slices."""
    size, negative = np.abs(weights), (weights < 0).astype(int)
    levels = []
    for i in range(int(size.max(initial=0)).bit_length()):
        at = np.flatnonzero(size >> i & 1)
        levels.append([both[negative[at], at]] if len(at) else [])
    sums = added(levels)  # each with all of the slices' digits, side by side
    spread: list[list[np.ndarray]] = [[] for _ in range(len(sums) + digits)]
    for n, planes in enumerate(sums):
        for j in range(digits):
            spread[n + j].append(planes[j : j + 1])
    high = (int(weights.sum()) << (digits - 1)) + ((1 << digits) - 1) * int(size[negative == 1].sum())
    return added(spread) if sums else [], high


def best(planes: list[np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the rows that score at least as high as the k-th best of those alive."""
    sure, edge = np.zeros_like(alive), alive
    for plane in reversed(planes):
        up = edge & plane
        if int(np.bitwise_count(sure | up).sum()) >= k:
            edge = up
        else:
            sure = sure | up
            edge = edge & ~plane
    return sure | edge


def bit_index(rows: DataFrame, name: str = "bit_index") -> DataFrame:
    """Blocks (block, ids, components, digits, slices) of rows (vec_id, q), written once to the shared folder."""

    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def block(some: pa.Table):
            nonlocal count
            slices, digits = sliced(matrix(some.column("q").combine_chunks()))
            count += 1
            arrays = [pa.array([(task << 32) + count]), pa.array([some.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([slices.shape[0]], pa.int32()), pa.array([digits], pa.int32()), pa.array([slices.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["block", "ids", "components", "digits", "slices"])

        for batch in batches:
            while batch.num_rows:
                free = ROWS - sum(b.num_rows for b in held)
                held.append(batch.slice(0, free))
                batch = batch.slice(free)
                if sum(b.num_rows for b in held) == ROWS:
                    yield block(pa.Table.from_batches(held))
                    held = []
        if held:
            yield block(pa.Table.from_batches(held))

    return materialise(rows.mapInArrow(run, "block long, ids array<bigint>, components int, digits int, slices binary"), name)


def _search(k: int):
    """What answers the queries of a part from the blocks of a lane."""

    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        asked = [(i, key, np.array(q, np.int64)) for i, key, q in zip(*(queries.column(c).to_pylist() for c in ("query_id", "query", "q")))]
        found: list[list[tuple]] = [[] for _ in asked]
        for r in range(blocks.num_rows if asked else 0):
            ids = blocks.column("ids")[r].values
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
            wide, digits = blocks.column("components")[r].as_py(), blocks.column("digits")[r].as_py()
            words = -(-len(numbers) // 64)
            slices = np.frombuffer(blocks.column("slices")[r].as_buffer(), "<u8").reshape(wide, digits, words)
            both = np.stack([slices, ~slices])
            every = np.zeros(8 * words, np.uint8)
            packed = np.packbits(np.ones(len(numbers), np.uint8), bitorder="little")
            every[: len(packed)] = packed
            for n, (i, _, q) in enumerate(asked):
                weights = np.zeros(wide, np.int64)
                weights[: len(q)] = q[:wide]
                planes, high = scores(both, digits, weights)
                alive = every.copy()
                own = np.flatnonzero((numbers == i) & known)
                np.bitwise_and.at(alive, own >> 3, ~(1 << (own & 7)).astype(np.uint8))
                at = np.flatnonzero(np.unpackbits(best(planes, alive.view("<u8"), k).view(np.uint8), bitorder="little"))
                value = np.full(len(at), -high, np.int64)
                for level, plane in enumerate(planes):
                    value += (plane[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << level
                order = np.lexsort((numbers[at], ~known[at], -value))[:k]
                found[n] += [(-int(v), not known[a], int(numbers[a])) for v, a in zip(value[order], at[order])]
        rows = [(asked[n][0], asked[n][1], None if lost else i, -v) for n, some in enumerate(found) for v, lost, i in sorted(some)[:k]]
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best rows of an index for each query (vec_id, q); ties go to the smaller id."""
    spark = index.sparkSession
    asked = materialise(queries.select(F.col("vec_id").alias("query_id"), "q", F.xxhash64("q").alias("query")).distinct(), "bit_queries")
    lanes = max(1, math.ceil(index.count() / LANE))
    n = asked.count()
    parts = max(1, math.ceil(n / PART), min(math.ceil(n / LEAST), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")).withColumn("part", every(parts))
    right = asked.withColumn("part", F.pmod(F.xxhash64("query_id", "query"), F.lit(parts)).cast("int")).withColumn("lane", every(lanes))
    met = left.groupBy("lane", "part").cogroup(right.groupBy("lane", "part")).applyInArrow(_search(k), "query_id long, query long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50) -> DataFrame:
    """The k best other rows of each row whose id is divisible by ``every``."""
    rows = whole_numbers(vectors, scale)
    return search(bit_index(rows), rows.where(F.col("vec_id") % every == 0), k)


#: DuckDB SQL of ``top_k`` with its defaults, for vectors of one length.
SQL = """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
