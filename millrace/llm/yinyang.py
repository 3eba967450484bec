"""Exact k-means by centroid groups and distance bounds (Yinyang).

Components become whole numbers, and centroids are componentwise floors of exact means, so every round is exact. Centroids
are clustered into groups once. Each vector keeps an upper bound of the distance to its own centroid and, for each group,
one lower bound of the distance to the group's other centroids; bounds follow centroids by how far those moved. A vector
whose upper bound lies below all lower bounds keeps its centroid without a distance; another's own distance is measured
and tested again; then only groups whose bound is reached are scanned, exactly. A margin for rounding only ever makes
more vectors be scanned.

Vectors lie in blocks of up to ``ROWS`` rows that are written once, in buckets by block. Each round writes the blocks'
assignments, bounds, counts and sums in the same buckets, so vectors and bounds meet without a shuffle; only k centroids
pass the driver. A round's table is dropped when the next is written.

Kept are vectors of exactly ``size`` components, none null or non-finite. With fewer vectors than centroids, each vector
starts one. Rows of one id start in the order of their components. Null ids are clustered, and never start a centroid
unless too few others are there. Repeated rows each count, ties go to the smaller number, empty tables give no rows, and
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import dropped_later, materialise, matrix, whole_numbers

#: Rows of a block, centroids of a group, and blocks that go to Python at once.
ROWS, GROUP, BATCH = 4096, 4, 16
FAR = np.int64(1 << 62)
_STATE = "block long, own binary, upper binary, lower binary, counts array<bigint>, sums array<bigint>, scanned long"


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances (row, centroid)."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(centers).max(initial=0)))
    if 4 * peak * peak * max(1, x.shape[1]) < 1 << 53:  # doubles are exact
        a, b = x.astype(np.float64), centers.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centers], 1)


def grouped(centers: np.ndarray, groups: int, rounds: int = 5) -> list[np.ndarray]:
    """Centroids by group: their own clustering, from evenly spaced ones."""
    heads = centers[np.linspace(0, len(centers) - 1, groups).astype(int)].astype(float)
    for _ in range(rounds):
        near = ((centers[:, None, :] - heads[None]) ** 2).sum(2).argmin(1)
        heads = np.stack([centers[near == g].mean(0) if (near == g).any() else heads[g] for g in range(groups)])
    return [at for g in range(groups) if len(at := np.flatnonzero(near == g))]


def _reaches(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return upper * (1 + 1e-9) + 1e-6 >= lower


def _others(found: np.ndarray, members: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Least distance to the members of a group that aren't a row's own; infinite where none was measured."""
    least = np.where(members == own[:, None], FAR, found[:, members]).min(1)
    return np.where(least == FAR, np.inf, np.sqrt(least.astype(float)))


def assign(x: np.ndarray, centers: np.ndarray, groups: list[np.ndarray], moved: np.ndarray | None = None, state: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids, upper and lower bounds, and how many distances were measured."""
    if state is None:
        found = squared(x, centers)
        own = found.argmin(1)
        return own, np.sqrt(found[np.arange(len(x)), own].astype(float)), np.stack([_others(found, g, own) for g in groups], 1), found.size
    own, upper, lower = (a.copy() for a in state)
    upper += moved[own]
    lower -= np.array([moved[g].max() for g in groups])
    near = lower.min(1)
    rows = np.flatnonzero(_reaches(upper, near))
    exact = ((x[rows] - centers[own[rows]]) ** 2).sum(1)
    upper[rows] = np.sqrt(exact.astype(float))
    scanned = len(rows)
    left = _reaches(upper[rows], near[rows])
    rows, exact = rows[left], exact[left]
    found = np.full((len(rows), len(centers)), FAR)
    found[np.arange(len(rows)), own[rows]] = exact
    opened = _reaches(upper[rows][:, None], lower[rows])
    for g, members in enumerate(groups):
        at = np.flatnonzero(opened[:, g])
        if len(at):
            found[np.ix_(at, members)] = squared(x[rows[at]], centers[members])
            scanned += len(at) * len(members)
    own[rows] = found.argmin(1)  # the first of equals
    upper[rows] = np.sqrt(found[np.arange(len(rows)), own[rows]].astype(float))
    for g, members in enumerate(groups):
        least = _others(found, members, own[rows])
        lower[rows, g] = np.where(opened[:, g], least, np.minimum(lower[rows, g], least))
    return own, upper, lower, scanned


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks (block, ids, q) of vectors, q the matrix as bytes."""

    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                count += 1
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + count]), pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([matrix(some.column(1)).astype("<i4").tobytes()], pa.binary())], ["block", "ids", "q"])

    return rows.mapInArrow(run, "block long, ids array<bigint>, q binary")


def _numbers(batch: pa.RecordBatch, name: str, row: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), kind)


def _round(blocks: DataFrame, state: DataFrame | None, centers: np.ndarray, groups: list[np.ndarray], moved: np.ndarray | None) -> DataFrame:
    """Blocks with their new assignments and bounds, and counts and sums of each centroid's rows."""
    wide, again = centers.shape[1], state is not None

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = _numbers(batch, "q", r, "<i4").reshape(-1, wide).astype(np.int64)
                before = None
                if again:
                    before = _numbers(batch, "own", r, "<i4").astype(np.int64), _numbers(batch, "upper", r, "<f8"), _numbers(batch, "lower", r, "<f8").reshape(len(x), -1)
                own, upper, lower, scanned = assign(x, centers, groups, moved, before)
                sums = np.stack([x[own == c].sum(0) for c in range(len(centers))])
                columns = [batch.column(batch.schema.get_field_index("block")).slice(r, 1), *(pa.array([a.tobytes()], pa.binary()) for a in (own.astype("<i4"), upper, lower))]
                columns += [pa.array([np.bincount(own, minlength=len(centers))], pa.list_(pa.int64())), pa.array([sums.ravel()], pa.list_(pa.int64())), pa.array([scanned], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "own", "upper", "lower", "counts", "sums", "scanned"])

    read = blocks.join(state.select("block", "own", "upper", "lower"), "block") if again else blocks
    return read.drop("ids").mapInArrow(run, _STATE)


def _means(state: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Floors of the means of each centroid's vectors; one without vectors stays."""
    k, wide = centers.shape
    totals = state.select(F.posexplode(F.concat("counts", "sums")).alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
    found = {r["at"]: r["value"] for r in totals.collect()}  # k * (components + 1) rows
    return np.array([[found[k + c * wide + j] // found[c] for j in range(wide)] if found[c] else centers[c] for c in range(k)], np.int64)


def _assigned(blocks: DataFrame, state: DataFrame, centers: np.ndarray) -> DataFrame:
    """Rows (vec_id, cluster, distance), distances exact."""
    wide = centers.shape[1]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = _numbers(batch, "q", r, "<i4").reshape(-1, wide).astype(np.int64)
                own = _numbers(batch, "own", r, "<i4")
                ids = batch.column(batch.schema.get_field_index("ids"))[r].values
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(((x - centers[own]) ** 2).sum(1), pa.int64())], ["vec_id", "cluster", "distance"])

    return blocks.join(state.select("block", "own"), "block").mapInArrow(run, "vec_id long, cluster int, distance long")


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest hashes of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.withColumn("_hash", digest).orderBy(F.asc_nulls_last("_hash"), "q").limit(k).collect()  # k rows
    return np.array([r["q"] for r in first], np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, size: int = 64, seed: int = 3, group: int = GROUP, watch: list | None = None) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    ``rounds`` rounds of assignment and means, and a last assignment. ``watch``, a list, gets the number of distances that
    each round measured. Rounds after one that moves no centroid would give the same again and are left out.
    """
    rows = whole_numbers(vectors, scale, size=size)
    centers = starts(rows, k, seed)
    if not len(centers):
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).limit(0)
    groups = grouped(centers, max(1, -(-len(centers) // group)))
    blocks, drop_blocks = dropped_later(_blocks(rows), "yinyang_vectors", "block", ROWS)
    state = moved = drop = None
    for n in range(rounds + 1):
        new, drop_new = dropped_later(_round(blocks, state, centers, groups, moved), "yinyang_bounds", "block", BATCH)
        if drop:
            drop()
        state, drop = new, drop_new
        if watch is not None:
            watch.append(state.agg(F.sum("scanned")).first()[0])
        if n == rounds:
            break
        means = _means(state, centers)
        moved = np.sqrt(((means - centers) ** 2).sum(1).astype(float)) * (1 + 1e-12)
        if not moved.any():
            break
        centers = means
    found = materialise(_assigned(blocks, state, centers), "yinyang_clusters", batch=BATCH)
    drop()
    drop_blocks()
    inertia = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # k rows
    by_cluster = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centers]
    own = by_cluster([int(inertia.get(c, 0)) for c in range(len(centers))]).cast("long")
    return found.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), by_cluster(digests).alias("centroid_sha256"))


def sql(k: int = 8, rounds: int = 10, scale: int = 1024, size: int = 64, seed: int = 3) -> str:
    """DuckDB SQL of ``cluster``: the rounds one after another."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS c, q FROM v ORDER BY sha256('{seed}:' || vec_id), q LIMIT {k})",
        f"places AS MATERIALIZED (SELECT unnest(range(1, {size} + 1)) AS j)",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT r, vec_id, q, c, distance FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY distance, c) AS place FROM
  (SELECT v.r, v.vec_id, v.q, c{n}.c, list_sum(list_transform(range(1, {size} + 1), lambda i: (v.q[i] - c{n}.q[i]) * (v.q[i] - c{n}.q[i])))::BIGINT AS distance FROM v, c{n})) WHERE place = 1)"""
        )
        if n < rounds:
            steps.append(f"m{n} AS MATERIALIZED (SELECT c, list(mean ORDER BY j) AS q FROM (SELECT c, j, ((sum(q[j]) - (sum(q[j]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS mean FROM a{n}, places GROUP BY c, j) GROUP BY c)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.q, c{n}.q) AS q FROM c{n} LEFT JOIN m{n} ON c{n}.c = m{n}.c)")
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, {last}.c::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY {last}.c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} ON {last}.c = c{rounds}.c"""
