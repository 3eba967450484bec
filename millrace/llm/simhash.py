"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits meet in the middle: some value lies within one bit of both. So every
distinct fingerprint emits itself and its 64 one-bit variants, rows shuffle on the variant, and fingerprints that
collide there are verified and linked. A variant's ball holds 65 fingerprints at most, however many documents share
them, so no group is large; copies collapse to one fingerprint before any variant is made. A fingerprint that very many
documents share meets them again in a join at the end, whose hot keys adaptive execution splits.

Nulls and empty texts have no words: their fingerprint is zero and links like any other. Repeated rows and copies
share a fingerprint and so a component. A null doc_id takes part in linking, and gets the component's smallest id that
is not null (null only if the component has none). Columns besides those named are ignored by ``components`` and kept by
``deduplicate``. Texts are read whole; bits of a long text are counted in blocks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from millrace.llm.common import LOWER, as_int64, materialise, utf8

WORDS = 3
RADIUS = 2
SEED = 42
_BLOCK = 1 << 15


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included."""
    tokens = (text or b"").translate(LOWER).split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = iter([b" ".join(tokens)])
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    hashes = (xxhash.xxh64_intdigest(s, SEED) for s in shingles)
    return majority(np.array(block, "<u8") for block in itertools.batched(hashes, _BLOCK))


def majority(blocks) -> int:
    """The bits that are set in over half of all hashes, given in blocks."""
    ones, n = np.zeros(64, np.int64), 0
    for block in blocks:
        bits = np.unpackbits(np.ascontiguousarray(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        n += len(block)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, words: int = WORDS) -> DataFrame:
    """The columns ``keep`` (all by default), a row number ``_row`` unique within the result, and ``_fp`` as a signed long."""
    kept = docs.columns if keep is None else keep
    schema = StructType([*(docs.schema[c] for c in kept), T.StructField("_row", T.LongType()), T.StructField("_fp", T.LongType())])

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            prints = as_int64(np.array([fingerprint(t, words) for t in utf8(batch.column("_text"))], dtype=np.uint64))
            columns = [batch.column(c) for c in kept] + [pa.array(np.arange(row, row + batch.num_rows)), pa.array(prints)]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, [*kept, "_row", "_fp"])

    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)


def links(prints: DataFrame) -> DataFrame:
    """Linked pairs (a, b) of distinct fingerprints ``_fp``, enough of them to connect all that differ in two bits or fewer.

    Within a variant's ball all members are linked to its smallest; any two members are within two bits of each other.
    """
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    variants = prints.select("_fp").distinct().select("_fp", F.explode(flips).alias("_flip"))
    variants = variants.select("_fp", F.col("_fp").bitwiseXOR(F.col("_flip")).alias("_variant"))
    met = variants.withColumn("a", F.min("_fp").over(Window.partitionBy("_variant")))
    pairs = met.where(F.col("a") != F.col("_fp")).select("a", F.col("_fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def connect(edges: DataFrame, written: list[str] | None = None) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root) for every node that has an edge and isn't a root.

    Alternates large-star and small-star contraction. Each step is a pre-aggregated minimum per node and a join
    whose hot keys Spark can split; reliable checkpoints cut the lineage. It ends when a round changes nothing. The paths
    of what it writes, its result among them, are put on the list ``written``.
    """

    def state(df):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        return tuple(row)

    def contract(df):
        both = df.unionByName(df.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v > u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        return small.unionByName(least.select("v", F.col("m").alias("u"))).distinct()

    current = materialise(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct(), "edges", written=written)
    before = state(current)
    while before[0]:
        current = materialise(contract(current), "star", written=written)
        now = state(current)
        if now == before:
            break
        before = now
    return current.select(F.col("v").alias("node"), F.col("u").alias("root"))


def components_of(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """For a written table of ``_fp``, ``_row`` and the id: rows (_fp, component_id, _keep), _keep being the row that stays."""
    order = F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("id"), F.col("_row").alias("row"))
    distinct = prints.groupBy("_fp").agg(F.min(order).alias("_first"))
    distinct = materialise(distinct, "prints")
    roots = connect(links(distinct))
    named = distinct.join(roots, distinct["_fp"] == roots["node"], "left").select("_fp", "_first", F.coalesce("root", "_fp").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_first").alias("_least"))
    return named.join(least, "_root").select("_fp", F.col("_least.id").alias("component_id"), F.col("_least.row").alias("_keep"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id."""
    prints = materialise(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"], words=words), "simhash")
    found = components_of(prints)
    return prints.join(found, "_fp").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Keep one row of each component, the one with the smallest id, with its columns as they were."""
    own = [f"c{i}" for i in range(len(docs.columns))]  # names of the caller can't clash with ours
    back = dict(zip(docs.columns, own))
    prints = materialise(with_fingerprints(docs.toDF(*own), back[text], words=words), "simhash")
    keep = components_of(prints.select("_row", "_fp", back[doc_id]), back[doc_id]).select(F.col("_keep").alias("_row")).distinct()
    return prints.join(keep, "_row", "left_semi").select(*own).toDF(*docs.columns)
