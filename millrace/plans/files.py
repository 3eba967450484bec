"""Queries that write raw files of ids, masks and bounds to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import documents, ordering
from millrace.plans.base import SUM, TOK, checksum, docs, query
from millrace.sources import shards, sink, tables
from millrace.sources.shared import shared_dir
from millrace.sources.tables import table

#: Ids of a byte range, of the ranges that one task reads, and of a part that one task writes.
RANGE, TASK, PART = 1 << 17, 1 << 21, 1 << 20


def written(spark, sf, width="u4", values=None):
    """The documents of each source as a stream of ids in parts: (sources, streams), in the order of their names."""
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    t = docs(spark, sf).select("source", "doc_id", "n", "ids")
    if values is not None:
        t = t.withColumn("ids", values)
    sink.write_tokens(t, "source", "doc_id", folder, width, part=PART)
    found = shards.by_folder(shards.listed(spark, folder))
    return [name for name, _ in found], [parts for _, parts in found]


def named(spark, names):
    """Rows (path_idx, source) of streams."""
    return F.broadcast(spark.createDataFrame([*enumerate(names)], "path_idx int, source string"))  # a row a stream


TOKENS = f"""{TOK}, tokens AS (SELECT source, "start" + i - 1 AS p, ids[i] AS token FROM docs, unnest(range(1, len(ids) + 1)) AS u(i))"""


@query(f"""{TOKENS} SELECT source, p // {RANGE} * {RANGE} AS chunk_start, count(*)::INT AS n, sum((p % {RANGE} + 1) * token)::BIGINT AS checksum, arg_max(token, p) AS last FROM tokens GROUP BY ALL""")
def a1_range_scan(spark, sf):
    names, streams = written(spark, sf)
    rows = shards.token_ranges(spark, streams, "u4", RANGE, TASK).join(named(spark, names), "path_idx")
    return rows.select("source", "chunk_start", F.size("ids").alias("n"), checksum(F.col("ids")).alias("checksum"), F.element_at("ids", -1).alias("last"))


@query(f"""{TOKENS} SELECT source, count(*)::INT AS n, sum((p - 999) * token)::BIGINT AS checksum FROM tokens WHERE p >= 1000 AND p < 21000 GROUP BY source""")
def a1_slice(spark, sf):
    names, streams = written(spark, sf)
    rows = shards.token_slices(spark, streams, "u4", 1000, 21_000, RANGE).join(named(spark, names), "path_idx")
    sums = rows.select("source", F.size("ids").alias("n"), (checksum(F.col("ids")) + (F.col("at") - 1000) * F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("checksum"))
    return sums.groupBy("source").agg(F.sum("n").cast("int").alias("n"), F.sum("checksum").alias("checksum"))


@query(f"""{TOK}, whole AS (SELECT source, sum(n)::BIGINT AS tokens, row_number() OVER (ORDER BY source) - 1 AS k FROM docs GROUP BY source) SELECT 'group ' || (k // 3) AS source, count(*) AS files, sum(tokens)::BIGINT AS tokens FROM whole GROUP BY 1""")
def a4_source_counts(spark, sf):
    _, streams = written(spark, sf)
    groups = spark.createDataFrame([(f"group {k // 3}", path) for k, parts in enumerate(streams) for path, _ in parts], "source string, path string")
    counts = shards.source_counts(shards.token_counts(spark, [path for parts in streams for path, _ in parts], "u4"), groups)
    whole = spark.createDataFrame([(f"group {k // 3}",) for k in range(len(streams))], "source string").groupBy("source").agg(F.count("*").alias("files"))
    return whole.join(counts.select("source", "tokens"), "source")


@query(f"""{TOK}, marks AS (SELECT source, "start", "end", len(list_filter(ids, lambda x: x <> 32))::INT AS kept, {SUM.format('ids')} AS checksum FROM docs) SELECT * FROM marks""")
def a5_file_documents(spark, sf):
    names, streams = written(spark, sf)
    _, masks = written(spark, sf, "u1", F.transform("ids", lambda x: (x != 32).cast("int")))
    found = shards.token_documents(spark, streams, "u4", 0, masks=masks, chunk=RANGE, task=TASK).join(named(spark, names), "path_idx")
    kept = F.size(F.filter("mask", lambda m: m == 1))
    return found.select("source", "start", "end", kept.alias("kept"), checksum(F.col("ids")).alias("checksum"))


@query(f"""{TOK} SELECT source, s AS "start", least("end", s + 700) AS "end", {SUM.format('ids[s - "start" + 1:s - "start" + 700]')} AS checksum FROM docs, unnest(range("start", "end", 700)) AS u(s)""")
def a5_fragmented(spark, sf):
    names, streams = written(spark, sf)
    found = shards.token_documents(spark, streams, "u4", 0, most=700, strategy="fragment", chunk=RANGE, task=TASK).join(named(spark, names), "path_idx")
    return found.select("source", "start", "end", checksum(F.col("ids")).alias("checksum"))


@query(f"""{TOK}{", chunked AS (SELECT source, p // 64 AS instance, p % 64 + 1 AS place, token FROM (SELECT source, " + '"start"' + " + i - 1 AS p, ids[i] AS token FROM docs, unnest(range(1, len(ids) + 1)) AS u(i)))"}
SELECT source, instance, sum(place * token)::BIGINT AS checksum FROM chunked GROUP BY ALL HAVING count(*) = 64""")
def d1_from_files(spark, sf):
    names, streams = written(spark, sf)
    chunks = shards.range_instances(shards.token_ranges(spark, streams, "u4", RANGE, TASK), 64).join(named(spark, names), "path_idx")
    return chunks.select("source", "instance", checksum(F.col("input_ids")).alias("checksum"))


@query(f"""{TOK} SELECT source, "start", "end" FROM docs""")
def b2_sidecar(spark, sf):
    names, streams = written(spark, sf)
    ranges = shards.token_ranges(spark, streams, "u4", RANGE, TASK)
    places = F.explode(documents.end_places(F.col("ids"), F.col("chunk_start"))).alias("end")
    folder = f"{shared_dir(spark)}/bounds-{uuid.uuid4().hex}"
    sink.write_bounds(documents.boundaries(ranges.select("path_idx", places), ["path_idx"]), "path_idx", folder)
    read = spark.read.schema("start long, end long, path_idx int").csv(folder)
    totals = spark.createDataFrame([(k, sum(size for _, size in parts) // 4) for k, parts in enumerate(streams)], "path_idx int, tokens long")
    return shards.checked_bounds(read, totals).join(named(spark, names), "path_idx").select("source", "start", "end")


@query("""WITH t AS (SELECT DISTINCT source FROM documents WHERE length(trim(text)) > 0), s AS (SELECT unnest([1, 2, 3]) AS seed)
SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || ':' || source), source) - 1 AS place, source FROM t, s""")
def a8_permuted(spark, sf):
    sources = docs(spark, sf).select("source").distinct()
    rows = [shards.permuted_rows(sources, "source", seed).withColumn("seed", F.lit(seed)) for seed in (1, 2, 3)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("seed", "place", "source")


@query(f"""{TOK}, bad AS (SELECT source, count(*) AS skipped FROM documents WHERE length(regexp_replace(coalesce(text, ''), '^{documents.SPACE}+|{documents.SPACE}+$', '', 'g')) = 0 GROUP BY source)
SELECT source, count(*) AS documents, sum(n)::BIGINT AS tokens, max(n)::BIGINT AS longest_with_end, coalesce(max(skipped), 0) AS skipped, count(*) AS bounds FROM docs LEFT JOIN bad USING (source) GROUP BY source""")
def b3_export(spark, sf):
    folder = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    files = sink.export(table(spark, sf, "documents"), "source", "doc_id", folder, "u4")
    statistics = spark.read.schema("source string, documents long, longest_with_end long, skipped long").json(f"{folder}/statistics")
    bounds = spark.read.schema("start long, end long, source string").csv(f"{folder}/bounds").groupBy("source").agg(F.count("*").alias("bounds"))
    found = statistics.join(files.select("source", "tokens"), "source").join(bounds, "source")
    return found.select("source", "documents", "tokens", "longest_with_end", "skipped", "bounds")


@query("""WITH ranked AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY md5('1:1:' || o_orderkey), o_orderkey) - 1 AS position FROM orders)
SELECT o_orderkey, o_totalprice, position % 64 AS slot FROM ranked WHERE position // 64 = 3""")
def b6_dumped_batch(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    plan = ordering.batches(ordering.shuffled(orders.select("o_orderkey"), "o_orderkey", 1, 1), 64, 4)
    return sink.dump_batch(plan, orders, "o_orderkey", 3, f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}").select("o_orderkey", "o_totalprice", "slot")


@query(f"""{TOK} SELECT CASE WHEN source < 'src10' THEN 'low' ELSE 'high' END AS label, count(DISTINCT source) AS streams, sum(n)::BIGINT AS tokens FROM docs GROUP BY 1""")
def a9_manifest(spark, sf):
    names, streams = written(spark, sf)
    folder = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    base = streams[0][0][0].rsplit("/", 2)[0]
    lines = ["# label, path", "", *(f"{'l' if n < 'src10' else 'h'},{n}/*.npy" for n in names)]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(folder)
    manifest = tables.mix_manifest(spark, folder, base, "tokens", {"l": "low", "h": "high"})
    rows = [(label, path.rsplit("/", 2)[1], size // 4) for path, size, label in shards.labelled_files(manifest, spark)]
    return spark.createDataFrame(rows, "label string, stream string, tokens long").groupBy("label").agg(F.countDistinct("stream").alias("streams"), F.sum("tokens").alias("tokens"))
