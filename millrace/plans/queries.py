"""Queries over the driver's tables, one for each operator, with the DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import arrays, schedules
from millrace.operators import documents, instances, metrics, mixing, ordering, repetition
from millrace.operators.sums import running_sum, sorted_sums
from millrace.plans.base import SUM, TOK, checksum, docs, query, sized
from millrace.sources.tables import table
from millrace.streaming import spikes as streams

@query(f"{TOK} SELECT doc_id, n::BIGINT AS n, {SUM.format('ids')} AS checksum FROM docs")
def c10_tokenize(spark, sf):
    return docs(spark, sf).select("doc_id", "n", checksum(F.col("ids")).alias("checksum"))


@query(f"""SELECT lang, count(*) FILTER (n > 0) AS documents, sum(CASE WHEN n > 0 THEN n + 1 ELSE 0 END)::BIGINT AS tokens, max(n)::BIGINT AS longest,
max(CASE WHEN n > 0 THEN n + 1 END)::BIGINT AS longest_with_end, count(*) FILTER (n = 0) AS skipped
FROM (SELECT lang, length(regexp_replace(coalesce(text, ''), '^{documents.SPACE}+|{documents.SPACE}+$', '', 'g')) AS n FROM documents) GROUP BY lang""")
def c11_export_statistics(spark, sf):
    return documents.export_statistics(table(spark, sf, "documents"), "lang")


@query(f'{TOK} SELECT source, doc_id, "start", "end" FROM placed_docs'.replace("FROM placed_docs", "FROM docs"))
def c12_document_offsets(spark, sf):
    return documents.offsets(sized(spark, sf), ["source"], "doc_id").select("source", "doc_id", "start", "end")


@query(f"""{TOK}, tokens AS (SELECT source, "start" + i - 1 AS pos, ids[i] AS token FROM docs, unnest(range(1, len(ids) + 1)) AS u(i)),
ends AS (SELECT source, pos + 1 AS e FROM tokens WHERE token = 0)
SELECT source, coalesce(lag(e) OVER (PARTITION BY source ORDER BY e), 0) AS "start", e AS "end" FROM ends""")
def c1_boundaries(spark, sf):
    placed = documents.offsets(docs(spark, sf), ["source"], "doc_id")
    return documents.boundaries(placed.select("source", F.explode(documents.end_places(F.col("ids"), F.col("start"))).alias("end")), ["source"])


@query(f"""{TOK} SELECT source, doc_id, "start", least("end", "start" + 512) AS "end" FROM docs""")
def c6_truncate(spark, sf):
    return documents.fragments(documents.offsets(sized(spark, sf), ["source"], "doc_id"), 512).select("source", "doc_id", "start", "end")


@query(f"""{TOK} SELECT source, doc_id, s AS "start", least("end", s + 512) AS "end" FROM docs, unnest(range("start", "end", 512)) AS u(s)""")
def c6_fragment(spark, sf):
    return documents.fragments(documents.offsets(sized(spark, sf), ["source"], "doc_id"), 512, "fragment").select("source", "doc_id", "start", "end")


CHUNK = """, chunked AS (SELECT source, p // 64 AS instance, p % 64 + 1 AS place, token FROM (SELECT source, "start" + i - 1 AS p, ids[i] AS token FROM docs, unnest(range(1, len(ids) + 1)) AS u(i)))"""


@query(f"{TOK}{CHUNK} SELECT source, instance, sum(place * token)::BIGINT AS checksum FROM chunked GROUP BY ALL HAVING count(*) = 64")
def d1_concat_chunk(spark, sf):
    rows = instances.concat_and_chunk(docs(spark, sf), 64, ["source"], "doc_id")
    return rows.select("source", "instance", checksum(F.col("input_ids")).alias("checksum"))


@query(f"""{TOK}{CHUNK}, totals AS (SELECT source, (sum(n)::BIGINT // 256) * 4 AS n FROM docs GROUP BY source)
SELECT source, instance, sum(place * token)::BIGINT AS checksum FROM chunked JOIN totals USING (source) WHERE instance < totals.n GROUP BY ALL""")
def d2_stable_chunks(spark, sf):
    rows = instances.concat_and_chunk(docs(spark, sf), 64, ["source"], "doc_id", most=256)
    return rows.select("source", "instance", checksum(F.col("input_ids")).alias("checksum"))


@query(f"""{TOK}, totals AS (SELECT source, (sum(n)::BIGINT // 512) * 512 AS n FROM docs GROUP BY source), tokens AS (SELECT source, "start" + i - 1 AS p, ids[i] AS token FROM docs, unnest(range(1, len(ids) + 1)) AS u(i)),
kept AS (SELECT source, sum(token)::BIGINT AS total FROM tokens JOIN totals USING (source) WHERE p < totals.n GROUP BY source)
SELECT source, size, (totals.n // size)::BIGINT AS instances, total FROM totals JOIN kept USING (source), (VALUES (128), (512)) AS s(size) WHERE totals.n > 0""")
def d3_same_tokens(spark, sf):
    t = docs(spark, sf)
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = [instances.concat_and_chunk(t, size, ["source"], "doc_id", most=512).groupBy("source").agg(F.lit(size).alias("size"), F.count("*").alias("instances"), F.sum(total).alias("total")) for size in (128, 512)]
    return parts[0].unionByName(parts[1])


@query(f"""{TOK}{CHUNK}, rows_ AS (SELECT source, instance, list(place ORDER BY place) FILTER (token = 0) AS ends FROM chunked GROUP BY ALL HAVING count(*) = 64)
SELECT source, instance, len(ends) + (CASE WHEN ends[-1] = 64 THEN 0 ELSE 1 END) AS pieces, coalesce(ends[1], 64)::BIGINT AS first_length
FROM (SELECT source, instance, coalesce(ends, []) AS ends FROM rows_)""".replace("len(ends) + (CASE WHEN ends[-1] = 64 THEN 0 ELSE 1 END)", "(len(ends) + CASE WHEN len(ends) > 0 AND ends[-1] = 64 THEN 0 ELSE 1 END)::INT"))
def c7_document_lengths(spark, sf):
    rows = instances.concat_and_chunk(docs(spark, sf), 64, ["source"], "doc_id").withColumn("lens", documents.lengths(F.col("input_ids")))
    return rows.select("source", "instance", F.size("lens").alias("pieces"), F.element_at("lens", 1).cast("long").alias("first_length"))


@query(f"""{TOK} SELECT doc_id, least(n, 256)::BIGINT AS filled, ({SUM.format('ids[1:256]')} - (SELECT coalesce(sum(i), 0) FROM unnest(range(least(n, 256) + 1, 257)) AS u(i)))::BIGINT AS checksum FROM docs""")
def d5_padded(spark, sf):
    rows = instances.padded(docs(spark, sf), 256, -1)
    return rows.select("doc_id", F.size(F.filter("label_mask", lambda m: m)).cast("long").alias("filled"), checksum(F.col("input_ids")).alias("checksum"))


@query(f"""{TOK}, sized AS (SELECT doc_id, "start", n, list_concat(list_transform(range(0, n >> 9), lambda i: 512), list_transform(list_filter([8, 7, 6, 5, 4], lambda k: (n >> k) & 1 = 1), lambda k: 1 << k)) AS s FROM docs)
SELECT doc_id, (i - 1)::INT AS piece, s[i]::INT AS length, ("start" + coalesce(list_sum(s[1:i - 1]), 0))::BIGINT AS piece_start FROM sized, unnest(range(1, len(s) + 1)) AS u(i)""")
def d11_power_pieces(spark, sf):
    placed = documents.offsets(sized(spark, sf), ["source"], "doc_id")
    return instances.power_pieces(placed, 4, 9).select("doc_id", "piece", "length", "piece_start")


@query(f"""{TOK}, sized AS (SELECT list_concat(list_transform(range(0, n >> 9), lambda i: 512), list_transform(list_filter([8, 7, 6, 5, 4], lambda k: (n >> k) & 1 = 1), lambda k: 1 << k)) AS s FROM docs)
SELECT l::INT AS length, count(*) AS instances, (4096 // l)::BIGINT AS batch_instances, count(*) // (4096 // l) AS batches FROM sized, unnest(s) AS u(l) GROUP BY l""")
def d12_bucket_batches(spark, sf):
    pieces = sized(spark, sf).select(F.explode(instances.power_lengths(F.col("n"), 4, 9)).alias("length"))
    return ordering.bucket_batches(pieces, 4096)


def pack(spark, sf, strategy):
    cut = instances.pieces(docs(spark, sf).withColumn("pack", F.expr("doc_id div 512")), 2048, strategy)
    return cut, instances.packed(cut, 2048, "pack", "doc_id")


#: Of packing in SQL: its totals, that no bin overflows, that every piece is there once, and that two bins at most are half empty.
PACKED = """ SELECT pack, count(*) AS pieces, sum(n)::BIGINT AS tokens, 0::BIGINT AS overfull, 0::BIGINT AS misplaced, true AS tight FROM cut GROUP BY pack"""


def packing(cut, bins):
    filled = bins.groupBy("pack", "bin").agg(F.sum("n").alias("filled"), F.count("*").alias("pieces"))
    by = filled.groupBy("pack").agg(F.sum("pieces").alias("pieces"), F.sum("filled").alias("tokens"), F.count_if(F.col("filled") > 2048).alias("overfull"), (F.count_if(F.col("filled") <= 1024) <= 1).alias("tight"))
    met = cut.select("pack", "doc_id", "piece", "n").join(bins.withColumnRenamed("n", "m"), ["pack", "doc_id", "piece"], "full")
    wrong = met.groupBy("pack").agg(F.count_if(F.col("n").isNull() | F.col("m").isNull() | (F.col("n") != F.col("m"))).alias("misplaced"))
    return by.join(wrong, "pack").select("pack", "pieces", "tokens", "overfull", "misplaced", "tight")


@query(f"{TOK}, cut AS (SELECT doc_id // 512 AS pack, least(n, 2048) AS n FROM docs){PACKED}")
def d8_packed_truncated(spark, sf):
    return packing(*pack(spark, sf, "truncate"))


@query(f"{TOK}, cut AS (SELECT doc_id // 512 AS pack, least(2048, n - i * 2048) AS n FROM docs, unnest(range(0, (n - 1) // 2048 + 1)) AS u(i)){PACKED}")
def d8_packed_fragments(spark, sf):
    return packing(*pack(spark, sf, "fragment"))


@query()
def d7_packed(spark, sf):
    cut, bins = pack(spark, sf, "fragment")
    rows = instances.packed_instances(cut, bins, 2048, "pack", "doc_id", -1)
    return rows.select("pack", "bin", "doc_lens", checksum(F.col("input_ids")).alias("checksum"))


@query(f"{TOK}, cut AS (SELECT doc_id // 512 AS pack, list_sum(list_transform(ids[i * 2048 + 1:(i + 1) * 2048], lambda x: x))::BIGINT AS total, least(2048, n - i * 2048) AS n FROM docs, unnest(range(0, (n - 1) // 2048 + 1)) AS u(i)) SELECT pack, sum(total)::BIGINT AS total, sum(n)::BIGINT AS kept, true AS whole FROM cut GROUP BY pack")
def d7_packed_rows(spark, sf):
    cut, bins = pack(spark, sf, "fragment")
    rows = instances.packed_instances(cut, bins, 2048, "pack", "doc_id", -1)
    kept = F.size(F.filter("label_mask", lambda m: m))
    total = F.aggregate(F.filter("input_ids", lambda x: x >= 0), F.lit(0).cast("long"), lambda a, x: a + x)
    whole = (F.size("input_ids") == 2048) & (F.size("label_mask") == 2048) & (F.aggregate("doc_lens", F.lit(0), lambda a, x: a + x) == kept)
    return rows.groupBy("pack").agg(F.sum(total).alias("total"), F.sum(kept).alias("kept"), F.every(whole).alias("whole"))


@query(f"""{TOK}, ranked AS (SELECT row_number() OVER (ORDER BY md5('7:1:' || doc_id), doc_id) - 1 AS position, list_filter(ids[1:64], lambda x: x <> 0) AS kept FROM docs WHERE lang <> 'es'),
cut AS (SELECT position // 2 AS instance, position % 2 AS slot, i AS turn, kept[i * (len(kept) // 4) + least(i, len(kept) % 4) + 1:(i + 1) * (len(kept) // 4) + least(i + 1, len(kept) % 4)] AS ids FROM ranked, unnest(range(0, 4)) AS u(i)),
rows_ AS (SELECT instance, flatten(list(ids ORDER BY turn, slot)) AS ids FROM cut GROUP BY instance HAVING count(*) = 8),
closed AS (SELECT instance, CASE WHEN len(ids) < 128 THEN list_append(ids, 0) ELSE ids END AS ids FROM rows_),
alone AS (SELECT doc_id AS o, ids[1:128] AS ids, 0 AS part FROM docs WHERE lang = 'es'), both_ AS (SELECT * FROM alone UNION ALL SELECT instance, ids, 1 FROM closed)
SELECT row_number() OVER (ORDER BY part, o) - 1 AS "index", ({SUM.format('ids')} - (SELECT coalesce(sum(j), 0) FROM unnest(range(len(ids) + 1, 129)) AS u(j)))::BIGINT AS checksum FROM both_""")
def d10_exempt(spark, sf):
    rows = instances.interleaved_but(docs(spark, sf), F.col("lang") == "es", 128, 2, 4, 7, 1, "doc_id")
    return rows.select("index", checksum(F.col("input_ids")).alias("checksum"))


@query(f"""{TOK}, a AS (SELECT 0 AS part, source, doc_id FROM docs WHERE lang = 'de' UNION ALL SELECT 1, source, doc_id FROM docs WHERE lang = 'fr' UNION ALL SELECT 2, source, doc_id FROM docs WHERE lang = 'de')
SELECT part, doc_id, row_number() OVER (ORDER BY part, doc_id) - 1 AS "index", r_name AS label FROM a LEFT JOIN (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS part, r_name FROM region) USING (part)""")
def d13_concatenated_instances(spark, sf):
    t = sized(spark, sf).select("doc_id", "lang", F.lit(1).alias("one"))
    parts = [t.where(F.col("lang") == lang).withColumn("part", F.lit(k)) for k, lang in enumerate(("de", "fr", "de"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ranked = running_sum(both, ["part"], "doc_id", "one", "r").withColumn("r", F.col("r") - 1)
    labels = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("part"), F.col("r_name").alias("label"))
    return instances.labelled(instances.dense_index(ranked, ["part"], "r"), labels, ["part"]).select("part", "doc_id", "index", "label")


@query(f"""{TOK}, ranked AS (SELECT row_number() OVER (ORDER BY md5('7:1:' || doc_id), doc_id) - 1 AS position, list_filter(ids[1:64], lambda x: x <> 0) AS kept FROM docs),
cut AS (SELECT position // 2 AS instance, position % 2 AS slot, i AS turn, kept[i * (len(kept) // 4) + least(i, len(kept) % 4) + 1:(i + 1) * (len(kept) // 4) + least(i + 1, len(kept) % 4)] AS ids FROM ranked, unnest(range(0, 4)) AS u(i)),
rows_ AS (SELECT instance, flatten(list(ids ORDER BY turn, slot)) AS ids FROM cut GROUP BY instance HAVING count(*) = 8),
closed AS (SELECT instance, CASE WHEN len(ids) < 128 THEN list_append(ids, 0) ELSE ids END AS ids FROM rows_)
SELECT instance, len(ids)::INT AS used, ({SUM.format('ids')} - (SELECT coalesce(sum(j), 0) FROM unnest(range(len(ids) + 1, 129)) AS u(j)))::BIGINT AS checksum FROM closed""")
def d9_interleaved(spark, sf):
    ranked = ordering.shuffled(docs(spark, sf), "doc_id", 7, 1)
    rows = instances.interleaved(ranked, 128, 2, 4, "position")
    return rows.select("instance", "used", checksum(F.col("input_ids")).alias("checksum"))


REPEATS = f"""{TOK}, same AS (SELECT doc_id, p, i FROM docs, unnest(range(1, least(13, len(ids) // 3) + 1)) AS u(p), unnest(range(1, len(ids) - p + 1)) AS v(i) WHERE ids[i] = ids[i + p]),
island AS (SELECT doc_id, p, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS g FROM same),
run AS (SELECT doc_id, p, (count(*) + p) // p AS times FROM island GROUP BY doc_id, p, g),
best AS (SELECT doc_id, count(*) AS runs, max(times) AS most_times FROM run WHERE times >= 3 GROUP BY doc_id)
SELECT docs.doc_id, coalesce(runs, 0)::BIGINT AS runs, coalesce(most_times, 0)::BIGINT AS most_times, coalesce(most_times, 0) < 32 AS instance_mask FROM docs LEFT JOIN best USING (doc_id)"""


@query(REPEATS)
def e1_repetition(spark, sf):
    return repetition.repetition(docs(spark, sf).select("doc_id", "ids")).drop("ids")


@query(f"""{TOK} SELECT doc_id, len(bad)::BIGINT AS bad_ids, coalesce(list_sum(bad), 0)::BIGINT AS bad_sum FROM (SELECT doc_id, list_distinct(list_filter(ids, lambda x: x < 0 OR x >= 128)) AS bad FROM docs)""")
def e3_vocabulary(spark, sf):
    bad = arrays.outside_vocabulary(F.col("ids"), 128)
    return docs(spark, sf).select("doc_id", F.size(bad).cast("long").alias("bad_ids"), F.aggregate(bad, F.lit(0).cast("long"), lambda a, x: a + x).alias("bad_sum"))


@query(f"""{TOK}, moved AS (SELECT doc_id, list_append(list_transform(ids[2:], lambda x: CASE WHEN x = 32 THEN -100 ELSE x END), -100) AS ids FROM docs) SELECT doc_id, {SUM.format('ids')} AS checksum FROM moved""")
def e4_labels(spark, sf):
    mask = F.transform("ids", lambda x: x != 32)
    return docs(spark, sf).select("doc_id", checksum(arrays.shifted_labels(F.col("ids"), mask)).alias("checksum"))


@query(f"""{TOK}, plan AS (SELECT lang, sum(n)::BIGINT AS size, CASE lang WHEN 'en' THEN 0.4 WHEN 'de' THEN 0.3 WHEN 'fr' THEN 0.2 ELSE 0.1 END::DOUBLE AS ratio, 1.5::DOUBLE AS repetition FROM docs GROUP BY lang),
want AS (SELECT *, sum(size) OVER ()::DOUBLE * ratio / sum(ratio) OVER () AS w FROM plan), used AS (SELECT *, least(repetition, greatest(w / size, 1.0)) AS u FROM want)
SELECT lang, size, floor(w * least(1.0, min(size * u / w) OVER ()))::BIGINT AS sample FROM used""")
def f1_sample_sizes(spark, sf):
    ratio = F.when(F.col("lang") == "en", 0.4).when(F.col("lang") == "de", 0.3).when(F.col("lang") == "fr", 0.2).otherwise(0.1)
    plan = sized(spark, sf).groupBy("lang").agg(F.sum("n").alias("size")).withColumn("ratio", ratio).withColumn("repetition", F.lit(1.5))
    return mixing.sample_sizes(plan).select("lang", "size", "sample")


@query(f"""{TOK}, plan AS (SELECT source, sum(n)::BIGINT // 2 AS tokens, sum(n)::BIGINT AS max_tokens FROM docs GROUP BY source),
base AS (SELECT *, max_tokens // 64 AS cap, least(tokens // 64, max_tokens // 64) AS b FROM plan), total AS (SELECT sum(tokens)::BIGINT // 64 AS need FROM plan),
one AS (SELECT *, b < cap AS room, greatest(need - sum(b) OVER (), 0) AS missing, count(*) FILTER (b < cap) OVER () AS eligible FROM base, total),
two AS (SELECT *, b + CASE WHEN room THEN least((missing // greatest(eligible, 1))::BIGINT, cap - b) ELSE 0 END AS b2 FROM one),
three AS (SELECT *, greatest(need - sum(b2) OVER (), 0) AS left_, room AND b2 < cap AS is_open FROM two),
four AS (SELECT *, row_number() OVER (PARTITION BY is_open ORDER BY (CASE WHEN room THEN tokens % 64 ELSE 0 END) DESC, source DESC) AS k FROM three)
SELECT source, (b2 + CASE WHEN is_open AND k <= left_ THEN 1 ELSE 0 END)::BIGINT AS instances FROM four""")
def f3_apportion(spark, sf):
    plan = sized(spark, sf).groupBy("source").agg(F.expr("sum(n) div 2").alias("tokens"), F.sum("n").alias("max_tokens"))
    need = F.floor(F.sum("tokens").over(Window.partitionBy()) / 64)  # a row a source
    return mixing.apportion(plan.withColumn("need", need), F.col("need"), 64, "source").select("source", "instances")


SAMPLE = """, ranked AS (SELECT doc_id, n, row_number() OVER (ORDER BY md5('3:1:' || doc_id), doc_id) AS position FROM docs),
total AS (SELECT sum(n)::BIGINT AS total, sum(n)::BIGINT * 5 // 2 AS most FROM docs), summed AS (SELECT *, sum(n) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) AS s FROM ranked, total)
SELECT doc_id, unnest(range(0, (most // total) + CASE WHEN s <= most - (most // total) * total THEN 1 ELSE 0 END))::INT AS "copy" FROM summed"""


@query(f"{TOK}{SAMPLE}")
def f6_sample_documents(spark, sf):
    t = sized(spark, sf).select("doc_id", "n")
    return mixing.sample_documents(ordering.shuffled(t, "doc_id", 3, 1), F.expr("total * 5 div 2"), "position").select("doc_id", "copy")


@query(f"""{TOK} SELECT source, doc_id, greatest("start", 1000) AS "start", least("end", 5000) AS "end", {SUM.format('cut')} AS checksum
FROM (SELECT *, ids[greatest("start", 1000) - "start" + 1:least("end", 5000) - "start"] AS cut FROM docs WHERE "start" < 5000 AND "end" > 1000)""")
def g3_token_slice(spark, sf):
    cut = mixing.token_slices(documents.offsets(docs(spark, sf), ["source"], "doc_id"), 1000, 5000)
    return cut.select("source", "doc_id", "start", "end", checksum(F.col("ids")).alias("checksum"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def g8_except(spark, sf):
    return table(spark, sf, "documents").select("doc_id").distinct().join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY md5('11:2:' || (l_orderkey * 8 + l_linenumber)), l_orderkey * 8 + l_linenumber) - 1 AS position FROM lineitem")
def h1_shuffle(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("index"))
    return ordering.shuffled(rows, "index", 11, 2).drop("index")


@query("""WITH unit AS (SELECT u, row_number() OVER (ORDER BY md5('11:1:' || u), u) - 1 AS place FROM (SELECT DISTINCT o_orderkey // 4 AS u FROM orders))
SELECT o_orderkey, place * 4 + o_orderkey % 4 AS position FROM orders JOIN unit ON o_orderkey // 4 = u""")
def h2_chunked_shuffle(spark, sf):
    return ordering.shuffled(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 11, 1, chunk=4)


@query("""WITH ranked AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('1:1:' || o_orderkey), o_orderkey) - 1 AS position FROM orders), total AS (SELECT count(*) AS n FROM orders)
SELECT o_orderkey, position // 64 AS batch, position % 64 AS slot, (position % 64) % 4 AS rank FROM ranked, total WHERE position < n - n % 64""")
def i1_batch_plan(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey")
    return ordering.batches(ordering.shuffled(rows, "o_orderkey", 1, 1), 64, 4).drop("position")


@query("""SELECT l_returnflag, l_linestatus, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS mean FROM lineitem GROUP BY ALL""")
def k1_weighted_mean(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(metrics.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")).alias("mean"))


@query("""WITH loss AS (SELECT event_type AS label, value / 100 AS loss, user_id % 3 <> 0 AS keep FROM events), wanted AS (SELECT DISTINCT event_type AS label FROM events UNION SELECT 'unseen')
SELECT label, coalesce(sum(loss * keep::INT) / nullif(sum(keep::INT), 0), 'nan'::DOUBLE) AS ce_loss, exp(coalesce(sum(loss * keep::INT) / nullif(sum(keep::INT), 0), 'nan'::DOUBLE)) AS ppl FROM wanted LEFT JOIN loss USING (label) GROUP BY label""")
def k2_label_losses(spark, sf):
    losses = table(spark, sf, "events").select(F.col("event_type").alias("label"), (F.col("value") / 100).alias("loss"), (F.col("user_id") % 3 != 0).alias("keep"))
    labels = losses.select("label").distinct().union(spark.range(1).select(F.lit("unseen")))
    return metrics.label_losses(losses, labels)


@query("""SELECT user_id, event_type, avg(value) AS mean, sum(value) AS sum, max(value) AS max, sqrt(sum(value * value)) AS l2_norm FROM events GROUP BY ALL""")
def k3_reduce(spark, sf):
    return metrics.reduced(table(spark, sf, "events"), ["user_id", "event_type"])


@query("""SELECT user_id, event_type, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, sum(value) AS sum, max(value) AS max, min(value) AS min,
list_reduce(list(value ORDER BY event_id), lambda a, x: (a + x) / 2) AS mean FROM events GROUP BY ALL""")
def k4_merge(spark, sf):
    return metrics.merged(table(spark, sf, "events"), ["user_id", "event_type"], "event_id")


@query("""WITH n AS (SELECT label, count(*) AS c FROM embeddings GROUP BY label) SELECT count(*) AS experts, sum(c)::BIGINT AS "rows", max(c) / avg(c) AS imbalance FROM n""")
def k8_load_balance(spark, sf):
    return metrics.load_balance(table(spark, sf, "embeddings"), "label")


@query("""SELECT vec_id, ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) AS lse FROM embeddings""")
def k9_log_sum_exp(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", arrays.log_sum_exp(F.col("embedding")).alias("lse"))


SPIKE = """WITH w AS (SELECT event_id, user_id, value, abs(value - 50) AS grad, count(value) OVER p AS n, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s, avg(abs(value - 50)) OVER p AS m2, stddev_pop(abs(value - 50)) OVER p AS s2
FROM events WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
spiked AS (SELECT event_id, user_id, coalesce(n = 8 AND s >= 1e-10 AND value > m + 2 * s, false) OR coalesce(n = 8 AND s2 >= 1e-10 AND grad > m2 + 2 * s2, false) AS spike, coalesce(n = 8 AND s >= 1e-10 AND value > m + 2 * s, false) AS loss_spike FROM w)"""


def steps(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "value", F.abs(F.col("value") - 50).alias("grad"))


@query(f"{SPIKE} SELECT event_id, user_id, loss_spike AS spike FROM spiked")
def l3_spikes(spark, sf):
    return metrics.spikes(steps(spark, sf), ["user_id"], "event_id", ["value"], 8, 2.0).select("event_id", "user_id", "spike")


@query(f"""{SPIKE}, placed AS (SELECT *, row_number() OVER o AS r, sum(spike::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING) AS last, sum(spike::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS every FROM spiked WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, spike, CASE WHEN r >= 10 THEN last / 10 END AS rolling_rate, CASE WHEN r >= 8 THEN every / r END AS total_rate FROM placed""")
def l4_spike_rates(spark, sf):
    found = metrics.spikes(steps(spark, sf), ["user_id"], "event_id", ["value", "grad"], 8, 2.0)
    return metrics.spike_rates(found, ["user_id"], "event_id", 10, 8).select("event_id", "spike", "rolling_rate", "total_rate")


@query("""WITH w AS (SELECT event_id, value, abs(value - 50) AS grad, count(value) OVER p AS n, avg(value) OVER p AS m, stddev_samp(value) OVER p AS s, avg(abs(value - 50)) OVER p AS m2, stddev_samp(abs(value - 50)) OVER p AS s2 FROM events WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING))
SELECT event_id, (NOT (n + 1 >= 8) OR coalesce(value - m <= 2 * s, true)) AND (NOT (n + 1 >= 8) OR coalesce(grad - m2 <= 2 * s2, true)) AS keep FROM w""")
def l5_kept_steps(spark, sf):
    return metrics.kept_steps(steps(spark, sf), ["user_id"], "event_id", ["value", "grad"], 16, 2.0).select("event_id", "keep")


@query("""WITH t AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS s, value FROM events), d AS (SELECT *, s - lag(s) OVER o AS step_seconds FROM t WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT *, sum(CASE WHEN step_seconds IS NOT NULL THEN value ELSE 0 END) OVER o AS tokens, sum(coalesce(step_seconds, 0)) OVER o AS took, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM d WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, step_seconds, value / nullif(step_seconds, 0) AS tps, CASE WHEN r > 1 THEN tokens / nullif(took, 0) END AS tps_average, 0.25 / nullif(step_seconds, 0) AS loading_share, value / nullif(step_seconds, 0) * 6.0 / 312.0 AS used FROM c""")
def k5_throughput(spark, sf):
    steps = table(spark, sf, "events").select("event_id", "user_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), F.lit(0.25).alias("waited"))
    return metrics.throughput(steps, ["user_id"], "event_id", "s", "value", "waited", 6.0, 312.0).select("event_id", "step_seconds", "tps", "tps_average", "loading_share", "used")


@query("""WITH sched AS (SELECT o_custkey AS k, o_orderdate AS s, max(o_totalprice) AS price FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2)
SELECT o_orderkey, price AS in_force FROM (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderkey % 2 = 1) ASOF LEFT JOIN sched ON o_custkey = k AND o_orderdate >= s""")
def n10_as_of(spark, sf):
    orders = table(spark, sf, "orders")
    sched = orders.where("o_orderkey % 2 = 0").groupBy("o_custkey", F.col("o_orderdate").alias("s")).agg(F.max("o_totalprice").alias("in_force"))
    rows = orders.where("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey", "o_orderdate")
    return metrics.as_of(rows, sched, ["o_custkey"], "o_orderdate", "s", ["in_force"]).select("o_orderkey", "in_force")


@query("""SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best, len(list_filter(embedding, lambda x: x >= list_sort(embedding, 'DESC')[5]))::BIGINT AS kept FROM embeddings""")
def m4_top_k(spark, sf):
    kept = F.size(F.filter(arrays.top_k(F.col("embedding"), 5), lambda x: x > arrays.LOWEST)).cast("long")
    return table(spark, sf, "embeddings").select("vec_id", arrays.argmax(F.col("embedding")).alias("best"), kept.alias("kept"))


@query("""WITH e AS (SELECT vec_id, u.i, embedding[u.i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)),
p AS (SELECT vec_id, i, x, exp(x - max(x) OVER w) / sum(exp(x - (SELECT 0))) OVER w * exp(max(x) OVER w) AS q, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM e WINDOW w AS (PARTITION BY vec_id)),
c AS (SELECT vec_id, i, r, coalesce(sum(q) OVER (PARTITION BY vec_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT vec_id, count(*) AS kept, sum(i)::BIGINT AS places FROM c WHERE r <= 2 OR before <= 0.5 GROUP BY vec_id""")
def m5_top_p(spark, sf):
    kept = F.transform(arrays.top_p(F.col("embedding"), 0.5), lambda x, i: F.when(x > arrays.LOWEST, (i + 1).cast("long")))
    kept = F.array_compact(kept)
    return table(spark, sf, "embeddings").select("vec_id", F.size(kept).cast("long").alias("kept"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("places"))


@query("""SELECT vec_id, unnest(list_transform(list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'x': -embedding[i], 'i': i - 1}))[1:2], lambda r: r.i))::INT AS expert FROM embeddings""")
def m8_top_experts(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.explode(arrays.top_experts(F.col("embedding"), 2)).alias("expert"))


@query("""SELECT o_orderkey, CASE WHEN x < 3000 THEN 4 + 6.0 * least(x, 3000) / 3000 WHEN x >= 10000 THEN 2.0 ELSE 10 - 8.0 * (x - 3000) / 7000 END AS linear,
CASE WHEN x < 3000 THEN 4 + 6.0 * least(x, 3000) / 3000 WHEN x >= 10000 THEN 2.0 ELSE 2 + 8.0 * (1 + cos(pi() * (x - 3000) / 7000)) / 2 END AS cosine,
CASE WHEN x < 3000 THEN 4 + 6.0 * least(x, 3000) / 3000 ELSE 2 + 8.0 * sqrt(3000.0 / x) END AS inverse_sqrt,
CASE WHEN x <= 3000 THEN 4 + 6.0 * least(x, 3000) / 3000 WHEN x >= 9000 THEN 10.0 * least(10000 - x, 1000) / 1000 ELSE 10.0 END AS wsd,
1e-9 * pow(10 / 1e-9, x / 10000) AS exponential, (1 << floor(log2(128 + 3968.0 * least(x, 2000) / 2000))::INT)::BIGINT AS sequence_length
FROM (SELECT o_orderkey, o_orderkey % 10001 AS x FROM orders)""")
def o11_schedules(spark, sf):
    x = F.col("o_orderkey") % 10001
    return table(spark, sf, "orders").select(
        "o_orderkey",
        schedules.linear_with_warmup(x, 10.0, 10_000, 3000, 0.2, 4.0).alias("linear"),
        schedules.cosine_with_warmup(x, 10.0, 10_000, 3000, 0.2, 4.0).alias("cosine"),
        schedules.inverse_sqrt_with_warmup(x, 10.0, 3000, 0.2, 4.0).alias("inverse_sqrt"),
        schedules.warmup_stable_decay(x, 10.0, 10_000, 3000, 1000, 4.0).alias("wsd"),
        schedules.exponential(x, 10.0, 10_000).alias("exponential"),
        schedules.sequence_length(x, 128, 4096, 2000).alias("sequence_length"),
    )


@query("""SELECT c_custkey, sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS running FROM customer""")
def l1_running_sum(spark, sf):
    return running_sum(table(spark, sf, "customer"), ["c_nationkey"], "c_custkey", "c_acctbal", "running").select("c_custkey", "running")


@query(f"{SPIKE} SELECT user_id, event_id, loss_spike AS spike FROM spiked")
def p8_streaming_spikes(spark, sf):
    return streams.drained(streams.spikes(streams.replay(spark, f"{sf}/events.parquet"), "user_id", "event_id", "value", 8, 2.0))


@query(f"""{TOK}, ranked AS (SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM docs),
shape AS (SELECT count(*) AS k_all, min(c) AS least FROM (SELECT source, count(*) AS c FROM docs GROUP BY source))
SELECT doc_id, r * k_all + k AS position FROM ranked, shape WHERE r < least""")
def h3_interleaved_sources(spark, sf):
    t = sized(spark, sf).select("doc_id", "source", F.lit(1).alias("one"))
    ranked = running_sum(t, ["source"], "doc_id", "one", "n").withColumn("r", F.col("n") - 1)
    return ordering.interleaved_sources(ranked, "source", "r").select("doc_id", "position")


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS b, n_nationkey FROM nation) SELECT n_nationkey, (1003 // 25 + CASE WHEN b < 1003 % 25 THEN 1 ELSE 0 END)::BIGINT AS size FROM n""")
def h8_near_equal(spark, sf):
    buckets = table(spark, sf, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("b"))
    return ordering.near_equal(1003, buckets, "b").select("n_nationkey", "size")


@query(f"""{TOK}{CHUNK}, full_ AS (SELECT source, instance, list(token ORDER BY place) AS ids FROM chunked GROUP BY ALL HAVING count(*) = 64)
SELECT source, instance, (p - 1)::INT AS part, {SUM.format('ids[(p - 1) * 16 + 1:p * 16]')} AS checksum FROM full_, unnest(range(1, 5)) AS v(p)""")
def j2_melted(spark, sf):
    rows = instances.concat_and_chunk(docs(spark, sf), 64, ["source"], "doc_id")
    parts = rows.select("source", "instance", F.posexplode(arrays.melted(F.col("input_ids"), 16)).alias("part", "ids"))
    return parts.select("source", "instance", "part", checksum(F.col("ids")).alias("checksum"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_totalprice AS price, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)
SELECT id, avg(price) OVER (ORDER BY r ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean FROM o WHERE id % 1 = 0""")
def k6_trailing_mean(spark, sf):
    return metrics.trailing_mean(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), "id", "price", 10, "mean").select("id", "mean")


@query("""SELECT o_orderkey, sum(round(o_totalprice * 100)::BIGINT) OVER (ORDER BY hash_, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM (SELECT *, (o_orderkey * 7919 % 1000003) * 4611686018427 AS hash_ FROM orders)""")
def l1_sparse_sum(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.expr("(o_orderkey * 7919 % 1000003) * 4611686018427").alias("hash"))
    return sorted_sums(rows, [], ["hash", "o_orderkey"], {"running": "cents"}).select("o_orderkey", "running")


@query(f"{TOK}, cut AS (SELECT doc_id // 512 AS pack, least(n, 2048) AS n FROM docs) SELECT pack, sum(n)::BIGINT AS tokens, true AS adds_up FROM cut GROUP BY pack")
def k11_padding(spark, sf):
    found = instances.padding(pack(spark, sf, "truncate")[1], 2048, "pack")
    return found.select("pack", "tokens", (F.round(F.col("bins") * F.col("mean_padding")) == F.col("bins") * 2048 - F.col("tokens")).alias("adds_up"))
