"""Queries of loader plans: curricula, batches, collation, and positional look-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import arrays
from millrace.operators import documents, instances, loading, ordering, sampling
from millrace.operators.sums import ranked
from millrace.plans.base import SUM, TOK, checksum, docs, query, sized
from millrace.sources.shared import shared_dir
from millrace.sources.tables import table
from millrace.streaming import loader

BUCKETS = TOK + """, sized AS (SELECT doc_id, list_concat(list_transform(range(0, n >> 9), lambda i: 512), list_transform(list_filter([8, 7, 6, 5, 4], lambda k: (n >> k) & 1 = 1), lambda k: 1 << k)) AS s FROM docs),
inst AS (SELECT doc_id * 1000 + i - 1 AS "index", s[i]::BIGINT AS length FROM sized, unnest(range(1, len(s) + 1)) AS u(i)),
counts AS (SELECT length, count(*) AS instances, 4096 // length AS per FROM inst GROUP BY length),
plan AS (SELECT *, row_number() OVER (ORDER BY length) - 1 AS bucket, coalesce(sum(batches) OVER (ORDER BY length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM (SELECT *, (instances // per // {cycles}) * {cycles} AS batches FROM counts))"""


def buckets(cycles: int = 1) -> str:
    return BUCKETS.replace("{cycles}", str(cycles))


def pieces(spark, sf):
    lengths = instances.power_lengths(F.col("n"), 4, 9)
    return sized(spark, sf).select("doc_id", F.posexplode(lengths).alias("piece", "length")).select((F.col("doc_id") * 1000 + F.col("piece")).alias("index"), F.col("length").cast("long").alias("length"))


@query(f"""{buckets()}, dealt AS (SELECT "index", inst.length, per, batches, first, row_number() OVER (PARTITION BY inst.length ORDER BY md5('7:2:' || inst.length || ':' || "index"), "index") - 1 AS place FROM inst JOIN plan USING (length)),
kept AS (SELECT "index", length, first + place // per AS batch, place % per AS slot, per // 4 AS each FROM dealt WHERE place < batches * per)
SELECT "index", length, batch, slot, slot // each AS rank FROM kept WHERE slot < each * 4""")
def i2_bucket_batches(spark, sf):
    rows = pieces(spark, sf)
    found = loading.bucket_batches(rows, loading.bucket_plan(rows, 4096), "index", 4, 7, 2)
    return found.select("index", "length", "batch", "slot", "rank")


NATURAL = buckets() + """, batches AS (SELECT bucket, length, unnest(range(first, first + batches)) AS batch FROM plan), keyed AS (SELECT bucket, length, batch, md5('3:1:' || batch) AS k FROM batches),
lead AS (SELECT arg_min(batch, k) AS lead FROM keyed WHERE bucket = (SELECT max(bucket) FROM plan WHERE batches > 0)),
ordered AS (SELECT row_number() OVER (ORDER BY CASE WHEN batch = lead THEN '' ELSE k END, batch) - 1 AS position, batch, bucket FROM keyed, lead)"""


@query(f"{NATURAL} SELECT * FROM ordered")
def h6_natural_curriculum(spark, sf):
    return loading.natural_order(loading.bucket_plan(pieces(spark, sf), 4096), 3, 1)


@query(f"""{NATURAL}, part AS (SELECT position, bucket, position // ((SELECT count(*) FROM ordered) // 5 + 1) AS wide FROM ordered), shape AS (SELECT count(*) AS n FROM ordered),
cut AS (SELECT bucket, CASE WHEN position < (n % 5) * (n // 5 + 1) THEN position // (n // 5 + 1) ELSE n % 5 + (position - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS part FROM ordered, shape)
SELECT 0 AS cycle, part, bucket, count(*) AS batches FROM cut GROUP BY ALL""")
def h9_distribution(spark, sf):
    order = loading.natural_order(loading.bucket_plan(pieces(spark, sf), 4096), 3, 1)
    return loading.distribution(order.withColumn("cycle", F.lit(0)), 5)


def growth_sql(kind: str) -> str:
    odds = "pow(2.0, place - 1)" if kind == "power" else "place::DOUBLE"
    return f"""{buckets(3)}, shape AS (SELECT count(*) AS b FROM plan),
steps AS (SELECT bucket, first, batches // 3 AS each, b, step, CASE WHEN b - bucket + step <= b THEN b - bucket + step ELSE b - bucket - (b - bucket + step) % b END AS place FROM plan, shape, unnest(range(0, b)) AS u(step)),
shares AS (SELECT *, {odds} AS o FROM steps), rounded AS (SELECT *, round_even(o / sum(o) OVER (PARTITION BY bucket) * each, 0)::BIGINT AS n FROM shares),
counted AS (SELECT *, n + CASE WHEN step = b - 1 THEN each - sum(n) OVER (PARTITION BY bucket) ELSE 0 END AS m FROM rounded),
growth AS (SELECT cycle::INT AS cycle, step, bucket, m::BIGINT AS batches, (first + cycle * each + coalesce(sum(m) OVER (PARTITION BY bucket, cycle ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first FROM counted, unnest(range(0, 3)) AS u(cycle))"""


def growth(spark, sf, kind):
    return loading.growth_plan(loading.bucket_plan(pieces(spark, sf), 4096, cycles=3), kind, 3)


@query(f"{growth_sql('power')} SELECT * FROM growth")
def h7_growth_by_powers(spark, sf):
    return growth(spark, sf, "power")


@query(f"{growth_sql('linear')} SELECT * FROM growth")
def h7_growth_linear(spark, sf):
    return growth(spark, sf, "linear")


@query(f"""{growth_sql('power')}, batches AS (SELECT cycle, step, bucket, unnest(range(first, first + batches)) AS batch FROM growth)
SELECT row_number() OVER (ORDER BY cycle, step, md5('5:1:' || batch), batch) - 1 AS position, batch, bucket, cycle, step FROM batches""")
def h7_growth_order(spark, sf):
    return loading.growth_order(growth(spark, sf, "power"), 5, 1)


@query(f"""{buckets()} SELECT length, instances, per, (SELECT min(instances // per) FROM plan) // 3 * 3 AS batches FROM plan""")
def h7_balanced_buckets(spark, sf):
    return loading.bucket_plan(pieces(spark, sf), 4096, cycles=3, balanced=True).select("length", "instances", "per", "batches")


@query(f"""{buckets()} SELECT length, "index", row_number() OVER (PARTITION BY length ORDER BY md5('7:2:' || length || ':' || "index"), "index") - 1 AS position FROM inst""")
def h10_bucket_shuffle(spark, sf):
    return sampling.shuffled_within(pieces(spark, sf), ["length"], "index", 7, 2).select("length", "index", "position")


@query("""WITH s AS (SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) SELECT e AS epoch, n_nationkey FROM s, unnest([1, 2, 7, 8]) AS u(e) WHERE k // 5 = (e - 1) % (25 // 5)""")
def h5_epoch_sources(spark, sf):
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("k"))
    parts = [ordering.epoch_sources(nations, "k", 5, e).select(F.lit(e).alias("epoch"), "n_nationkey") for e in (1, 2, 7, 8)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_shipmode_, row_number() OVER (PARTITION BY l_shipmode_ ORDER BY md5('2:1:' || l_shipmode_ || ':' || (l_orderkey * 8 + l_linenumber)), l_orderkey * 8 + l_linenumber) - 1 AS p
FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem)), n AS (SELECT l_shipmode_, count(*) AS n FROM r GROUP BY 1), b AS (SELECT l_shipmode_, coalesce(sum(n) OVER (ORDER BY l_shipmode_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM n)
SELECT l_orderkey, l_linenumber, base + p AS position FROM r JOIN b USING (l_shipmode_)""")
def h3_intra_source(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("index"))
    placed = sampling.shuffled_within(rows, ["l_returnflag"], "index", 2, 1)
    return ordering.concatenated_sources(placed, "l_returnflag", "position").select("l_orderkey", "l_linenumber", "position")


BATCHED = """WITH ranked AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('1:1:' || o_orderkey), o_orderkey) - 1 AS position FROM orders), total AS (SELECT count(*) AS n FROM orders),
plan AS (SELECT o_orderkey, position // 64 AS batch, position % 64 AS slot, (position % 64) % 4 AS rank FROM ranked, total WHERE position < n - n % 64)"""


def plan(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey")
    return ordering.batches(ordering.shuffled(rows, "o_orderkey", 1, 1), 64, 4).drop("position")


@query(f"{BATCHED} SELECT o_orderkey, batch, slot, rank FROM plan WHERE batch IN (0, 5, 20)")
def i3_chosen_batches(spark, sf):
    return plan(spark, sf).where(F.col("batch").isin(0, 5, 20))


@query("SELECT count(*) AS instances, count(*) // 64 AS batches, (count(*) // 64) * 64 AS used FROM orders")
def i6_totals(spark, sf):
    return plan(spark, sf).agg((F.max("batch") + 1).alias("batches"), F.count("*").alias("used")).withColumn("instances", table(spark, sf, "orders").agg(F.count("*")).scalar())


@query(f"{BATCHED} SELECT o_orderkey, batch, rank, slot // 24 AS micro, slot % 24 AS micro_slot FROM plan")
def j1_micro_batches(spark, sf):
    return loading.micro_batches(plan(spark, sf), 24).drop("slot")


@query(f"{BATCHED} SELECT o_orderkey, batch, slot, rank FROM plan WHERE batch >= 3 * 128 // 64")
def p2_restored(spark, sf):
    cursor = loading.Cursor(("orders",), 128, seed=1).advanced(3).state()
    return loading.Cursor(("orders",), 64).restored(cursor).remaining(plan(spark, sf))


@query(f"{BATCHED} SELECT batch, sum(o_orderkey)::BIGINT AS total FROM plan WHERE batch < 12 AND batch >= 6 GROUP BY batch")
def p4_rescaled(spark, sf):
    cursor = loading.Cursor(("orders",), 128, seed=1).advanced(3).rescaled(64)
    left = cursor.remaining(plan(spark, sf)).where(F.col("batch") < 12)
    return left.groupBy("batch").agg(F.sum("o_orderkey").alias("total"))


@query("""WITH r AS (SELECT p_partkey, 8 * (1 + p_size % 5) AS n, 90 // (8 * (1 + p_size % 5)) AS each, row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_size % 5) AS rows_ FROM part),
kept AS (SELECT *, dense_rank() OVER (ORDER BY n) AS run FROM r WHERE place < rows_ // each * each), sizes AS (SELECT run, count(*) // max(each) AS batches FROM kept GROUP BY run),
based AS (SELECT run, coalesce(sum(batches) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM sizes) SELECT p_partkey, n, base + place // each AS batch FROM kept JOIN based USING (run)""")
def i4_token_batches(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", (8 * (1 + F.col("p_size") % 5)).cast("long").alias("n"))
    sizes = parts.groupBy("n").agg((F.expr("count(*) div (90 div n)") * F.expr("90 div n")).alias("c"))
    base = sizes.withColumn("base", F.coalesce(F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = ranked(parts, ["n"], "p_partkey", "r").join(base, "n").where("r <= c")
    return loading.token_batches(rows.select("p_partkey", "n", (F.col("base") + F.col("r") - 1).alias("k")), "k", "n", 90).select("p_partkey", "n", "batch")


COLLATE = f"""{TOK}, cut AS (SELECT doc_id, doc_id // 8 AS batch, ids[1:64 - doc_id % 7] AS ids FROM docs), widest AS (SELECT batch, max(len(ids)) AS w FROM cut GROUP BY batch),"""


@query(f"""{COLLATE} filled AS (SELECT doc_id, w, list_concat(ids, list_transform(range(0, w - len(ids)), lambda i: -1::BIGINT)) AS r, list_concat(list_transform(range(0, w - len(ids)), lambda i: -1::BIGINT), ids) AS l FROM cut JOIN widest USING (batch))
SELECT doc_id, w::INT AS width, {SUM.format('r')} AS right_sum, {SUM.format('l')} AS left_sum FROM filled""")
def i5_collated(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.expr("doc_id div 8").alias("batch"), F.slice("ids", F.lit(1), (64 - F.col("doc_id") % 7).cast("int")).alias("ids"))
    right = loading.collated(rows, "batch", {"ids": -1}).select("doc_id", F.size("ids").alias("width"), checksum(F.col("ids")).alias("right_sum"))
    left = loading.collated(rows, "batch", {"ids": -1}, "left").select("doc_id", checksum(F.col("ids")).alias("left_sum"))
    return right.join(left, "doc_id")


WHOLE = f"""{TOK}, rows_ AS (SELECT doc_id, ids FROM docs),"""
CUT = f"""{TOK}, rows_ AS (SELECT doc_id, ids[1:100] AS ids FROM docs),"""


@query(f"""{WHOLE} spaces AS (SELECT doc_id, list_filter(range(1, len(ids) + 1), lambda i: ids[i] = 32) AS e, len(ids) AS n FROM rows_),
ends AS (SELECT doc_id, CASE WHEN len(e) > 0 AND e[-1] = n THEN e ELSE list_append(e, n) END AS e FROM spaces),
lens AS (SELECT doc_id, i - 1 AS piece, e[i] - CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END AS length FROM ends, unnest(range(1, len(e) + 1)) AS u(i))
SELECT doc_id AS "row", piece::INT AS piece, length::INT AS length, sum(length) OVER (ORDER BY doc_id, piece ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" FROM lens""")
def c8_cumulative_lengths(spark, sf):
    rows = docs(spark, sf).select("doc_id", "n", "ids")
    return documents.cumulative_lengths(rows.withColumn("doc_lens", documents.lengths(F.col("ids"), 32)), "doc_id")


@query(f"""{TOK}, moved AS (SELECT source, doc_id, list_concat([7::BIGINT], ids) AS ids, n + 1 AS n FROM docs), placed2 AS (SELECT source, ids, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM moved),
tokens AS (SELECT source, e - n + i - 1 AS p, ids[i] AS token FROM placed2, unnest(range(1, len(ids) + 1)) AS u(i)), paired AS (SELECT source, p, token, lead(token) OVER (PARTITION BY source ORDER BY p) AS after FROM tokens),
ends AS (SELECT source, p + 1 AS e FROM paired WHERE token = 0 AND (after = 7 OR after IS NULL))
SELECT source, coalesce(lag(e) OVER (PARTITION BY source ORDER BY e), 0)::BIGINT AS "start", e AS "end" FROM ends""")
def c2_pair_boundaries(spark, sf):
    t = docs(spark, sf).select("source", "doc_id", F.concat(F.array(F.lit(7)), F.col("ids")).alias("ids"), (F.col("n") + 1).alias("n"))
    placed = documents.offsets(t, ["source"], "doc_id")
    heads = placed.select("source", F.col("start").alias("end"), F.get("ids", F.lit(0)).alias("follows"))
    followed = placed.join(heads, ["source", "end"], "left")
    places = F.explode(documents.pair_places(F.col("ids"), F.col("start"), F.col("follows"), 0, 7))
    return documents.boundaries(followed.select("source", places.alias("end")), ["source"])


@query(f"""{WHOLE} spaced AS (SELECT doc_id, list_transform(ids, lambda x: x = 32) AS m FROM rows_), marks AS (SELECT doc_id, i, m[i] AS t FROM spaced, unnest(range(1, len(m) + 1)) AS u(i)),
run AS (SELECT doc_id, t, i - row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS g, i FROM marks), runs AS (SELECT doc_id, t, min(i) - 1 AS low, max(i) AS high FROM run GROUP BY doc_id, t, g)
SELECT doc_id, count(*)::INT AS runs, arg_min(low, low) FILTER (t) ::INT AS first_start, arg_min(high, low) FILTER (t) ::INT AS first_end, max(low) FILTER (t) ::INT AS last_start, max(high) FILTER (t) ::INT AS last_end FROM runs GROUP BY doc_id""")
def j6_runs(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.transform("ids", lambda x: x == 32).alias("m"))
    runs = rows.withColumn("r", arrays.runs(F.col("m"))).withColumn("t", F.filter("r", lambda x: x["value"]))
    ends = [F.try_element_at("t", F.lit(k))[n].alias(f"{which}_{n}") for k, which in ((1, "first"), (-1, "last")) for n in ("start", "end")]
    return runs.select("doc_id", F.size("r").alias("runs"), *ends)


@query(f"""{CUT} parts AS (SELECT doc_id, ids, (i - 1)::INT AS part, [10, 30, 60][i] AS size, [0, 10, 40][i] AS low FROM rows_, unnest([1, 2, 3]) AS u(i)), cut AS (SELECT doc_id, part, ids[low + 1:low + size] AS c FROM parts)
SELECT doc_id, part, len(c)::INT AS size, coalesce({SUM.format('c')}, 0) AS checksum FROM cut""")
def j4_chunked(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.slice("ids", 1, 100).alias("ids"))
    parts = rows.select("doc_id", F.posexplode(arrays.chunked(F.col("ids"), [10, 30, 60])).alias("part", "c"))
    return parts.select("doc_id", "part", F.size("c").alias("size"), checksum(F.col("c")).alias("checksum"))


@query(f"{CUT} cut AS (SELECT doc_id, ids[1:16] AS c FROM rows_) SELECT doc_id, len(c)::INT AS size, {SUM.format('c')} AS checksum FROM cut")
def j3_truncated(spark, sf):
    cut = arrays.truncated(F.slice("ids", 1, 100), 16)
    return docs(spark, sf).select("doc_id", F.size(cut).alias("size"), checksum(cut).alias("checksum"))


@query("""WITH r AS (SELECT vec_id, unnest(list_transform(list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'x': -embedding[i], 'i': i - 1}))[1:2], lambda r: r.i)) AS expert FROM embeddings),
placed AS (SELECT vec_id, expert, row_number() OVER (PARTITION BY expert ORDER BY vec_id) - 1 AS place FROM r) SELECT vec_id, expert::INT AS expert, place, place < 16 AS kept FROM placed""")
def j9_gathered(spark, sf):
    picks = table(spark, sf, "embeddings").select("vec_id", F.explode(arrays.top_experts(F.col("embedding"), 2)).alias("expert"))
    return loading.gathered(picks, "expert", "vec_id", 16)


@query("""WITH r AS (SELECT vec_id, u.r.i AS expert, -u.r.x::DOUBLE AS w, embedding FROM embeddings, unnest(list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'x': -embedding[i], 'i': i - 1}))[1:2]) AS u(r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY expert ORDER BY vec_id) - 1 AS place FROM r) SELECT vec_id, sum(w * embedding[1]::DOUBLE) AS mixed FROM placed WHERE place < 16 GROUP BY vec_id""")
def j9_scattered(spark, sf):
    rows = table(spark, sf, "embeddings")
    picks = rows.select("vec_id", "embedding", F.explode(arrays.top_experts(F.col("embedding"), 2)).alias("expert"))
    picks = picks.select("vec_id", "expert", F.get("embedding", F.col("expert")).cast("double").alias("weight"), F.get("embedding", F.lit(0)).cast("double").alias("value"))
    return loading.scattered(loading.gathered(picks, "expert", "vec_id", 16).where("kept"), "vec_id", "mixed")


@query(f"""{CUT} padded AS (SELECT doc_id, list_concat(list_transform(range(0, 100 - len(ids)), lambda i: false), list_transform(ids, lambda x: x <> 101 OR doc_id % 3 > 0)) AS m FROM rows_)
SELECT doc_id, list_position(m, true) - 1 AS first, list_position(m, true) IS NOT NULL AND NOT list_contains(m[list_position(m, true):], false) AS left_padded FROM padded""")
def e6_left_padding(spark, sf):
    ids = F.slice("ids", 1, 100)
    mask = F.concat(F.array_repeat(F.lit(False), 100 - F.size(ids)), F.transform(ids, lambda x: (x != 101) | (F.col("doc_id") % 3 > 0)))
    first, valid = arrays.left_padding(F.col("m"))
    return docs(spark, sf).select("doc_id", mask.alias("m")).select("doc_id", first.alias("first"), valid.alias("left_padded"))


@query(f"""{TOK}, marks AS (SELECT doc_id, list_transform(ids, lambda x: x <> 32) AS m FROM docs)
SELECT docs.doc_id, len(list_filter(range(1, len(ids) + 1), lambda i: m[i]))::INT AS kept, list_sum(list_transform(list_filter(range(1, len(ids) + 1), lambda i: m[i]), lambda i: ids[i]))::BIGINT AS total FROM docs JOIN marks USING (doc_id)""")
def n6_masked_tokens(spark, sf):
    t = docs(spark, sf)
    masks = t.select("doc_id", F.transform("ids", lambda x: x != 32).alias("mask"))
    kept = instances.masked(t.select("doc_id", "ids"), masks, "doc_id").select("doc_id", F.expr("filter(arrays_zip(ids, mask), x -> x.mask)").alias("kept"))
    return kept.select("doc_id", F.size("kept").alias("kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x["ids"]).alias("total"))


SCHEDULE = [(0, 128), (5_000, 512), (40_000, 256)]


@query("""WITH RECURSIVE ranked AS (SELECT o_orderkey, (row_number() OVER (ORDER BY md5('1:1:' || o_orderkey), o_orderkey) - 1) * 8 AS place, count(*) OVER () * 8 AS total FROM orders),
walk(step, tokens, size) AS (SELECT 0::BIGINT, 0::BIGINT, 128::BIGINT UNION ALL SELECT step + 1, t, CASE WHEN want > size AND (t // size) % (want // size) <> 0 THEN size ELSE want END
  FROM (SELECT step, tokens + size AS t, size, CASE WHEN tokens + size >= 40000 THEN 256 WHEN tokens + size >= 5000 THEN 512 ELSE 128 END AS want FROM walk WHERE tokens + size < (SELECT count(*) * 8 FROM orders)))
SELECT o_orderkey, step AS batch, tokens, size AS batch_tokens, (place - tokens) // 8 AS slot, sqrt(size / 128) AS factor FROM ranked JOIN walk ON place >= tokens AND place < tokens + size WHERE tokens + size <= total""")
def p5_scheduled(spark, sf):
    rows = ordering.shuffled(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1, 1)
    return loading.scheduled_batches(rows, loading.segments(SCHEDULE), 8).drop("position")


@query(f"{BATCHED} SELECT 'steps' AS unit, batch, count(*) AS instances FROM plan WHERE batch < 7 GROUP BY batch UNION ALL SELECT 'tokens', batch, count(*) FROM plan WHERE batch * 64 < 900 GROUP BY batch")
def p10_until(spark, sf):
    whole = plan(spark, sf)
    parts = [loading.until(whole, steps=7).withColumn("unit", F.lit("steps")), loading.until(whole, tokens=900, batch_tokens=64).withColumn("unit", F.lit("tokens"))]
    return parts[0].unionByName(parts[1]).groupBy("unit", "batch").agg(F.count("*").alias("instances"))


@query(f"{BATCHED} SELECT o_orderkey, batch, slot::INT AS slot FROM plan WHERE batch < (SELECT least(200, count(*) // 64) FROM orders)")
def p1_streamed(spark, sf):
    rows = ordering.shuffled(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1, 1)
    cursor, folder = loading.Cursor(("orders",), 64, seed=1), f"{shared_dir(spark)}/loader-{uuid.uuid4().hex}"
    for stop in (70, 200):  # stops within a micro-batch, and goes on
        loader.run(rows, cursor, 64, folder, batches=50, stop=stop)
    return spark.read.schema("o_orderkey long, batch long, slot int, part int").parquet(f"{folder}/rows").drop("part")
