"""Queries of mixtures, samples, slices and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import documents, instances, mixing, ordering, sampling, trees
from millrace.plans.base import TOK, checksum, docs, query, sized
from millrace.sources.tables import table

RATIOS = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}


def sources(spark):
    rows = [(lang, rank, ratio, 4.0, 1.0) for rank, (lang, ratio) in enumerate(RATIOS.items())]
    return spark.createDataFrame(rows, "source string, rank int, ratio double, repetition double, fraction double")


def files(spark, sf):
    """Files of a mixture: a language is a source, a source of the table a file of it."""
    t = sized(spark, sf).groupBy(F.col("lang").alias("source"), F.col("source").alias("path")).agg(F.sum("n").alias("tokens"))
    return t.withColumn("path_idx", F.row_number().over(Window.partitionBy("source").orderBy("path")))


PLAN = TOK + """, ratios(source, rank, ratio) AS (VALUES ('en', 0, 0.4::DOUBLE), ('de', 1, 0.3), ('fr', 2, 0.2), ('es', 3, 0.1)),
files AS (SELECT lang AS source, source AS path, sum(n)::BIGINT AS tokens, row_number() OVER (PARTITION BY lang ORDER BY source) AS path_idx FROM docs GROUP BY lang, source),
pop AS (SELECT source, sum(tokens)::BIGINT AS population FROM files GROUP BY source),
asked AS (SELECT ratios.*, population, floor(sum(population) OVER () * 1.5)::BIGINT AS requested FROM ratios JOIN pop USING (source)),
needed AS (SELECT *, floor(requested * ratio)::BIGINT AS needed FROM asked),
passes AS (SELECT *, needed / population AS take, unnest(range(0, greatest(ceil(needed / population)::INT, 1)))::INT AS pass FROM needed),
paths AS (SELECT p.source, f.path, p.pass, p.population, p.needed, p.requested, f.tokens AS max_tokens, ceil(f.tokens * least(1.0, take - pass))::BIGINT AS tokens,
  row_number() OVER (ORDER BY rank, pass, path_idx) - 1 AS idx FROM passes p JOIN files f USING (source)),
base AS (SELECT *, max_tokens // 64 AS cap, least(tokens // 64, max_tokens // 64) AS b, (ceil(requested / 4096) * 64)::BIGINT AS need FROM paths),
one AS (SELECT *, b < cap AS room, greatest(need - sum(b) OVER (), 0) AS missing, count(*) FILTER (b < cap) OVER () AS eligible FROM base),
two AS (SELECT *, b + CASE WHEN room THEN least((missing // greatest(eligible, 1))::BIGINT, cap - b) ELSE 0 END AS b2 FROM one),
three AS (SELECT *, greatest(need - sum(b2) OVER (), 0) AS left_, room AND b2 < cap AS is_open FROM two),
four AS (SELECT *, row_number() OVER (PARTITION BY is_open ORDER BY (CASE WHEN room THEN tokens % 64 ELSE 0 END) DESC, idx DESC) AS k FROM three),
plan AS (SELECT *, (b2 + CASE WHEN is_open AND k <= left_ THEN 1 ELSE 0 END)::BIGINT AS instances FROM four)"""


def plan(spark, sf):
    requested = F.floor(F.sum("population").over(Window.partitionBy()) * 1.5)  # a row a source
    return mixing.mixture_plan(sources(spark), files(spark, sf), requested, 4096, 64)


@query(f"{PLAN} SELECT source, path, pass, idx, population, needed, max_tokens, instances, instances * 64 AS tokens, greatest(need - sum(instances) OVER (), 0)::BIGINT AS shortfall FROM plan")
def f2_mixture_plan(spark, sf):
    return plan(spark, sf)


@query(f"""{PLAN}, by_source AS (SELECT source, max(population) AS population, sum(instances * 64)::BIGINT AS tokens, (max(pass) + 1)::INT AS passes FROM plan GROUP BY source)
SELECT source, population, tokens, passes, ratio AS target, tokens / sum(tokens) OVER () AS share, abs(tokens / sum(tokens) OVER () - ratio) AS difference FROM by_source JOIN ratios USING (source)""")
def f4_mixture_report(spark, sf):
    return mixing.mixture_report(plan(spark, sf), sources(spark))


MIXED = """, placed2 AS (SELECT lang, source, ids, sum(n) OVER (PARTITION BY lang, source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM docs),
cells AS (SELECT lang, source, e - len(ids) + i - 1 AS p, ids[i] AS token FROM placed2, unnest(range(1, len(ids) + 1)) AS u(i)),
chunks AS (SELECT lang, source, p // 64 AS instance, sum((p % 64 + 1) * token)::BIGINT AS checksum FROM cells GROUP BY ALL HAVING count(*) = 64)"""


@query(f"""{PLAN}{MIXED}, based AS (SELECT *, coalesce(sum(instances) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM plan)
SELECT based.source AS lang, path AS source, instance, idx, base + instance AS "index", checksum FROM based JOIN chunks ON chunks.lang = based.source AND chunks.source = path AND instance < instances""")
def d4_mixture_instances(spark, sf):
    chunks = instances.concat_and_chunk(docs(spark, sf), 64, ["lang", "source"], "doc_id")
    chunks = chunks.select("lang", "source", "instance", checksum(F.col("input_ids")).alias("checksum"))
    quotas = plan(spark, sf).withColumnsRenamed({"source": "lang", "path": "source"})
    return mixing.mixture_instances(chunks, quotas, ["lang", "source"]).select("lang", "source", "instance", "idx", "index", "checksum")


def whole_sources(spark, sf):
    """A range a source: all its tokens."""
    t = sized(spark, sf).groupBy("source").agg(F.sum("n").alias("end"))
    return t.select("source", F.lit(0).alias("index"), F.lit(0).cast("long").alias("start"), "end")


RANGES = """, whole AS (SELECT source, sum(n)::BIGINT AS n FROM docs GROUP BY source), total AS (SELECT sum(n)::BIGINT AS total FROM whole),
tokens AS (SELECT source, "start" + i - 1 AS p, ids[i] AS token FROM docs, unnest(range(1, len(ids) + 1)) AS u(i))"""


@query(f"""{TOK}{RANGES}, want AS (SELECT source, n, round_even(((total * 5) // 4) * n / total, 0)::BIGINT AS w FROM whole, total),
cut AS (SELECT source, n, w, k AS "copy", least(n, w - k * n) AS size FROM want, unnest(range(0, (w - 1) // n + 1)) AS u(k) WHERE w > 0)
SELECT cut.source, "copy", 0::BIGINT AS "start", size AS "end", sum((p + 1) * token)::BIGINT AS checksum FROM cut JOIN tokens ON tokens.source = cut.source AND p < size GROUP BY ALL""")
def f5_sample_tokens(spark, sf):
    total = F.sum(F.col("end")).over(Window.partitionBy())  # a row a source
    found = sampling.sample_tokens(whole_sources(spark, sf).withColumn("n_all", total), F.expr("n_all * 5 div 4"))
    found = found.drop("n_all")
    pieces = sampling.read_ranges(found, documents.offsets(docs(spark, sf).select("source", "doc_id", "n", "ids"), ["source"], "doc_id"), ["source"])
    sums = pieces.select("source", "copy", "start", "end", (checksum(F.col("ids")) + F.col("at") * F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("c"))
    return sums.groupBy("source", "copy", "start", "end").agg(F.sum("c").alias("checksum"))


@query(f"""{TOK}, plan AS (SELECT lang, sum(n)::BIGINT AS size, CASE lang WHEN 'en' THEN 0.4 WHEN 'de' THEN 0.3 WHEN 'fr' THEN 0.2 ELSE 0.1 END::DOUBLE AS ratio, 1.5::DOUBLE AS repetition FROM docs GROUP BY lang),
want AS (SELECT *, sum(size) OVER ()::DOUBLE * ratio / sum(ratio) OVER () AS w FROM plan), used AS (SELECT *, least(repetition, greatest(w / size, 1.0)) AS u FROM want),
sized AS (SELECT lang, floor(w * least(1.0, min(size * u / w) OVER ()))::BIGINT AS sample FROM used), parts AS (SELECT lang, source, sum(n)::BIGINT AS n FROM docs GROUP BY ALL),
wanted AS (SELECT lang, source, n, round_even(sample * n / sum(n) OVER (PARTITION BY lang), 0)::BIGINT AS w FROM parts JOIN sized USING (lang)),
cut AS (SELECT lang, source, k AS "copy", least(n, w - k * n) AS size FROM wanted, unnest(range(0, (w - 1) // n + 1)) AS u(k) WHERE w > 0)
SELECT lang, source, "copy", size AS tokens, coalesce(sum(size) OVER (ORDER BY lang, source, "copy" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM cut""")
def f8_mixed_tokens(spark, sf):
    t = sized(spark, sf)
    ratio = F.when(F.col("lang") == "en", 0.4).when(F.col("lang") == "de", 0.3).when(F.col("lang") == "fr", 0.2).otherwise(0.1)
    sizes = mixing.sample_sizes(t.groupBy("lang").agg(F.sum("n").alias("size")).withColumn("ratio", ratio).withColumn("repetition", F.lit(1.5))).select("lang", "sample")
    ranges = t.groupBy("lang", "source").agg(F.sum("n").alias("end")).withColumn("start", F.lit(0).cast("long")).withColumn("index", F.col("source")).join(sizes, "lang")
    found = sampling.concatenated(sampling.sample_tokens(ranges, F.col("sample"), ["lang"]), ["lang", "source", "copy"])
    return found.select("lang", "source", "copy", (F.col("end") - F.col("start")).alias("tokens"), "offset")


CHUNKS = """, sized AS (SELECT source, sum(n)::BIGINT // 64 AS n FROM docs GROUP BY source),
inst AS (SELECT source, i AS instance, row_number() OVER (PARTITION BY source ORDER BY md5('5:1:' || source || ':' || i), i) - 1 AS position FROM sized, unnest(range(0, n)) AS u(i))"""


def instance_rows(spark, sf, index=None):
    sizes = sized(spark, sf).groupBy("source").agg(F.expr("sum(n) div 64").alias("n")).where("n > 0")
    return instances.numbered(sizes, ["source"], index=index), sizes


@query(f"""{TOK}{CHUNKS}, want AS (SELECT source, n, floor(3000.0::DOUBLE * n / sum(n) OVER ())::BIGINT AS w FROM sized), chunked AS (SELECT source, n, w - w % 4 AS w FROM want)
SELECT inst.source, instance, unnest(range(0, (w - 1 - position) // n + 1)) AS "copy" FROM inst JOIN chunked USING (source) WHERE position < w""")
def f7_sample_instances(spark, sf):
    rows, sizes = instance_rows(spark, sf)
    placed = sampling.shuffled_within(rows, ["source"], "instance", 5, 1)
    return sampling.sample_instances(placed, ["source"], sizes, F.lit(3000.0), 4).select("source", "instance", "copy")


@query(f"""{TOK}, n AS (SELECT count(*) AS n FROM docs), base AS (SELECT doc_id, source, n, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM docs)
SELECT d AS draw, doc_id, base.n AS n FROM n, unnest(range(0, 500)) AS u(d) JOIN base ON base.r = ('0x' || left(md5('9:0:' || d), 8))::BIGINT % n.n""")
def f10_drawn_documents(spark, sf):
    t = sized(spark, sf).select("doc_id", "n").withColumn("one", F.lit(1)).withColumn("all", F.lit(0))
    ranked = documents.running_sum(t, ["all"], "doc_id", "one", "r").withColumn("r", F.col("r") - 1).select("doc_id", "n", "r")
    return sampling.drawn(ranked, F.count("*"), 500, 9, "r").select("draw", "doc_id", "n")


@query(f"""{TOK}{RANGES} SELECT source, 0 AS part, 0::BIGINT AS "start", floor(n * 0.8::DOUBLE)::BIGINT AS "end" FROM whole UNION ALL SELECT source, 1, floor(n * 0.8::DOUBLE)::BIGINT, n FROM whole""")
def g5_split_tokens(spark, sf):
    return sampling.split_tokens(whole_sources(spark, sf), 0.8).select("source", "part", "start", "end")


@query(f"""{TOK}{RANGES} SELECT source, 'tail' AS cut, greatest(n - 1000, 0) AS "start", n AS "end" FROM whole UNION ALL SELECT source, 'open', least(500, n), n FROM whole UNION ALL SELECT source, 'short', least(10, n), n - 10 FROM whole""")
def g3_open_slices(spark, sf):
    whole = whole_sources(spark, sf)
    cuts = {"tail": (-1000, None), "open": (500, None), "short": (10, -10)}
    parts = [sampling.sliced(whole, F.col("end"), low, high).select("source", F.lit(name).alias("cut"), "start", "end") for name, (low, high) in cuts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SPLIT = """, n AS (SELECT count(*) AS n FROM {0}), cut AS (SELECT n, (floor(floor(n * 64 * 0.75::DOUBLE) / 256) * 4)::BIGINT AS c FROM n),
split AS (SELECT source, instance, position, (position >= c)::INT AS part, CASE WHEN position < c THEN position ELSE position - c END AS "index", CASE WHEN position < c THEN c ELSE n - c END AS size FROM {0}, cut)
SELECT source, instance, part, "index" FROM split WHERE "index" < size - size % 4"""


@query(f"{TOK}{CHUNKS}, dense AS (SELECT source, instance, row_number() OVER (ORDER BY source, instance) - 1 AS position FROM inst)" + SPLIT.format("dense"))
def g6_split_instances(spark, sf):
    placed, sizes = instance_rows(spark, sf, "position")
    return sampling.split_instances(placed, sizes.agg(F.sum("n")).scalar(), 0.75, 64, 256).select("source", "instance", "part", "index")


@query(f"""{TOK}{CHUNKS}, dense AS (SELECT source, instance, row_number() OVER (ORDER BY source, instance) - 1 AS i FROM inst),
unit AS (SELECT u, row_number() OVER (ORDER BY md5('4:1:' || u), u) - 1 AS place FROM (SELECT DISTINCT i // 4 AS u FROM dense WHERE i < (SELECT count(*) // 4 * 4 FROM dense))),
moved AS (SELECT source, instance, place * 4 + i % 4 AS position FROM dense JOIN unit ON i // 4 = u)""" + SPLIT.format("moved"))
def g7_random_split(spark, sf):
    dense, sizes = instance_rows(spark, sf, "index")
    total = sizes.agg(F.sum("n")).scalar()
    whole = dense.withColumn("n", total).where("index < n - n % 4").drop("n")
    placed = ordering.shuffled(whole, "index", 4, 1, chunk=4).drop("index")
    return sampling.split_instances(placed, total - total % 4, 0.75, 64, 256).select("source", "instance", "part", "index")


@query(f"""{TOK}{CHUNKS}, dense AS (SELECT source, instance, row_number() OVER (ORDER BY source, instance) - 1 AS i FROM inst) SELECT source, instance, i - 100 AS "index" FROM dense WHERE i >= 100 AND i < 1100""")
def g4_slice_instances(spark, sf):
    placed, _ = instance_rows(spark, sf, "position")
    return sampling.slice_instances(placed, 100, 1103, 4).select("source", "instance", "index")


@query(f"""{TOK}{CHUNKS}, dense AS (SELECT source, instance, row_number() OVER (ORDER BY source, instance) - 1 AS i FROM inst)
SELECT o_orderkey, source, instance FROM orders JOIN dense ON i = o_orderkey""")
def n1_locate(spark, sf):
    _, sizes = instance_rows(spark, sf)
    rows = table(spark, sf, "orders").select("o_orderkey")
    return sampling.locate(rows, "o_orderkey", sizes, ["source"], "n").select("o_orderkey", "source", F.col("local").alias("instance"))


@query(f"""{TOK}, wide AS (SELECT source, doc_id, "start", "end" FROM docs), cuts AS (SELECT source, i * 5000 AS low, i * 5000 + 700 AS high FROM (SELECT DISTINCT source FROM docs), unnest(range(0, 40)) AS u(i))
SELECT wide.source, doc_id, low, greatest("start", low) AS "start", least("end", high) AS "end" FROM wide JOIN cuts ON wide.source = cuts.source AND "start" < high AND "end" > low""")
def n2_overlaps(spark, sf):
    placed = documents.offsets(docs(spark, sf).select("source", "doc_id", "n", "ids"), ["source"], "doc_id")
    cuts = placed.select("source").distinct().select("source", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i")).select("source", (F.col("i") * 5000).cast("long").alias("start"), (F.col("i") * 5000 + 700).cast("long").alias("end"))
    met = sampling.read_ranges(cuts, placed, ["source"], keep=("doc_id",))
    first = F.col("start") + F.col("at")
    return met.select("source", "doc_id", F.col("start").alias("low"), first.alias("start"), (first + F.size("ids")).alias("end"))


@query("""SELECT o_orderkey AS instance, sum((j + 1) * CASE WHEN d % 50 = 0 THEN 0 ELSE (d // 50) % 1000 END)::BIGINT AS checksum
FROM (SELECT o_orderkey, j, ('0x' || left(md5('3:0:' || (o_orderkey * 32 + j)), 8))::BIGINT AS d FROM orders, unnest(range(0, 32)) AS b(j)) GROUP BY o_orderkey""")
def a12_random_instances(spark, sf):
    rows = sampling.random_ids(table(spark, sf, "orders").select(F.col("o_orderkey").alias("index")), 32, 1000, 3, 0, 50)
    return rows.select(F.col("index").alias("instance"), checksum(F.col("input_ids")).alias("checksum"))


def tree(spark, sf):
    """Sources of odd places sampled up and mixed with the others as one stream, sampled again, and sliced."""
    sizes = sized(spark, sf).groupBy("source").agg(F.sum("n").alias("tokens")).withColumn("rank", F.row_number().over(Window.orderBy("source")) - 1)  # a row a source
    odd, even = (trees.leaves(sizes.where(F.col("rank") % 2 == k), "source", "tokens", "rank") for k in (1, 0))
    mixed = trees.mix([(trees.resized(odd, 1.25), 0.5, 2.0), (trees.concat(even), 0.5, 1.0)])
    return trees.sliced(trees.sample([mixed], 150_000), 5_000, -1_000)


TREE = """, ranked AS (SELECT source, sum(n)::BIGINT AS n, row_number() OVER (ORDER BY source) - 1 AS rank FROM docs GROUP BY source),
odd AS (SELECT *, sum(n) OVER ()::BIGINT AS total FROM ranked WHERE rank % 2 = 1), up AS (SELECT *, round_even(floor(total * 1.25::DOUBLE) * (n::DOUBLE / total), 0)::BIGINT AS w FROM odd),
odd1 AS (SELECT source, [rank, k] AS unit, least(n, w - k * n) AS n FROM up, unnest(range(0, (w - 1) // n + 1)) AS u(k) WHERE w > 0),
even AS (SELECT source, rank, n, sum(n) OVER (ORDER BY rank)::BIGINT - n AS off, sum(n) OVER ()::BIGINT AS size FROM ranked WHERE rank % 2 = 0),
size AS (SELECT a, b, (a + b)::DOUBLE * 0.5 AS w FROM (SELECT (SELECT sum(n)::BIGINT FROM odd1) AS a, (SELECT max(size) FROM even) AS b)),
used AS (SELECT w, a * least(2.0, greatest(w / a, 1.0)) AS x, b * least(1.0, greatest(w / b, 1.0)) AS y FROM size), took AS (SELECT floor(w * least(1.0, x / w, y / w))::BIGINT AS most FROM used),
odd2 AS (SELECT source, unit, n, round_even(most * (n::DOUBLE / sum(n) OVER ()), 0)::BIGINT AS w FROM odd1, took),
part1 AS (SELECT source, [0] || unit || [k] AS unit, 0::BIGINT AS place, least(n, w - k * n) AS n FROM odd2, unnest(range(0, (w - 1) // n + 1)) AS u(k) WHERE w > 0),
part2 AS (SELECT source, [1, k] AS unit, rank AS place, least(n, greatest(most - k * size - off, 0)) AS n FROM even, took, unnest(range(0, (most - 1) // size + 1)) AS u(k) WHERE off < most - k * size),
units AS (SELECT unit, sum(n)::BIGINT AS size FROM (FROM part1 UNION ALL FROM part2) GROUP BY unit), wanted AS (SELECT unit, size, round_even(150000 * (size::DOUBLE / sum(size) OVER ()), 0)::BIGINT AS w FROM units),
pieces AS (SELECT source, unit, place, n, sum(n) OVER (PARTITION BY unit ORDER BY place)::BIGINT - n AS off FROM (FROM part1 UNION ALL FROM part2)),
again AS (SELECT source, unit, k, place, least(n, w - k * size - off) AS n FROM pieces JOIN wanted USING (unit), unnest(range(0, (w - 1) // size + 1)) AS u(k) WHERE w > 0 AND off < w - k * size),
flat AS (SELECT source, n, sum(n) OVER (ORDER BY unit, k, place)::BIGINT - n AS off, sum(n) OVER ()::BIGINT AS total FROM again),
cut AS (SELECT source, greatest(off, 5000) - off AS s, least(off + n, total - 1000) - off AS e, greatest(off, 5000) - 5000 AS o FROM flat WHERE off + n > 5000 AND off < total - 1000)"""


@query(f"""{TOK}{TREE} SELECT row_number() OVER (ORDER BY o) - 1 AS "index", source, s::BIGINT AS "start", e::BIGINT AS "end", o::BIGINT AS "offset" FROM cut""")
def g1_tree(spark, sf):
    return trees.plan(tree(spark, sf)).withColumnRenamed("leaf", "source")


@query(f"""{TOK}{RANGES}{TREE} SELECT o::BIGINT AS "offset", cut.source, sum((p - s + 1) * token)::BIGINT AS checksum FROM cut JOIN tokens ON tokens.source = cut.source AND p >= s AND p < e GROUP BY ALL""")
def g1_tree_tokens(spark, sf):
    placed = documents.offsets(docs(spark, sf).select("source", "doc_id", "n", "ids"), ["source"], "doc_id")
    pieces = sampling.read_ranges(trees.plan(tree(spark, sf)).withColumnRenamed("leaf", "source"), placed, ["source"])
    sums = pieces.select("offset", "source", (checksum(F.col("ids")) + F.col("at") * F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("c"))
    return sums.groupBy("offset", "source").agg(F.sum("c").alias("checksum"))


@query(f"""{TOK}, parts AS (SELECT doc_id, n, lang = 'en' AS a FROM docs), size AS (SELECT sum(n) FILTER (a)::BIGINT AS x, sum(n) FILTER (NOT a)::BIGINT AS y FROM parts), w AS (SELECT *, (x + y)::DOUBLE * 0.7::DOUBLE / (0.7::DOUBLE + 0.3::DOUBLE) AS p, (x + y)::DOUBLE * 0.3::DOUBLE / (0.7::DOUBLE + 0.3::DOUBLE) AS q FROM size),
used AS (SELECT *, least(1.0, x * least(2.0, greatest(p / x, 1.0)) / p, y * least(1.0, greatest(q / y, 1.0)) / q) AS f FROM w), most AS (SELECT x, y, floor(p * f)::BIGINT AS s, floor(q * f)::BIGINT AS t FROM used),
summed AS (SELECT doc_id, n, a, sum(n) OVER (PARTITION BY a ORDER BY doc_id)::BIGINT AS upto FROM parts), sized AS (SELECT summed.*, CASE WHEN a THEN s ELSE t END AS most, CASE WHEN a THEN x ELSE y END AS total FROM summed, most),
taken AS (SELECT doc_id, n, a, upto, k AS "copy" FROM sized, unnest(range(0, most // total + (upto <= most % total)::BIGINT)) AS u(k))
SELECT row_number() OVER (ORDER BY NOT a, "copy", upto) - 1 AS "index", doc_id, "copy"::INT AS "copy", sum(n) OVER (ORDER BY NOT a, "copy", upto)::BIGINT - n AS "start" FROM taken""")
def g2_tree_documents(spark, sf):
    t = sized(spark, sf).select("doc_id", "lang", "n")
    nodes = [trees.rows_of(t.where(where).select("doc_id", "n"), ["doc_id"]) for where in ("lang = 'en'", "lang <> 'en'")]
    mixed = trees.mix_documents([(nodes[0], 0.7, 2.0), (nodes[1], 0.3, 1.0)])
    return trees.numbered(mixed, {"end": "n"}).select("index", "doc_id", "copy", (F.col("end") - F.col("n")).alias("start"))


@query(f"""{TOK}{CHUNKS}, parts AS (SELECT source, instance, source < 'src10' AS a FROM inst), size AS (SELECT count(*) FILTER (a) AS x, count(*) FILTER (NOT a) AS y FROM parts), w AS (SELECT *, (x + y) * 64 * 0.5::DOUBLE AS p FROM size),
used AS (SELECT *, least(1.0, x * 64 * least(1.5, greatest(p / (x * 64), 1.0)) / p, y * 64 * least(1.5, greatest(p / (y * 64), 1.0)) / p) AS f FROM w), most AS (SELECT x, y, floor(p * f)::BIGINT // 64 AS m FROM used),
ranks AS (SELECT source, instance, a, row_number() OVER (PARTITION BY a ORDER BY source, instance) AS upto FROM parts), sized2 AS (SELECT ranks.*, m - m % 4 AS most, CASE WHEN a THEN x ELSE y END AS total FROM ranks, most),
taken AS (SELECT source, instance, a, upto, k AS "copy" FROM sized2, unnest(range(0, most // total + (upto <= most % total)::BIGINT)) AS u(k))
SELECT row_number() OVER (ORDER BY NOT a, "copy", upto) - 1 AS "index", source, instance, "copy"::INT AS "copy" FROM taken""")
def g2_tree_instances(spark, sf):
    rows, sizes = instance_rows(spark, sf)
    ranks = F.broadcast(sizes.select("source", (F.row_number().over(Window.orderBy("source")) - 1).alias("rank")))  # a row a source
    nodes = [trees.rows_of(rows.where(where).join(ranks, "source"), ["rank", "instance"]).drop("rank") for where in ("source < 'src10'", "source >= 'src10'")]
    return trees.numbered(trees.mix_instances([(nodes[0], 0.5, 1.5), (nodes[1], 0.5, 1.5)], 64, chunk=4)).select("index", "source", "instance", "copy")
