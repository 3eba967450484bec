"""Token ranges and instances: sampled, mixed, concatenated, sliced and split.

A token source is a table of ranges (``by``, ``index``, ``start``, ``end``) over streams of documents, read in the order of
``index``. Plans have a row a range, so their windows are small; tokens are read by ``read_ranges`` at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.intervals import within
from millrace.operators.sums import global_position, hash_order, sorted_sums

#: Width of the grid on which ranges meet documents.
GRID = 4096


def sample_tokens(ranges: DataFrame, most: Column, by: list[str] | None = None, seed: int | None = None) -> DataFrame:
    """So many tokens of all ranges (of each ``by``), from each in proportion to its length: whole copies, then a part.

    The part is the range's beginning, or with a seed begins where a hash says. Adds ``copy``. A source that was sampled
    before is given by its ranges, so samples of samples need no tokens in between. Shares are rounded half to even.
    """
    group = Window.partitionBy(*(by or []))
    t = ranges.withColumn("_n", F.col("end") - F.col("start")).where("_n > 0")
    t = t.withColumn("_want", F.bround(most * F.col("_n") / F.sum("_n").over(group)).cast("long")).where("_want > 0")
    t = t.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_want - 1) div _n"))))
    size = F.least("_n", F.col("_want") - F.col("copy") * F.col("_n"))
    at = F.lit(0) if seed is None else F.conv(F.left(hash_order(seed, 0, F.concat_ws(":", *(by or []), "index")), F.lit(8)), 16, 10).cast("long") % (F.col("_n") - size + 1)
    return t.withColumn("start", F.col("start") + at).withColumn("end", F.col("start") + size).drop("_n", "_want")


def concatenated(ranges: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``offset``, the place of each range in the one stream that all make, in the order of ``order``."""
    placed = sorted_sums(ranges.withColumn("_n", F.col("end") - F.col("start")), [], order, {"_upto": "_n"})
    return placed.withColumn("offset", F.col("_upto") - F.col("_n")).drop("_upto", "_n")


def read_ranges(ranges: DataFrame, docs: DataFrame, by: list[str], ids: str = "ids", keep: tuple[str, ...] = (), grid: int = GRID) -> DataFrame:
    """Pieces of the ranges: their columns, ``at`` (place in the range) and ``ids``, one a document that the range meets, and ``keep`` of it.

    Ranges and documents (``by``, start, end, ids) meet in cells of a grid, so the join is by key.
    """
    cell = F.explode(F.sequence(F.expr(f"start div {grid}"), F.expr(f"(end - 1) div {grid}")))
    left = ranges.where("end > start").withColumn("_cell", cell)
    right = docs.select(*by, F.col("start").alias("_low"), F.col("end").alias("_high"), F.col(ids).alias("_ids"), cell.alias("_cell"), *keep)
    low, high = F.greatest("start", "_low"), F.least("end", "_high")
    met = left.join(right, [*by, "_cell"]).where((low < high) & (F.col("_cell") == F.floor(low / grid)))
    piece = F.slice("_ids", (low - F.col("_low") + 1).cast("int"), (high - low).cast("int"))
    return met.select(*ranges.columns, (low - F.col("start")).alias("at"), piece.alias("ids"), *keep)


def sliced(ranges: DataFrame, n: Column, low: int | None = None, high: int | None = None) -> DataFrame:
    """The tokens [low, high) of each range of ``n`` tokens, ends counted as in Python; none left is an error."""
    end = lambda x, default: F.lit(default) if x is None else F.lit(x) if x >= 0 else F.greatest(n + x, F.lit(0))
    first = F.least(end(low, 0), n)
    last = n if high is None else F.least(end(high, 0), n)
    message = F.concat(F.lit("empty slice of "), n.cast("string"), F.lit(" tokens"))
    size = F.when(last > first, last - first).otherwise(F.raise_error(message).cast("long"))
    return ranges.withColumn("_at", F.col("start") + first).withColumn("end", F.col("_at") + size).withColumn("start", F.col("_at")).drop("_at")


def split_tokens(ranges: DataFrame, ratio: float) -> DataFrame:
    """Two ranges of each: ``part`` 0 has the given share of the tokens, rounded down."""
    cut = F.col("start") + F.floor((F.col("end") - F.col("start")) * ratio)
    parts = F.array(F.struct(F.lit(0).alias("part"), F.col("start").alias("start"), cut.alias("end")), F.struct(F.lit(1).alias("part"), cut.alias("start"), F.col("end").alias("end")))
    others = [c for c in ranges.columns if c not in ("start", "end")]
    return ranges.select(*others, F.explode(parts).alias("p")).select(*others, "p.*")


def split_instances(rows: DataFrame, total: Column, ratio: float, size: int, most: int, position: str = "position") -> DataFrame:
    """Adds ``part`` and ``index`` in it: part 0 has the share of tokens, cut where ``most`` tokens are whole.

    ``total`` is the number of instances, such as a scalar subquery. Random splits give a shuffled position.
    """
    chunk = most // size
    cut = F.floor(F.floor(F.col("n") * size * ratio) / most) * chunk
    t = rows.withColumn("n", total).withColumn("_cut", cut)
    t = t.withColumn("part", (F.col(position) >= F.col("_cut")).cast("int")).withColumn("index", F.when(F.col("part") == 0, F.col(position)).otherwise(F.col(position) - F.col("_cut")))
    size_of = F.when(F.col("part") == 0, F.col("_cut")).otherwise(F.col("n") - F.col("_cut"))
    return t.where(F.col("index") < size_of - size_of % chunk).drop("n", "_cut")


def slice_instances(rows: DataFrame, low: int, high: int, chunk: int = 1, position: str = "position") -> DataFrame:
    """Instances at the places [low, high) of an order, in whole chunks; adds ``index``."""
    end = high - (high - low) % chunk
    return rows.where((F.col(position) >= low) & (F.col(position) < end)).withColumn("index", F.col(position) - low)


def sample_instances(rows: DataFrame, by: list[str], sizes: DataFrame, most: Column, chunk: int = 1, position: str = "position") -> DataFrame:
    """So many instances of all sources, of each in proportion to its size, in whole chunks: copies, then the first of an order.

    ``sizes`` has a row (by, n) a source; ``position`` is dense within one. Adds ``copy``.
    """
    want = F.floor(most * F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row a source
    plan = sizes.withColumn("_want", want - want % chunk)
    t = rows.join(plan, by).where(F.col(position) < F.col("_want"))
    copies = F.sequence(F.lit(0).cast("long"), F.expr(f"(_want - 1 - {position}) div n"))
    return t.withColumn("copy", F.explode(copies)).drop("n", "_want")


def shuffled_within(rows: DataFrame, by: list[str], index: str, seed: int, epoch: int, name: str = "position") -> DataFrame:
    """Adds ``position``, a shuffle of each source's rows by a hash of its name and the index."""
    keyed = rows.withColumn("_key", hash_order(seed, epoch, F.concat_ws(":", *by, index)))
    return global_position(keyed, "_key", index, name, by).drop("_key")


def drawn(rows: DataFrame, n: Column, draws: int, seed: int, index: str) -> DataFrame:
    """Draws with replacement: (draw, index) for each of so many draws, joined to rows of a dense index; ``n`` is their number."""
    spark = rows.sparkSession
    pick = F.conv(F.left(hash_order(seed, 0, F.col("draw")), F.lit(8)), 16, 10).cast("long")
    picks = spark.range(draws).withColumnRenamed("id", "draw").withColumn(index, pick % rows.agg(n).scalar())
    return picks.join(rows, index)


def random_ids(rows: DataFrame, size: int, vocabulary: int, seed: int, end: int, mean: int, index: str = "index") -> DataFrame:
    """Adds ``input_ids``: ids by a hash of the place in the stream, an end about every ``mean`` tokens.

    A token depends on its place only, so shorter or longer instances cut the same stream.
    """
    place = F.sequence(F.col(index) * size, F.col(index) * size + size - 1)

    def token(p: Column) -> Column:
        draw = F.conv(F.left(hash_order(seed, 0, p), F.lit(8)), 16, 10).cast("long")
        return F.when(draw % mean == 0, F.lit(end).cast("long")).otherwise(F.floor(draw / mean) % vocabulary)

    return rows.withColumn("input_ids", F.transform(place, token))


def locate(rows: DataFrame, index: str, sources: DataFrame, by: list[str], size: str = "size") -> DataFrame:
    """Source and place in it of global indices, by the sizes of sources one after another; indices beyond all are left out.

    Sources' offsets are sums over sorted ranges and indices meet them in a grid, so there may be any number of sources.
    """
    ends = sorted_sums(sources.select(*by, size).where(F.col(size) > 0), [], by, {"_end": size})
    bounds = ends.select(*by, (F.col("_end") - F.col(size)).alias("_low"), (F.col("_end") - 1).alias("_last"))
    return within(rows, index, bounds, [], "_low", "_last").withColumn("local", F.col(index) - F.col("_low")).drop("_low", "_last")
