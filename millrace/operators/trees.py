"""Trees of sources: concatenated, sliced, repeated, sampled and mixed, and brought to one plan before any token is read.

A tree of token sources is a table of pieces, a row a range of a leaf's stream. Pieces belong to units, which are what
sampling takes in proportion to their sizes: a leaf is one, what is concatenated or sliced is one, and samples and mixtures
hand on the units that they took, so a sample of a sample keeps the shares of what is below. ``unit`` and ``at`` are arrays of
numbers whose order is the order of the tree, so nodes are put beside each other by a prefix and nothing is numbered anew.

Trees of documents and of instances are tables of these, in the order of ``at``; sums run over sorted ranges.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.mixing import sample_sizes
from millrace.operators.sums import hash_order, sorted_sums
from millrace.sources.shared import written


@dataclass
class Tokens:
    """Pieces (unit, at, depth, leaf, start, end); ``flat`` if every unit is one piece."""

    pieces: DataFrame
    flat: bool


def _long(*values) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(v)).cast("long") for v in values])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def leaves(sizes: DataFrame, leaf: str, tokens: str, rank: str) -> Tokens:
    """A unit for each stream of so many tokens, in the order of ``rank``."""
    rows = written(sizes.where(F.col(tokens) > 0).select(leaf, tokens, rank), "leaves")  # sizes are counted once
    return Tokens(rows.select(_long(F.col(rank)).alias("unit"), _long(0).alias("at"), F.lit(0).alias("depth"), F.col(leaf).alias("leaf"), F.lit(0).cast("long").alias("start"), F.col(tokens).cast("long").alias("end")), True)


def concat(*nodes: Tokens) -> Tokens:
    """One unit of all units, one after another."""
    parts = [n.pieces.withColumn("at", F.concat(_long(k), "unit", "at")) for k, n in enumerate(nodes)]
    return Tokens(_union(parts).withColumns({"unit": _long(0), "depth": F.lit(0)}), False)


def _offsets(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``_n`` and ``_off``, a piece's place among those of the same ``by``."""
    summed = sorted_sums(pieces.withColumn("_n", F.col("end") - F.col("start")), by, ["at"], {"_upto": "_n"})
    return summed.withColumn("_off", F.col("_upto") - F.col("_n")).drop("_upto")


def _cut(pieces: DataFrame, low: Column, high: Column) -> DataFrame:
    """Pieces cut to the places [low, high) of their unit."""
    first, last = F.greatest("_off", low), F.least(F.col("_off") + F.col("_n"), high)
    kept = pieces.withColumns({"_a": F.col("start") + first - F.col("_off"), "_b": F.col("start") + last - F.col("_off")}).where("_a < _b")
    return kept.withColumns({"start": F.col("_a"), "end": F.col("_b")}).drop("_a", "_b")


def sliced(node: Tokens, low: int | None = None, high: int | None = None) -> Tokens:
    """The tokens [low, high) of the node's stream as one unit, ends counted as in Python; none left is an error."""
    whole = _offsets(concat(node).pieces, ["unit"])
    total = node.pieces.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).scalar()
    end = lambda x, default: default if x is None else F.least(F.lit(x), total) if x >= 0 else F.greatest(total + x, F.lit(0))
    first, last = end(low, F.lit(0)), end(high, total)
    last = F.when(last > first, last).otherwise(F.raise_error(F.lit("empty slice")).cast("long"))
    return Tokens(_cut(whole, first, last).drop("_n", "_off"), False)


def _sampled(pieces: DataFrame, flat: bool, seed: int | None, prefix: list) -> DataFrame:
    """Of each group ``_g``, ``_most`` tokens, from each unit in proportion to its size: whole copies, then a part of one."""
    if flat:
        sized = pieces.withColumns({"_n": F.col("end") - F.col("start"), "_off": F.lit(0).cast("long")}).withColumn("_size", F.col("_n"))
    else:
        placed = _offsets(pieces, ["_g", "_i", "depth", "unit"])
        sized = placed.join(placed.groupBy("_g", "_i", "depth", "unit").agg(F.sum("_n").alias("_size")), ["_g", "_i", "depth", "unit"])
    totals = pieces.groupBy("_g").agg(F.sum(F.col("end") - F.col("start")).alias("_total"))
    t = sized.join(totals, "_g").withColumn("_want", F.bround(F.col("_most") * (F.col("_size") / F.col("_total"))).cast("long")).where("_want > 0")
    t = t.withColumns({"_rest": F.col("_want") % F.col("_size"), "_whole": F.expr("_want div _size")})
    t = t.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("_whole - if(_rest > 0, 0, 1)"))))
    drawn = F.conv(F.left(hash_order(seed or 0, 0, F.concat_ws(":", F.concat(_long(F.col("_g"), F.col("_i"), F.col("depth")), "unit").cast("string"))), F.lit(8)), 16, 10).cast("long")
    at = F.lit(0).cast("long") if seed is None else drawn % F.greatest(F.col("_size") - F.col("_rest"), F.lit(1))
    part = F.col("_copy") == F.col("_whole")
    cut = _cut(t, F.when(part, at).otherwise(0), F.when(part, at + F.col("_rest")).otherwise(F.col("_size")))
    return cut.withColumn("unit", F.concat(_long(*prefix), "unit", _long(F.col("_copy")))).select("unit", "at", "leaf", "start", "end")


def sample(nodes: list[Tokens], most: int | Column, seed: int | None = None) -> Tokens:
    """So many tokens of all nodes, from each of their units in proportion to its size.

    Shares are rounded half to even. A unit gives whole copies, then its beginning or, with a seed, a run from where a hash
    says. Units of samples and mixtures come after others, as they are found one level further down.
    """
    parts = [n.pieces.withColumns({"_g": F.lit(0), "_i": F.lit(k), "_most": most if isinstance(most, Column) else F.lit(most)}) for k, n in enumerate(nodes)]
    found = _sampled(_union(parts), all(n.flat for n in nodes), seed, [F.col("depth"), F.col("_i")])
    return Tokens(found.withColumn("depth", F.lit(1)), all(n.flat for n in nodes))


def repeat(node: Tokens, times: int) -> Tokens:
    """So many copies of the node's stream as one unit."""
    return concat(*[node] * times)


def resized(node: Tokens, factor: float, seed: int | None = None) -> Tokens:
    total = node.pieces.agg(F.sum(F.col("end") - F.col("start"))).scalar()
    return sample([node], F.floor(total * factor), seed)


def _sizes(totals: list[DataFrame], ratios: list[float], repetitions: list[float], target: int | None) -> DataFrame:
    """Rows (_g, _most): what to take of each source (size), by ratios and the repetition allowed; too little is an error."""
    rows = [t.select(F.lit(k).alias("_g"), "size", F.lit(float(r)).alias("ratio"), F.lit(float(x)).alias("repetition")) for k, (t, r, x) in enumerate(zip(totals, ratios, repetitions))]
    found = sample_sizes(_union(rows), target)
    most = F.col("sample")
    if target is not None:
        reached = sample_sizes(_union(rows), target).agg(F.sum("sample")).scalar()
        most = F.when(reached >= target - len(rows), most).otherwise(F.raise_error(F.lit(f"Unable to meet target size {target}")).cast("long"))
    return found.select("_g", most.alias("_most"))


def mix(specs: list[tuple[Tokens, float, float]], target: int | None = None, seed: int | None = None) -> Tokens:
    """A mixture of nodes with ratios and how often each may be repeated; samples of each, one after another."""
    nodes = [s[0] for s in specs]
    sizes = _sizes([n.pieces.agg(F.sum(F.col("end") - F.col("start")).alias("size")) for n in nodes], [s[1] for s in specs], [s[2] for s in specs], target)
    parts = _union([n.pieces.withColumns({"_g": F.lit(k), "_i": F.lit(0)}) for k, n in enumerate(nodes)]).join(F.broadcast(sizes), "_g")  # a row a node
    found = _sampled(parts, all(n.flat for n in nodes), seed, [F.col("_g"), F.col("depth")])
    return Tokens(found.withColumn("depth", F.lit(2)), all(n.flat for n in nodes))


def plan(node: Tokens) -> DataFrame:
    """Rows (index, leaf, start, end, offset): the node's pieces in order, with their places in its stream."""
    rows = node.pieces.withColumns({"_n": F.col("end") - F.col("start"), "_one": F.lit(1).cast("long")})
    placed = sorted_sums(rows, [], ["unit", "at"], {"_upto": "_n", "_place": "_one"})
    return placed.select((F.col("_place") - 1).alias("index"), "leaf", "start", "end", (F.col("_upto") - F.col("_n")).alias("offset"))


def rows_of(rows: DataFrame, rank: list[str]) -> DataFrame:
    """Documents or instances as a node: rows in the order of numbers, with ``at``."""
    return rows.withColumn("at", _long(*[F.col(c) for c in rank]))


def concat_rows(*nodes: DataFrame) -> DataFrame:
    """Nodes of documents or instances one after another; a column that one lacks is null there."""
    parts = [n.withColumn("at", F.concat(_long(k), "at")) for k, n in enumerate(nodes)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _shuffled(node: DataFrame, seed: int | None, chunk: int = 1) -> tuple[DataFrame, list[str]]:
    if seed is None:
        return node, ["at"]
    return node.withColumn("_hash", hash_order(seed, 0, F.concat_ws(":", F.col("at").cast("string")))), ["_hash", "at"]


def _copies(node: DataFrame, copies: Column) -> DataFrame:
    """Rows so many times: all first copies in their order, then the second ones."""
    out = node.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return out.withColumn("copy", (F.col("_copy") - 1).cast("int")).drop("_copy")


def sample_documents(node: DataFrame, most: int | Column, seed: int | None = None, n: str = "n") -> DataFrame:
    """Whole copies of all documents as often as they fit into ``most`` tokens, then the first whose sum still fits.

    First in the order of the node or, with a seed, of a hash. Adds ``copy``.
    """
    kept = [c for c in node.columns if c not in ("at", "copy")]
    rows, order = _shuffled(node, seed)
    summed = sorted_sums(rows.withColumn("_tokens", F.col(n).cast("long")), [], order, {"_upto": "_tokens"})
    total = node.agg(F.coalesce(F.sum(n), F.lit(0))).scalar()
    most = most if isinstance(most, Column) else F.lit(most)
    t = summed.withColumns({"_all": total.cast("long"), "_most": most.cast("long")}).withColumn("_whole", F.expr("_most div _all"))
    copies = F.col("_whole") + (F.col("_upto") <= F.col("_most") % F.col("_all")).cast("long")
    taken = _copies(t, copies)
    place = F.concat(_long(F.col("copy")), _long(F.col("_upto")), "at")
    return taken.withColumn("at", place).select(*kept, "at", "copy")


def mix_documents(specs: list[tuple[DataFrame, float, float]], target: int | None = None, seed: int | None = None, n: str = "n") -> DataFrame:
    """A mixture of documents of several nodes by ratios of their tokens."""
    sizes = _sizes([s[0].agg(F.sum(n).cast("long").alias("size")) for s in specs], [s[1] for s in specs], [s[2] for s in specs], target)
    parts = []
    for k, (node, _, _) in enumerate(specs):
        most = sizes.where(F.col("_g") == k).select("_most").scalar()
        parts.append(sample_documents(node, most, None if seed is None else seed + k, n))
    return concat_rows(*parts)


def sample_instances(nodes: list[DataFrame], most: int | Column, chunk: int = 1, seed: int | None = None) -> DataFrame:
    """So many instances of all nodes, of each in proportion to its number, in whole chunks: copies, then the first of an order."""
    total = reduce(lambda a, b: a + b, [n.agg(F.count("*")).scalar() for n in nodes])
    most = most if isinstance(most, Column) else F.lit(most)
    parts = []
    for k, node in enumerate(nodes):
        kept = [c for c in node.columns if c not in ("at", "copy")]
        count = node.agg(F.count("*")).scalar()
        rows, order = _shuffled(node, None if seed is None else seed + k)
        placed = sorted_sums(rows.withColumn("_one", F.lit(1).cast("long")), [], order, {"_upto": "_one"})
        want = F.floor(most * (count / total))
        t = placed.withColumns({"_want": want - want % chunk, "_all": count})
        taken = _copies(t, F.expr("_want div _all") + (F.col("_upto") <= F.col("_want") % F.col("_all")).cast("long"))
        parts.append(taken.withColumn("at", _long(F.col("copy"), F.col("_upto"))).select(*kept, "at", "copy"))
    return concat_rows(*parts)


def mix_instances(specs: list[tuple[DataFrame, float, float]], size: int, target: int | None = None, chunk: int = 1, seed: int | None = None) -> DataFrame:
    """A mixture of instances of ``size`` tokens of several nodes by ratios."""
    sizes = _sizes([s[0].agg((F.count("*") * size).alias("size")) for s in specs], [s[1] for s in specs], [s[2] for s in specs], target)
    parts = []
    for k, (node, _, _) in enumerate(specs):
        most = F.floor(sizes.where(F.col("_g") == k).select("_most").scalar() / size)
        parts.append(sample_instances([node], most, chunk, None if seed is None else seed + k))
    return concat_rows(*parts)


def numbered(node: DataFrame, sums: dict[str, str] | None = None) -> DataFrame:
    """Adds ``index`` (from 0) in the order of a node of documents or instances, and sums up to each row."""
    placed = sorted_sums(node.withColumn("_one", F.lit(1).cast("long")), [], ["at"], {"index": "_one", **(sums or {})})
    return placed.withColumn("index", F.col("index") - 1).drop("_one", "at")
