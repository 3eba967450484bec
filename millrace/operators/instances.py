"""Training instances from documents: chunks, padded rows, power-of-two pieces, packed bins, interleaved rows."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.documents import offsets
from millrace.operators.ordering import shuffled
from millrace.operators.sums import running_sum

#: Instances that are numbered at once.
BLOCK = 1 << 16


def concat_and_chunk(docs: DataFrame, size: int, by: list[str], order: str, ids: str = "ids", most: int | None = None) -> DataFrame:
    """Rows (by, instance, input_ids): consecutive windows of a source's stream; its remainder is dropped.

    Each document is cut at the grid of windows, so a row is made per document and window it touches, not per token. With
    ``most``, a multiple of ``size``, the remainder is what doesn't fill windows of that size, so instances of any size
    hold the same tokens.
    """
    placed = offsets(docs.select(*by, order, "n", ids), by, order)
    if most and most != size:
        totals = docs.groupBy(*by).agg((F.expr(f"sum(n) div {most}") * most).alias("_upto"))
        placed = placed.join(totals, by).where(F.col("start") < F.col("_upto")).withColumn("end", F.least("end", "_upto"))
    numbers = F.expr(f"sequence(start div {size}, (end - 1) div {size})")

    def cut(i: Column) -> Column:
        low, high = F.greatest("start", i * size), F.least("end", (i + 1) * size)
        return F.struct(i.alias("instance"), F.struct(low.alias("at"), F.slice(ids, (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("ids")).alias("piece"))

    # windows are cut before they become rows, or each would carry its whole document
    pieces = placed.select(*by, F.explode(F.transform(numbers, cut)).alias("_p")).select(*by, "_p.instance", "_p.piece")
    grouped = pieces.groupBy(*by, "instance").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return grouped.select(*by, "instance", F.flatten("pieces.ids").alias("input_ids")).where(F.size("input_ids") == size)


def padded(docs: DataFrame, size: int, pad: int, ids: str = "ids") -> DataFrame:
    """Adds ``input_ids`` (cut to ``size``, padded on the right) and ``label_mask`` (false on padding)."""
    n = F.least(F.size(ids), F.lit(size))
    filled = F.concat(F.slice(ids, 1, size), F.array_repeat(F.lit(pad), F.lit(size) - n))
    return docs.withColumn("input_ids", filled).withColumn("label_mask", F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), F.lit(size) - n)))


def power_lengths(n: Column, least: int, most: int) -> Column:
    """Descending powers of two that a length splits into, capped at 2 ** most, ending at 2 ** least."""
    bit = lambda k: F.when(F.getbit(n.cast("long"), k) == 1, F.call_function("shiftleft", F.lit(1), k))
    rest = F.array_compact(F.transform(F.sequence(F.lit(most - 1), F.lit(least), F.lit(-1)), bit))
    return F.concat(F.array_repeat(F.lit(1 << most), F.shiftright(n.cast("int"), most)), rest)


def power_pieces(docs: DataFrame, least: int, most: int, start: str = "start", n: str = "n") -> DataFrame:
    """A row (start, length) for each power-of-two piece of each document."""
    sizes = power_lengths(F.col(n), least, most)
    cut = docs.withColumn("_sizes", sizes).select("*", F.posexplode("_sizes").alias("piece", "length"))
    before = F.aggregate(F.slice("_sizes", 1, F.col("piece")), F.lit(0).cast("long"), lambda a, x: a + x)
    return cut.withColumn("piece_start", F.col(start) + before).drop("_sizes")


def best_fit(lengths: list[int], size: int) -> list[int]:
    """Bin of each length, longest first into the fullest bin that still holds it; equal bins in order of their opening."""
    open_: list[tuple[int, int]] = []  # (space, bin)
    bins, opened = [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = bisect.bisect_left(open_, (lengths[i], -1))
        if k == len(open_):
            space, bin_, opened = size, opened, opened + 1
        else:
            space, bin_ = open_.pop(k)
        bins[i] = bin_
        if space > lengths[i]:
            bisect.insort(open_, (space - lengths[i], bin_))
    return bins


def pieces(docs: DataFrame, size: int, strategy: str = "truncate", ids: str = "ids") -> DataFrame:
    """Documents of at most ``size`` tokens: cut to it, or split into several (``piece``)."""
    if strategy == "truncate":
        return docs.withColumn("piece", F.lit(0)).withColumn(ids, F.slice(ids, 1, size)).withColumn("n", F.least("n", F.lit(size)).cast("long"))
    cut = docs.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {size} as int)"))))
    cut = cut.withColumn(ids, F.slice(ids, F.col("piece") * size + 1, size))
    return cut.withColumn("n", F.least(F.lit(size), F.col("n") - F.col("piece") * size).cast("long"))


def packed(pieces: DataFrame, size: int, group: str, order: str, n: str = "n") -> DataFrame:
    """Rows (group, order, piece, n, bin, turn): pieces of each group packed into bins of ``size``, best fit, longest first.

    ``turn`` is the order in which pieces went into bins; equal lengths go in document order. A group is packed in one
    task; make groups of files, or of consecutive documents, so none grows with the corpus.
    """
    schema = f"{group} {pieces.schema[group].dataType.simpleString()}, {order} long, piece int, n long, bin long, turn long"

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("o", "ascending"), ("p", "ascending")])
        lengths = t.column("n").to_numpy()
        turn = np.empty(len(lengths), np.int64)
        turn[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
        bins = best_fit(lengths.tolist(), size)
        return pa.table({group: t.column("g"), order: t.column("o"), "piece": t.column("p"), "n": t.column("n"), "bin": pa.array(bins, pa.int64()), "turn": pa.array(turn)})

    cut = pieces.select(F.col(group).alias("g"), F.col(order).cast("long").alias("o"), F.col("piece").alias("p"), F.col(n).cast("long").alias("n"))
    return cut.groupBy("g").applyInArrow(run, schema)


def packed_instances(pieces: DataFrame, bins: DataFrame, size: int, group: str, order: str, pad: int, ids: str = "ids") -> DataFrame:
    """Rows (group, bin, input_ids, label_mask, doc_lens): the pieces of each bin in the order they were packed, padded."""
    placed = bins.join(pieces.select(group, order, "piece", ids), [group, order, "piece"])
    parts = placed.groupBy(group, "bin").agg(F.array_sort(F.collect_list(F.struct("turn", F.col(ids).alias("ids")))).alias("p"))
    whole = parts.select(group, "bin", F.flatten("p.ids").alias("_ids"), F.transform("p", lambda x: F.size(x["ids"])).alias("doc_lens"))
    room = F.lit(size) - F.size("_ids")
    mask = F.concat(F.array_repeat(F.lit(True), F.size("_ids")), F.array_repeat(F.lit(False), room))
    return whole.select(group, "bin", F.concat("_ids", F.array_repeat(F.lit(pad), room)).alias("input_ids"), mask.alias("label_mask"), "doc_lens")


def interleaved(docs: DataFrame, size: int, documents: int, chunks: int, position: str, pad: int = -1, ids: str = "ids", specials: tuple[int, ...] = (0,), end: int = 0) -> DataFrame:
    """Rows (instance, input_ids, used): ``documents`` documents in the order of ``position``, dealt in turn by chunks.

    Each is cut to its share and loses special tokens; chunks are near-equal, longer ones first; an end token follows if
    there is room.
    """
    share = size // documents
    kept = F.filter(F.slice(ids, 1, share), lambda x: ~x.isin(*specials))
    n = F.size("_kept")
    cut = docs.withColumn("_kept", kept).withColumn("instance", F.expr(f"{position} div {documents}")).withColumn("_slot", F.col(position) % documents)
    low = lambda i: i * F.floor(n / chunks) + F.least(i, n % chunks)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda i: F.struct(i.alias("turn"), F.col("_slot").alias("slot"), F.slice("_kept", (low(i) + 1).cast("int"), (low(i + 1) - low(i)).cast("int")).alias("ids")))
    rows = cut.select("instance", F.explode(pieces).alias("p")).groupBy("instance").agg(F.flatten(F.array_sort(F.collect_list("p"))["ids"]).alias("_ids"), (F.count("*") / chunks).alias("_docs"))
    rows = rows.where(F.col("_docs") == documents)
    closed = F.when(F.size("_ids") < size, F.concat("_ids", F.array(F.lit(end)))).otherwise(F.col("_ids"))
    used = F.size(closed)
    return rows.select("instance", F.concat(closed, F.array_repeat(F.lit(pad), F.lit(size) - used)).alias("input_ids"), used.alias("used"))


def padding(bins: DataFrame, size: int, group: str) -> DataFrame:
    """Per group: bins, tokens, and mean padding of a bin."""
    filled = bins.groupBy(group, "bin").agg(F.sum("n").alias("filled"))
    return filled.groupBy(group).agg(F.count("*").alias("bins"), F.sum("filled").alias("tokens"), F.avg(F.lit(size) - F.col("filled")).alias("mean_padding"))


def interleaved_but(docs: DataFrame, exempt: Column, size: int, documents: int, chunks: int, seed: int, epoch: int, index: str, pad: int = -1) -> DataFrame:
    """Rows (index, input_ids): the exempt documents first, each by itself in the order of ``index``, then the others interleaved."""
    marked = docs.withColumn("_exempt", exempt)
    alone = padded(marked.where("_exempt"), size, pad).select(F.col(index).alias("_o"), "input_ids").withColumn("_part", F.lit(0))
    mixed = interleaved(shuffled(marked.where("NOT _exempt").drop("_exempt"), index, seed, epoch), size, documents, chunks, "position", pad)
    both = alone.unionByName(mixed.select(F.col("instance").alias("_o"), "input_ids", F.lit(1).alias("_part")))
    ranked = running_sum(both.select("_part", F.col("_o").cast("long").alias("_o"), F.lit(1).alias("_one")), ["_part"], "_o", "_one", "_r")
    placed = dense_index(both.join(ranked.select("_part", "_o", (F.col("_r") - 1).alias("_i")), ["_part", "_o"]), ["_part"], "_i")
    return placed.select("index", "input_ids")


def labelled(rows: DataFrame, metadata: DataFrame, on: list[str]) -> DataFrame:
    """Rows with the metadata or label of their source; sources without any keep nulls."""
    return rows.join(metadata, on, "left")


def numbered(sizes: DataFrame, by: list[str], n: str = "n", name: str = "instance", block: int = BLOCK, index: str | None = None) -> DataFrame:
    """A row (by, instance) for each number below ``n`` of each source; numbers are made by blocks, which tasks share.

    With ``index``, adds it as ``dense_index`` does, nulls last, from the sizes alone: the planner takes numbers to be as
    small as their blocks, so a join right after them might send them all through the driver.
    """
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = F.lit(block).cast("long")
    known = sizes.where(F.col(n) > 0).select(*by, n)
    if index:
        before = Window.orderBy(*[F.col(c).asc_nulls_last() for c in by]).rowsBetween(Window.unboundedPreceding, -1)  # a row a source
        known = known.withColumn("_base", F.coalesce(F.sum(n).over(before), F.lit(0)))
    blocks = known.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, step)).alias("_low")).repartition(parts, *by, "_low")
    own = F.explode(F.sequence(F.col("_low"), F.least(F.col("_low") + block, F.col(n)) - 1)).alias(name)
    if not index:
        return blocks.select(*by, own)
    return blocks.select(*by, "_base", own).withColumn(index, F.col("_base") + F.col(name)).drop("_base")


def dense_index(df: DataFrame, by: list[str], instance: str) -> DataFrame:
    """Adds ``index``: sources one after another, their instances in order."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_size"))
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*by, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    return df.join(bases, by).withColumn("index", F.col("_base") + F.col(instance)).drop("_base")


def masked(rows: DataFrame, masks: DataFrame, on: str, ids: str = "ids", mask: str = "mask") -> DataFrame:
    """Rows with the mask of their tokens; a mask of another length, or none, is an error."""
    met = rows.join(masks.select(on, mask), on, "left")
    fits = F.coalesce(F.size(mask) == F.size(ids), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("the mask doesn't fit "), F.col(on).cast("string"))).cast("array<boolean>")
    return met.withColumn(mask, F.when(fits, F.col(mask)).otherwise(wrong))
