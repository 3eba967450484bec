"""Column functions over arrays of numbers: logit filters, routing, labels, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST = float("-inf")


def hash_order(seed: int, epoch: int, item: Column) -> Column:
    """A key whose order is a shuffle, equal on every engine and for every partitioning."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.lit(epoch).cast("string"), item.cast("string")).cast("binary"))


def argmax(values: Column) -> Column:
    """Place (from 0) of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1


def top_k(values: Column, k: int) -> Column:
    """Values below the k-th largest become minus infinity; ties with it stay. k of 0 or less keeps all."""
    if k <= 0:
        return values
    least = F.try_element_at(F.slice(F.sort_array(values, asc=False), 1, k), F.lit(-1))
    return let(least, lambda z: F.transform(values, lambda x: F.when(x >= z, x).otherwise(F.lit(LOWEST))))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often the result refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def top_p(values: Column, p: float) -> Column:
    """Nucleus filter: sorted tokens stay while the mass before them is within p, the first two always."""
    ranked = F.sort_array(F.transform(values, lambda x, i: F.struct(x.cast("double").alias("x"), (-i).alias("i"))), asc=False)

    def kept(ranked: Column, total: Column) -> Column:
        biggest = F.get(ranked, F.lit(0))["x"]
        start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n"), F.lit(0).alias("kept"))

        def step(a: Column, r: Column) -> Column:
            stays = ((a["n"] < 2) | (a["mass"] <= p)).cast("int")
            mass = a["mass"] + F.exp(r["x"] - biggest) / total
            return F.struct(mass.alias("mass"), (a["n"] + 1).alias("n"), (a["kept"] + stays).alias("kept"))

        return F.aggregate(ranked, start, step)["kept"]

    mass = lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + F.exp(x["x"] - F.get(r, F.lit(0))["x"]))
    last = lambda r: let(mass(r), lambda total: F.try_element_at(r, F.greatest(kept(r, total), F.lit(1))))
    stays = lambda x, i, z: (x.cast("double") > z["x"]) | ((x.cast("double") == z["x"]) & (-i >= z["i"]))
    return let(ranked, lambda r: let(last(r), lambda z: F.transform(values, lambda x, i: F.when(stays(x, i, z), x).otherwise(F.lit(LOWEST)))))


def top_experts(scores: Column, k: int, bias: Column | None = None) -> Column:
    """Numbers of the k best scores, best first, the lower number among equals; a bias counts for the order only."""
    ranked = scores if bias is None else F.zip_with(scores, bias, lambda x, b: x + b)
    ranked = F.sort_array(F.transform(ranked, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))), asc=False)
    return F.transform(F.slice(ranked, 1, k), lambda r: (-r["i"]).cast("int"))


def sampled(logits: Column, temperature: float, item: Column, seed: int) -> Column:
    """Place (from 0) drawn by the probabilities of logits at a temperature, with a number that an item's hash gives; 0 is greedy."""
    if temperature <= 0:
        return argmax(logits)
    draw = F.conv(F.left(hash_order(seed, 0, item), F.lit(8)), 16, 10).cast("double") / 4294967296.0
    top = F.array_max(logits).cast("double")

    def pick(mass: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("i"))
        total = F.aggregate(mass, F.lit(0.0), lambda a, x: a + x)
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.when((a["at"] < 0) & (a["sum"] + x > draw * total), a["i"]).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i"))
        return F.aggregate(mass, start, step)["at"]

    return let(F.transform(logits, lambda x: F.exp((x.cast("double") - top) / temperature)), pick)


def log_sum_exp(values: Column) -> Column:
    return let(F.array_max(values).cast("double"), lambda z: z + F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - z))))


def shifted_labels(ids: Column, mask: Column, ignore: int = -100) -> Column:
    """Labels: each place holds the next id, ``ignore`` where that one is masked and at the end."""
    masked = F.zip_with(ids, mask, lambda x, m: F.when(m, x).otherwise(F.lit(ignore)))
    return F.concat(F.slice(masked, 2, F.greatest(F.size(ids) - 1, F.lit(0))), F.array(F.lit(ignore)))


def outside_vocabulary(ids: Column, size: int) -> Column:
    """Distinct ids that a vocabulary doesn't have, in order."""
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: (x < 0) | (x >= size))))


def melted(ids: Column, size: int) -> Column:
    """An array cut into rows of ``size``; none of an empty one."""
    rows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1)), F.lit(size)), lambda i: F.slice(ids, i, size))
    return F.filter(rows, lambda r: F.size(r) > 0)


def truncated(ids: Column, size: int) -> Column:
    return F.slice(ids, 1, size)


def chunked(ids: Column, sizes: list[int]) -> Column:
    """An array cut into parts of the given sizes; a part beyond the array's end is shorter, or empty."""
    starts = [sum(sizes[:i]) + 1 for i in range(len(sizes))]
    return F.array(*(F.slice(ids, start, size) for start, size in zip(starts, sizes)))


def runs(values: Column) -> Column:
    """Runs (value, start, end) of equal neighbours, in order."""
    first = F.transform(values, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(values, i - 1)), i))
    return let(F.array_compact(first), lambda starts: F.transform(starts, lambda s, k: F.struct(F.get(values, s).alias("value"), s.alias("start"), F.coalesce(F.get(starts, k + 1), F.size(values)).alias("end"))))


def left_padding(mask: Column) -> tuple[Column, Column]:
    """First place (from 0) that is true, null without any; and whether all places from there on are."""
    at = F.when(F.array_contains(mask, F.lit(True)), F.array_position(mask, F.lit(True)) - 1)
    return at, F.coalesce(~F.array_contains(F.slice(mask, (at + 1).cast("int"), F.size(mask)), F.lit(False)), F.lit(False))
