"""Loader plans: curricula over buckets of lengths, batches of uneven lengths, collation, and cursors that can be restored."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.sums import global_position, hash_order, running_sum


def bucket_plan(buckets: DataFrame, tokens: int, length: str = "length", cycles: int = 1, balanced: bool = False) -> DataFrame:
    """Per bucket of lengths: instances, instances of a batch, batches and the number of the first one; for few buckets.

    Batches are whole, and a multiple of ``cycles``; balanced buckets all have as many as the scarcest.
    """
    sizes = buckets.groupBy(length).agg(F.count("*").alias("instances")).withColumn("per", F.expr(f"{tokens} div {length}"))
    whole = F.expr("instances div per")
    if balanced:
        whole = F.min(whole).over(Window.partitionBy())  # a row a bucket
    batches = sizes.withColumn("batches", (F.floor(whole / cycles) * cycles).cast("long"))
    ordered = Window.orderBy(length)
    before = F.coalesce(F.sum("batches").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return batches.withColumn("bucket", F.row_number().over(ordered) - 1).withColumn("first", before)


def bucket_batches(instances: DataFrame, plan: DataFrame, index: str, world: int, seed: int, epoch: int, length: str = "length") -> DataFrame:
    """Instances of whole batches (batch, slot, rank): each bucket's are shuffled by themselves, and a rank takes a run of slots."""
    keyed = instances.withColumn("_key", hash_order(seed, epoch, F.concat_ws(":", length, index)))
    placed = global_position(keyed, "_key", index, "_place", [length]).drop("_key").join(plan.select(length, "per", "batches", "first"), length)
    kept = placed.where(F.col("_place") < F.col("batches") * F.col("per"))
    kept = kept.withColumn("batch", F.col("first") + F.expr("_place div per")).withColumn("slot", F.col("_place") % F.col("per"))
    each = F.floor(F.col("per") / world)
    return kept.where(F.col("slot") < each * world).withColumn("rank", F.floor(F.col("slot") / each)).drop("_place", "per", "batches", "first")


def natural_order(plan: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Batches (position, batch, bucket) in a shuffled order that begins with one of the longest bucket."""
    batches = plan.where("batches > 0").select("bucket", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("batches") - 1)).alias("batch"))
    keyed = batches.withColumn("_key", hash_order(seed, epoch, F.col("batch")))
    longest = plan.agg(F.max(F.when(F.col("batches") > 0, F.col("bucket")))).scalar()
    lead = keyed.where(F.col("bucket") == longest).agg(F.min_by("batch", "_key")).scalar()
    marked = keyed.withColumn("_key", F.when(F.col("batch") == lead, F.lit("")).otherwise(F.col("_key")))
    return global_position(marked, "_key", "batch").select("position", "batch", "bucket")


def odds(kind: str, bucket: Column, buckets: Column, step: Column) -> Column:
    """How likely a bucket is in a step of a cycle: longer ones come later; by powers of two or linearly."""
    start = buckets - bucket
    place = F.when(start + step <= buckets, start + step).otherwise(start - (start + step) % buckets)
    return F.pow(F.lit(2.0), place - 1) if kind == "power" else place.cast("double")


def growth_plan(plan: DataFrame, kind: str, cycles: int) -> DataFrame:
    """Rows (cycle, step, bucket, batches, first): how many batches of each bucket go into each step of each cycle.

    A cycle has as many steps as there are buckets; shares are rounded half to even, and the last step takes what is left.
    Where rounded shares sum to more than a bucket has, the last step has fewer, and if need be those before it. For few
    buckets and cycles.
    """
    t = plan.select("bucket", "first", F.floor(F.col("batches") / cycles).alias("_each"), F.count("*").over(Window.partitionBy()).alias("_buckets"))
    steps = t.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_buckets") - 1)))
    by = Window.partitionBy("bucket")
    share = odds(kind, F.col("bucket"), F.col("_buckets"), F.col("step"))
    rounded = steps.withColumn("_odds", share).withColumn("_n", F.bround(F.col("_odds") / F.sum("_odds").over(by) * F.col("_each")).cast("long"))
    ordered = by.orderBy("step")
    shared = F.least(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)), F.col("_each"))
    upto = rounded.withColumn("_upto", F.when(F.col("step") == F.col("_buckets") - 1, F.col("_each")).otherwise(shared))
    counted = upto.withColumn("_before", F.lag("_upto", 1, 0).over(ordered)).withColumn("batches", F.col("_upto") - F.col("_before"))
    placed = counted.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    return placed.select("cycle", "step", "bucket", "batches", (F.col("first") + F.col("cycle") * F.col("_each") + F.col("_before")).alias("first"))


def growth_order(growth: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Batches (position, batch, bucket, cycle, step) of a growth plan, shuffled within each step."""
    batches = growth.where("batches > 0").withColumn("batch", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("batches") - 1)))
    keyed = batches.withColumn("_key", hash_order(seed, epoch, F.col("batch")))
    within = global_position(keyed, "_key", "batch", "_within", ["cycle", "step"])
    sizes = growth.groupBy("cycle", "step").agg(F.sum("batches").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("cycle", "step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a step
    bases = sizes.select("cycle", "step", before.alias("_base"))
    return within.join(bases, ["cycle", "step"]).select((F.col("_base") + F.col("_within")).alias("position"), "batch", "bucket", "cycle", "step")


def distribution(order: DataFrame, parts: int, by: str = "cycle") -> DataFrame:
    """Batches of each bucket in so many near-equal parts of each cycle of an order."""
    sizes = order.groupBy(by).agg(F.count("*").alias("_n"), F.min("position").alias("_low"))
    place = F.col("position") - F.col("_low")
    wide = F.floor(F.col("_n") / parts)
    more = F.col("_n") % parts
    part = F.when(place < more * (wide + 1), F.floor(place / (wide + 1))).otherwise(more + F.floor((place - more * (wide + 1)) / F.greatest(wide, F.lit(1))))
    return order.join(sizes, by).groupBy(by, part.alias("part"), "bucket").agg(F.count("*").alias("batches"))


def token_batches(rows: DataFrame, order: str, n: str, budget: int) -> DataFrame:
    """Adds ``batch``: rows in order, a new batch where the next wouldn't fit ``budget`` tokens; lengths within one must agree.

    ``order`` is dense. Runs of one length fill batches of their own, so a row's batch follows from its place in its run;
    a row that would fit the last batch of the run before it, of another length, is an error, as is one over the budget.
    """
    before = rows.select((F.col(order) + 1).alias(order), F.col(n).alias("_before"))
    t = rows.join(before, order, "left").withColumn("_all", F.lit(0)).withColumn("_new", F.coalesce((F.col(n) != F.col("_before")).cast("int"), F.lit(1)))
    t = running_sum(t, ["_all"], order, "_new", "_run")
    runs = t.groupBy("_run").agg(F.min(order).alias("_first"), F.count("*").alias("_rows"), F.max(n).alias("_n"))
    each = F.floor(F.lit(budget) / F.col("_n"))
    runs = runs.withColumn("_each", F.when(each >= 1, each).otherwise(F.raise_error(F.lit("a row exceeds the budget")).cast("long")))
    runs = running_sum(runs.withColumn("_all", F.lit(0)).withColumn("_batches", F.ceil(F.col("_rows") / F.col("_each"))), ["_all"], "_run", "_batches", "_upto")
    left = F.lit(budget) - (F.col("_rows") - (F.col("_batches") - 1) * F.col("_each")) * F.col("_n")
    room = runs.select((F.col("_run") + 1).alias("_run"), left.alias("_room"))
    runs = runs.join(room, "_run", "left")
    fits = F.raise_error(F.lit("lengths differ within a batch")).cast("long")
    base = F.when(F.coalesce(F.col("_room") >= F.col("_n"), F.lit(False)), fits).otherwise(F.col("_upto") - F.col("_batches"))
    placed = t.join(runs.select("_run", "_first", "_each", base.alias("_base")), "_run")
    return placed.withColumn("batch", F.col("_base") + F.floor((F.col(order) - F.col("_first")) / F.col("_each"))).select(*rows.columns, "batch")


def collated(rows: DataFrame, batch: str, arrays: dict[str, object], side: str = "right") -> DataFrame:
    """Rows whose arrays are padded to the longest of their batch, each with its own value, on one side."""
    widest = rows.groupBy(batch).agg(*(F.max(F.size(a)).alias(f"_{a}") for a in arrays))
    t = rows.join(widest, batch)
    for a, pad in arrays.items():
        filler = F.array_repeat(F.lit(pad), F.col(f"_{a}") - F.size(a))
        t = t.withColumn(a, F.concat(F.col(a), filler) if side == "right" else F.concat(filler, F.col(a)))
    return t.drop(*(f"_{a}" for a in arrays))


def micro_batches(plan: DataFrame, size: int, slot: str = "slot") -> DataFrame:
    """Adds ``micro`` and the place in it, for parts of ``size`` rows of a batch."""
    return plan.withColumn("micro", F.floor(F.col(slot) / size)).withColumn("micro_slot", F.col(slot) % size)


def checked_vocabulary(rows: DataFrame, size: int, ids: str = "ids", shown: int = 10) -> DataFrame:
    """Adds ``bad_ids`` (distinct, in order) and ``bad_places``, the first places that hold one."""
    outside = lambda x: (x < 0) | (x >= size)
    bad = F.array_sort(F.array_distinct(F.filter(ids, outside)))
    places = F.slice(F.array_compact(F.transform(ids, lambda x, i: F.when(outside(x), i))), 1, shown)
    return rows.withColumn("bad_ids", bad).withColumn("bad_places", places)


def gathered(picks: DataFrame, expert: str, order: str, capacity: int | None = None) -> DataFrame:
    """Adds ``place``, the row's place among those of its expert in order; with a capacity also whether it is ``kept``."""
    ranked = running_sum(picks.withColumn("_one", F.lit(1)), [expert], order, "_one", "_r")
    placed = ranked.withColumn("place", F.col("_r") - 1).drop("_one", "_r")
    return placed if capacity is None else placed.withColumn("kept", F.col("place") < capacity)


def scattered(placed: DataFrame, row: str, name: str, weight: str = "weight", value: str = "value") -> DataFrame:
    """Back from experts to rows: the weighted sum of what each row's experts gave."""
    return placed.groupBy(row).agg(F.sum(F.col(weight) * F.col(value)).alias(name))


@dataclass(frozen=True)
class Cursor:
    """Where a loader is: what it reads, in which order, and how far it got."""

    fingerprints: tuple[str, ...]
    batch_tokens: int
    seed: int = 0
    epoch: int = 1
    tokens: int = 0
    batches: int = 0
    sources_per_epoch: int = 1
    order: str = "shuffled"

    def advanced(self, batches: int) -> Cursor:
        return replace(self, batches=self.batches + batches, tokens=self.tokens + batches * self.batch_tokens)

    def state(self) -> dict:
        return asdict(self)

    def restored(self, state: dict, ignore_fingerprints: bool = False) -> Cursor:
        """The cursor of a saved state for these sources; its seed and epoch hold, batches follow from its tokens.

        Sources may have been appended as long as those of old aren't through; anything else that changed is an error.
        """
        old = tuple(state["fingerprints"])
        for name in ("sources_per_epoch", "order"):
            if state[name] != getattr(self, name):
                raise ValueError(f"the saved state has another {name}")
        if old != self.fingerprints and not ignore_fingerprints:
            if self.fingerprints[: len(old)] != old:
                raise ValueError("the saved state is of other sources")
            if state["epoch"] > len(old) // self.sources_per_epoch:
                raise ValueError("sources were appended after the ones before had been gone through")
        return replace(self, seed=state["seed"], epoch=state["epoch"], tokens=state["tokens"], batches=state["tokens"] // self.batch_tokens)

    def rescaled(self, batch_tokens: int) -> Cursor:
        """The same place with batches an integer factor larger or smaller; larger ones only at a place they reach."""
        big, small = max(batch_tokens, self.batch_tokens), min(batch_tokens, self.batch_tokens)
        if big % small:
            raise ValueError("batches may grow or shrink by an integer factor only")
        if batch_tokens > self.batch_tokens and self.batches % (big // small):
            raise ValueError(f"{self.batches} batches are no multiple of {big // small}")
        batches = self.batches * small // big if batch_tokens > self.batch_tokens else self.batches * (big // small)
        return replace(self, batch_tokens=batch_tokens, batches=batches)

    def remaining(self, plan: DataFrame, batch: str = "batch") -> DataFrame:
        return plan.where(F.col(batch) >= self.batches)


@dataclass(frozen=True)
class Segment:
    """Batches of one size: the step and the token that the first begins with, and the factor of the learning rate."""

    step: int
    token: int
    size: int
    factor: float = 1.0


def segments(schedule: list[tuple[int, int]], unit: str = "tokens") -> list[Segment]:
    """Where batch sizes change, by a schedule of (start, batch tokens) in ``tokens`` or ``steps``.

    Sizes grow or shrink by integer factors. A start takes effect at the first batch that begins at or after it; a larger
    size waits until as many batches have gone as make whole ones of the new size, so no instance is lost or comes twice. Of
    several starts that are due, the latest counts. The learning rate follows the square root of the size.
    """
    if unit not in ("tokens", "steps") or not schedule or schedule[0][0] != 0:
        raise ValueError("a schedule has tokens or steps, and starts at 0")
    for (a, x), (b, y) in zip(schedule, schedule[1:]):
        if b <= a or x == y or max(x, y) % min(x, y):
            raise ValueError("starts must grow, and sizes change by an integer factor")
    found = [Segment(0, 0, schedule[0][1])]
    for k, (start, size) in enumerate(schedule[1:], 1):
        now = found[-1]
        if max(size, now.size) % min(size, now.size):
            raise ValueError(f"batches of {now.size} can't become ones of {size}")
        steps = max(0, -(-(start - now.token) // now.size) if unit == "tokens" else start - now.step)
        if size > now.size:
            ratio = size // now.size
            steps = -(-(now.token // now.size + steps) // ratio) * ratio - now.token // now.size
        at = Segment(now.step + steps, now.token + steps * now.size, size, now.factor * math.sqrt(size / now.size))
        following = schedule[k + 1][0] if k + 1 < len(schedule) else None
        if following is None or (at.token if unit == "tokens" else at.step) < following:
            found = [*found[:-1], at] if at.step == now.step else [*found, at]
    return found


def scheduled_batches(rows: DataFrame, plan: list[Segment], size: int, position: str = "position") -> DataFrame:
    """Adds ``batch`` and ``slot`` of instances of ``size`` tokens in a dense order, ``tokens`` before the batch, its size and factor.

    A row finds its segment by its token and its batch by a division inside it; the last batch, if not whole, is left out.
    """
    total = rows.agg(F.count("*")).scalar() * size
    at = F.col(position) * size
    own = F.filter(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in asdict(s).items()]) for s in plan]), lambda s: s["token"] <= at)
    t = rows.withColumn("_s", F.element_at(own, -1)).withColumn("_in", F.floor((at - F.col("_s.token")) / F.col("_s.size")))
    t = t.withColumns({"batch": F.col("_s.step") + F.col("_in"), "tokens": F.col("_s.token") + F.col("_in") * F.col("_s.size"), "batch_tokens": F.col("_s.size").cast("long"), "factor": F.col("_s.factor")})
    t = t.withColumn("slot", F.floor((at - F.col("tokens")) / size))
    return t.where(F.col("tokens") + F.col("batch_tokens") <= total).drop("_s", "_in")


def until(plan: DataFrame, steps: int | None = None, tokens: int | None = None, batch_tokens: int | None = None, batch: str = "batch") -> DataFrame:
    """The batches of a plan before a duration of steps or tokens is due: with tokens, those up to the one that reaches it."""
    most = steps if steps is not None else -(-tokens // batch_tokens)
    return plan.where(F.col(batch) < most)
