"""Learning-rate and sequence-length schedules as column expressions of a step."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _warm(x: Column, rate, warmup: int, least: float) -> Column:
    return least + (rate - least) * F.least(x, F.lit(warmup)) / warmup if warmup else F.lit(rate)


def _tail(left: Column, rate, decay: int, last: float) -> Column:
    """What is left of a linear decay when so many steps are."""
    return last + (rate - last) * F.least(left, F.lit(decay)) / decay


def constant(x: Column, rate) -> Column:
    return F.lit(rate)


def constant_with_warmup(x: Column, rate: float, warmup: int, least: float = 0.0) -> Column:
    return F.when(x <= warmup, _warm(x, rate, warmup, least)).otherwise(F.lit(rate))


def warmup_stable_decay(x: Column, rate: float, total: int, warmup: int, decay: int, least: float = 0.0, last: float = 0.0) -> Column:
    return F.when(x <= warmup, _warm(x, rate, warmup, least)).when(x >= total - decay, _tail(total - x, rate, decay, last)).otherwise(F.lit(rate))


def linear_with_warmup(x: Column, rate: float, total: int, warmup: int, alpha: float = 0.1, least: float = 0.0) -> Column:
    low = alpha * rate
    return F.when(x < warmup, _warm(x, rate, warmup, least)).when(x >= total, F.lit(low)).otherwise(rate - (rate - low) * (x - warmup) / (total - warmup))


def inverse_sqrt_with_warmup(x: Column, rate: float, warmup: int, alpha: float = 0.1, least: float = 0.0) -> Column:
    """Without a warm-up, and so at step 0, the root is that of step 1."""
    low = alpha * rate
    return F.when(x < warmup, _warm(x, rate, warmup, least)).otherwise(low + (rate - low) * F.sqrt(F.lit(float(warmup)) / F.greatest(x, F.lit(1))))


def cosine_with_warmup(x: Column, rate: float, total: int, warmup: int, alpha: float = 0.1, least: float = 0.0) -> Column:
    low = alpha * rate
    return F.when(x < warmup, _warm(x, rate, warmup, least)).when(x >= total, F.lit(low)).otherwise(low + (rate - low) * (1 + F.cos(math.pi * (x - warmup) / (total - warmup))) / 2)


def half_cosine_with_warmup(x: Column, rate, total: int, warmup: int, alpha: float = 0.1, least: float = 0.0) -> Column:
    """The second half of a cosine; the warm-up ends half way between the rate and the lowest one."""
    low = alpha * rate
    fall = low + (rate - low) * (1 + F.cos(math.pi * (x - warmup + (total - warmup)) / (2 * (total - warmup)))) / 2
    return F.when(x < warmup, _warm(x, low + (rate - low) / 2, warmup, least)).when(x >= total, F.lit(low)).otherwise(fall)


def cosine_with_decay(x: Column, rate, total: int, warmup: int, decay: int, alpha: float = 0.1, least: float = 0.0, last: float = 0.0) -> Column:
    """A cosine cut short by a linear decay."""
    reached = cosine_with_warmup(F.lit(total - decay), rate, total, warmup, alpha, least)
    return F.when(x >= total - decay, _tail(total - x, reached, decay, last)).otherwise(cosine_with_warmup(x, rate, total, warmup, alpha, least))


def power(x: Column, rate, total: int, warmup: int, decay: int, exponent: float = -0.51, least: float = 0.0, last: float = 0.0) -> Column:
    """Falls as a power of the step, so it doesn't follow the horizon until the linear decay at its end."""
    reached = rate * F.pow(F.lit((total - decay) / warmup), F.lit(exponent))
    return F.when(x <= warmup, _warm(x, rate, warmup, least)).when(x >= total - decay, _tail(total - x, reached, decay, last)).otherwise(rate * F.pow(x / warmup, F.lit(exponent)))


def between(x: Column, start, end, duration: int, shape: str = "linear") -> Column:
    """From one rate to another over a duration."""
    done = x / duration
    return start + (end - start) * (done if shape == "linear" else (1 - F.cos(math.pi * done)) / 2)


def staged(x: Column, rate: float, stages: list[dict]) -> Column:
    """Stages of a ``duration``, each to its ``end``, from its ``start`` or where the one before ended; the last end stays.

    A stage's ``shape`` is linear or cosine.
    """
    out, began, before = F, 0, rate
    for stage in stages:
        start, end = stage.get("start", before), stage["end"]
        out = out.when(x < began + stage["duration"], between(x - began, start, end, stage["duration"], stage.get("shape", "linear")))
        began, before = began + stage["duration"], end
    return out.otherwise(F.lit(before))


def overridden(x: Column, schedule, start: int, duration: int, end: float, shape: str = "linear") -> Column:
    """``schedule`` (of a step) up to a start; from what it gives there to ``end`` after it."""
    late = F.when(x < start + duration, between(x - start, schedule(F.lit(start)), end, duration, shape)).otherwise(F.lit(end))
    return F.when(x < start, schedule(x)).otherwise(late)


def sequential(x: Column, rate, total: int, parts: list, until: list[int]) -> Column:
    """Schedules (of a step, a rate and a total) one after another, each from the last rate of the one before."""
    out = F
    for part, most in zip(parts, until):
        out = out.when(x <= most, part(x, rate, min(total, most))) if out is F else out.when(x <= most, part(x, rate, min(total, most)))
        rate = part(F.lit(most), rate, most)
        x, total = x - most, total - most
    return out.otherwise(parts[-1](x, rate, total)) if until else parts[-1](x, rate, total)


def periodic(x: Column, rate: float, lengths: list[int], warmup: int, decay: int | float, multipliers: list[float] | None = None, least: float = 0.0, last: float = 0.0) -> Column:
    """Warm-up, then periods that each end in a linear decay, with a peak of their own; ``decay`` is in steps or a share."""
    peaks = [rate * m for m in multipliers or [1.0] * len(lengths)]
    out, began = F.when(x < warmup, _warm(x, peaks[0], warmup, least)), warmup
    out = out.when(x >= sum(lengths), F.lit(last))
    for i, (length, peak) in enumerate(zip(lengths, peaks)):
        down = decay if isinstance(decay, int) else round(decay * length)
        end = began + length - (0 if i else warmup)
        out = out.when(x <= end, F.when(x < end - down, F.lit(peak)).otherwise(_tail(end - x, peak, down, last)))
        began = end
    return out.otherwise(F.lit(last))


def exponential(x: Column, rate: float, total: int, least: float = 1e-9) -> Column:
    return least * F.pow(F.lit(rate / least), x / total)


def sequence_length(x: Column, least: int, most: int, warmup: int) -> Column:
    """Power-of-two length that grows from ``least`` to ``most`` over the warm-up."""
    grown = least + (most - least) * F.least(x, F.lit(warmup)) / warmup
    return F.pow(F.lit(2.0), F.floor(F.log2(grown))).cast("long")


def truncated_length(x: Column, least: int, most: int, warmup: int, multiple: int) -> Column:
    """Length that grows over the warm-up in multiples."""
    grown = F.floor(least + (most - least) * F.least(x, F.lit(warmup)) / warmup)
    return F.least(F.lit(most).cast("long"), F.floor(grown / multiple) * multiple)


def batch_size_factor(new: Column, old: Column) -> Column:
    """What the learning rate is multiplied by when the batch size changes."""
    return F.sqrt(new / old)
