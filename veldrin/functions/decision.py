"""Columns of the decision algebra: from candidate logits to typed answers and per-row losses.

Logits, probabilities and keys are arrays that match by position. Null or empty arrays give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS_UP_TO = 10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though the body, or a lambda in it, uses it often."""
    return F.get(F.transform(F.array(value), body), 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    """Stable softmax of ``logits / temperature``."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    parts = lambda exps: let(total(exps), lambda s: F.transform(exps, lambda e: e / s))
    whole = lambda z: let(F.array_max(z), lambda top: let(F.transform(z, lambda x: F.exp((x - top) / t)), parts))
    return let(logits, lambda z: F.when(F.size(z) > 0, whole(z)))


def log_sum_exp(logits: Column) -> Column:
    return let(logits, lambda z: let(F.array_max(z), lambda top: top + F.ln(total(F.transform(z, lambda x: F.exp(x - top))))))


def argmax(values: Column) -> Column:
    """Position, from 0, of the first largest value."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def at(values: Column, position: Column) -> Column:
    """The element at a position from 0, null outside of the array."""
    return F.get(values, position)


def confidence(p: Column) -> Column:
    """1 minus the entropy of ``p`` as a share of the largest possible, within 0 and 1."""
    entropy = -F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x * F.ln(x))
    return F.when(F.size(p) > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - entropy / F.ln(F.size(p).cast("double")))))


def expectation(p: Column) -> Column:
    """Expected stage, within the first and the last."""
    mean = total(F.transform(p, lambda x, i: x * i))
    return F.greatest(F.lit(0.0), F.least((F.size(p) - 1).cast("double"), mean))


def nll(p_gold: Column, floor: float = 1e-300) -> Column:
    return -F.ln(F.greatest(p_gold, F.lit(floor)))


def brier(p: Column, gold: Column) -> Column:
    """Sum over candidates of the squared difference to the gold one."""
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2.0))))


def symbols(kind: Column, count: Column) -> Column:
    """Symbols shown for ``count`` candidates: digits for scores of at most ten stages, letters else."""
    places = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    digits = (kind == "score") & (count <= DIGITS_UP_TO)
    return F.transform(places, lambda i: F.when(digits, i.cast("string")).otherwise(F.char(i + 65)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def rms_normalised(h: Column, least: float = 1e-6) -> Column:
    """``h`` divided by the root of its mean square, which counts as ``least`` at least."""
    return let(F.greatest(F.sqrt(dot(h, h) / F.size(h)), F.lit(least)), lambda scale: F.transform(h, lambda x: x / scale))


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * total(F.zip_with(p, q, lambda x, y: F.abs(x - y)))


def largest_difference(p: Column, q: Column) -> Column:
    return F.array_max(F.zip_with(p, q, lambda x, y: F.abs(x - y)))


def aligned(values: Column, keys: Column, order: Column) -> Column:
    """``values``, which stand in the order of ``keys``, in the order of ``order``; null where a key is missing."""
    return F.transform(order, lambda k: F.get(values, F.array_position(keys, k).cast("int") - 1))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
