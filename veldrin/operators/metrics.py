"""Metrics of answers: accuracy, losses, calibration error, exact percentiles, audits and gates.

Invalid answers count as wrong and stay out of losses. Empty groups have null means. Null flags count as false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decision as D


def flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def rounded(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


def accuracy_aggregates() -> list[Column]:
    right = F.count_if(flag("valid") & flag("correct"))
    return [F.count("*").alias("n"), right.alias("correct"), F.count_if(flag("valid")).alias("valid"), F.round(F.try_divide(right, F.count("*")), 6).alias("accuracy")]


def accuracy_sets(rows: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Accuracy over all ``sets`` of grouping columns in one pass; ``level`` is Spark's grouping id."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(*accuracy_aggregates(), F.grouping_id().cast("int").alias("level"))


def macro_accuracy(rows: DataFrame, family: Sequence[str]) -> DataFrame:
    """Mean of the accuracies of families, and how many there are."""
    per = rows.groupBy(*family).agg(F.try_divide(F.count_if(flag("valid") & flag("correct")), F.count("*")).alias("a"))
    return per.agg(F.count("*").alias("families"), rounded(F.avg("a"), "macro_accuracy"))


def losses(scored: DataFrame, by: Sequence[str] = (), floor: float = 1e-300) -> DataFrame:
    """Count, accuracy, NLL, Brier and expected-stage error of ``(p, gold)`` rows, ``gold`` a position from 0."""
    p, gold = F.col("p"), F.col("gold")
    rows = scored.select(*by, (D.argmax(p) == gold).alias("hit"), D.nll(D.at(p, gold), floor).alias("nll"), D.brier(p, gold).alias("brier"), F.abs(D.expectation(p) - gold).alias("mae"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("hit").alias("correct"), rounded(F.avg("nll"), "nll"), rounded(F.avg("brier"), "brier"), rounded(F.avg("mae"), "mae"))


def reliability(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """``(bin, lower, upper, n, mean_confidence, accuracy)`` of equal-width bins, empty ones too; ``rows`` are valid answers."""
    inside = F.least(F.lit(bins - 1), F.floor(F.col(confidence).cast("double") * bins)).cast("int")
    counted = rows.where(F.col(confidence).isNotNull()).groupBy(inside.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(confidence).cast("double")).alias("c"), F.avg(flag(correct).cast("double")).alias("a"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.round(F.col("bin") / bins, 6).alias("lower"), F.round((F.col("bin") + 1) / bins, 6).alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), rounded(F.col("c"), "mean_confidence"), rounded(F.col("a"), "accuracy"))


def calibration_error(table: DataFrame) -> DataFrame:
    """Expected calibration error of a reliability table."""
    gap = F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))
    return table.agg(F.sum("n").cast("long").alias("n"), rounded(F.try_divide(F.sum(gap), F.sum("n")), "ece", 4))


def exact_percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], accuracy: int = 2000) -> DataFrame:
    """``(by, share, n, percentile)``: exact percentiles with linear interpolation between neighbours.

    A sketch brackets the two neighbours' values, the values in the bracket are ranked, and those below it only
    counted, so that no task holds a whole group. The bracket is four of the sketch's errors wide on each side; should it
    miss all the same, the query fails rather than give a wrong value.
    """
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    width = 2.0 / accuracy
    bounds = [(max(0.0, s - width), min(1.0, s + width)) for s in shares]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.percentile_approx("_v", F.array(F.lit(lo), F.lit(hi)), accuracy * 2).alias(f"_b{i}") for i, (lo, hi) in enumerate(bounds)))
    few = F.col("n") <= accuracy  # all values are in the bracket
    bracket = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share"), F.when(few, F.lit(float("-inf"))).otherwise(F.col(f"_b{i}")[0]).alias("low"), F.when(few, F.lit(float("inf"))).otherwise(F.col(f"_b{i}")[1]).alias("high")) for i, s in enumerate(shares)))).alias("b")
    open_ = sketch.select(*by, "n", bracket).select(*by, "n", "b.*")
    s = open_.select(*(F.col(c).alias(f"_{c}") for c in by), "n", "i", "share", "low", "high")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = rows.groupBy(*by, "_v").agg(F.count("*").alias("c")).join(s, on)
    keys = [*by, "i", "share", "n"]
    # values below the bracket become one row that comes first
    near = joined.where(F.col("_v") <= F.col("high")).groupBy(*keys, F.when(F.col("_v") >= F.col("low"), F.col("_v")).alias("v")).agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = (F.col("n") - 1) * F.col("share")
    above = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    found = near.withColumn("upto", upto).groupBy(*keys).agg(above(F.floor(place)).alias("lo"), above(F.ceil(place)).alias("hi"))
    rest = place - F.floor(place)
    value = F.coalesce(F.col("lo") * (1 - rest) + F.col("hi") * rest, F.raise_error(F.lit("a percentile lies outside of its bracket")).cast("double"))
    return found.select(*by, "share", "n", value.alias("percentile"))


def order_audit(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How answers hold when candidates are shown in reverse order."""
    r = rows.where("reverse IS NOT NULL")
    f = lambda c: F.coalesce(F.col(f"reverse.{c}"), F.lit(False))
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(f("same_label")).alias("same"), F.count_if(f("correct")).alias("reversed_correct"), F.count_if(f("valid")).alias("reversed_valid"), F.round(F.try_divide(F.count_if(f("same_label")), F.count("*")), 6).alias("consistency"))
