"""Temperature calibration by grid search on the mean loss of scored rows ``(z, gold)``.

Rows without logits or gold stay out. Ties go to the temperature nearest 1, then to the smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decision as D


def grid(points: int = 201, lowest: float = -1.0, highest: float = 1.0) -> list[float]:
    """Temperatures in equal steps of their logarithm."""
    return [round(10 ** (lowest + (highest - lowest) * i / (points - 1)), 9) for i in range(points)]


def grid_nll(scored: DataFrame, temperatures: list[float], floor: float = 1e-300) -> DataFrame:
    """``(idx, temperature, n, nll)``: each row is read once and its losses at all temperatures are summed by place."""
    rows = scored.where("z IS NOT NULL AND gold IS NOT NULL")
    values = F.array(*(F.lit(t) for t in temperatures))

    def loss(t: Column) -> Column:
        most = -F.ln(F.lit(floor)) if floor else F.lit(float("inf"))
        return D.let(F.transform("z", lambda z: z / t), lambda y: F.least(D.log_sum_exp(y) - D.at(y, F.col("gold")), most))

    each = rows.select(F.posexplode(F.transform(values, loss)).alias("idx", "nll"))
    summed = each.groupBy("idx").agg(F.count("nll").alias("n"), F.avg("nll").alias("nll"))
    return summed.select("idx", F.element_at(values, F.col("idx") + 1).alias("temperature"), "n", "nll")


def best(table: DataFrame, digits: int = 9) -> DataFrame:
    """The temperature of least loss and whether it lies at an end of the grid."""
    ends = table.agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    top = table.orderBy(F.round("nll", digits), F.abs(F.ln("temperature")), "temperature").limit(1)
    return top.crossJoin(F.broadcast(ends)).select("idx", "temperature", "n", F.round("nll", 6).alias("nll"), ((F.col("idx") == F.col("first")) | (F.col("idx") == F.col("last"))).alias("at_boundary"))
