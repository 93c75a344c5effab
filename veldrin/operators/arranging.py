"""Order, ranks and samples: everything deterministic, with ties decided by the id.

Null keys are a group of their own where rows are grouped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage


def seeded(id_col: str, seed: str) -> Column:
    """A key that puts rows in an order which depends only on ids and seed."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def sampled(df: DataFrame, id_col: str, by: Sequence[str], k: int, seed: str) -> DataFrame:
    """``k`` rows of each group in seeded order (all of a smaller group), with their ``place`` from 1."""
    w = Window.partitionBy(*by).orderBy("_key", id_col)
    return df.withColumn("_key", seeded(id_col, seed)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("_key")


def extremes(df: DataFrame, by: str, size: Column, id_col: str) -> DataFrame:
    """The shortest and the longest row of each group: ``(by, shortest, least, longest, most)``; null sizes stay out."""
    sized = df.select(by, F.col(id_col).alias("i"), size.alias("s")).where("s IS NOT NULL")
    low, high = F.min(F.struct("s", "i")), F.min(F.struct((-F.col("s")).alias("m"), "i"))
    found = sized.groupBy(by).agg(low.alias("low"), high.alias("high"))
    return found.select(by, F.col("low.i").alias("shortest"), F.col("low.s").alias("least"), F.col("high.i").alias("longest"), (-F.col("high.m")).alias("most"))


def round_robin(df: DataFrame, by: Sequence[str], id_col: str, count: str) -> DataFrame:
    """A target position from 0 to ``count`` - 1 for each row, in turn by id within its stratum; rows without a count have none.

    Rows are laid out in ranges of strata and ids, so that a large stratum takes many tasks: places are counted within
    a range and moved on by the sizes of the ranges before it.
    """
    keys = [*by, count]
    ranges = stage(df.repartitionByRange(*keys, id_col).withColumn("_range", F.spark_partition_id()), "round-robin")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    sizes = sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_r"), "_before")
    on = F.col("_range") == F.col("_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(id_col)) - 1
    laid = ranges.withColumn("_place", place).join(sizes, on)
    return laid.select(*df.columns, ((F.col("_before") + F.col("_place")) % F.col(count)).cast("int").alias("position"))


def with_reversed(df: DataFrame, id_col: str, array: str, only: Column) -> DataFrame:
    """All rows and, of those that ``only`` picks, a copy with the array reversed and ``_reverse`` after its id."""
    return df.unionByName(df.where(only).withColumns({id_col: F.concat(F.col(id_col), F.lit("_reverse")), array: F.reverse(array)}))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of each key the row that is last by ``order``, without sorting: the largest struct wins."""
    top = F.max(F.struct(*order, *(c for c in columns if c not in order)))
    return df.groupBy(*key).agg(top.alias("t")).select(*key, *(F.col(f"t.{c}").alias(c) for c in columns))


def leading_run(df: DataFrame, key: Sequence[str], order: str, good: Column) -> DataFrame:
    """How many rows of each key, from the first by ``order``, are good before one isn't."""
    first_bad = df.groupBy(*key).agg(F.min(F.when(~F.coalesce(good, F.lit(False)), F.col(order))).alias("bad"))
    s = first_bad.select(*(F.col(k).alias(f"_{k}") for k in key), "bad")
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(s, on).groupBy(*key).agg(F.count_if(F.col("bad").isNull() | (F.col(order) < F.col("bad"))).alias("run"))


def overlapping_intervals(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of half-open intervals ``[start, end)`` of one key that overlap; touching ones don't, empty ones never do.

    Both sides carry ``(key, id, start, end)`` with whole numbers; intervals are laid into cells of ``width`` and joined
    by key and cell, and a pair counts in the cell where the later of its starts lies, so that it comes once.
    """

    def cells(df: DataFrame, side: str) -> DataFrame:
        last = F.floor((F.col("end") - 1) / width)
        return df.where("start < end").select(F.col(key), F.col("id").alias(f"{side}_id"), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), F.explode(F.sequence(F.floor(F.col("start") / width), last)).alias("cell"))

    pairs = cells(left, "left").join(cells(right, "right"), [key, "cell"])
    start, end = F.greatest("left_start", "right_start"), F.least("left_end", "right_end")
    return pairs.where((start < end) & (F.floor(start / width) == F.col("cell"))).select(key, "left_id", "right_id", start.alias("start"), end.alias("end"))


def most_at_once(intervals: DataFrame, key: str, width: int) -> DataFrame:
    """``(key, cell, most)``: the most half-open intervals ``[start, end)`` that hold together in each cell of ``width``
    in which one holds at all.

    An interval gives one row where it starts and one where it ends, however long it is. Running sums cover one cell of
    one key; what holds when a cell begins comes from the sums of the cells before it, of which there are few.
    """
    step = lambda cell, t, d: F.struct(F.floor(cell / width).alias("cell"), t.alias("t"), F.lit(d).alias("d"))
    start, end = F.col("start"), F.col("end")
    steps = intervals.where("start < end").select(key, F.explode(F.array(step(start, start, 1), step(end - 1, end, -1))).alias("s")).groupBy(key, "s.cell", "s.t").agg(F.sum("s.d").alias("d"))
    within = Window.partitionBy(key, "cell").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = steps.withColumn("running", F.sum("d").over(within)).groupBy(key, "cell").agg(F.greatest(F.max("running"), F.lit(0)).alias("peak"), F.sum("d").alias("net"))
    in_order = Window.partitionBy(key).orderBy("cell")
    base = F.coalesce(F.sum("net").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = cells.withColumns({"base": base, "next": F.lead("cell").over(in_order)})
    after = (F.col("base") + F.col("net")).alias("most")
    between = F.when((after > 0) & (F.col("next") > F.col("cell") + 1), F.transform(F.sequence(F.col("cell") + 1, F.col("next") - 1), lambda c: F.struct(c.alias("cell"), after)))
    own = F.array(F.struct("cell", (F.col("base") + F.col("peak")).alias("most")))
    return known.select(key, F.explode(F.concat(own, F.coalesce(between, F.array().cast("array<struct<cell:bigint,most:bigint>>")))).alias("c")).select(key, "c.cell", "c.most")
