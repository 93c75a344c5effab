"""Whole reports of runs and answers, and checks of what was recorded against what follows from it.

Null flags count as false, null measures stay out of means; a null group is a group of its own; empty tables give no groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decision as D
from .arranging import sampled
from .metrics import accuracy_aggregates, flag, rounded


def run_summary(rows: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Accuracy, invalid answers, failures, times, tokens and how choices keep their order, over all ``sets`` of grouping columns in one pass."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    turned = F.count("reverse")
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(
        *accuracy_aggregates(), F.count_if(~flag("valid")).alias("invalid"), F.count("error").alias("failed"), rounded(F.avg("wall_ms"), "mean_ms"), F.min("wall_ms").alias("shortest_ms"), F.max("wall_ms").alias("longest_ms"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), turned.alias("turned"), F.round(F.try_divide(F.count_if("reverse.same_label"), turned), 6).alias("order_kept"), F.grouping_id().cast("int").alias("level"),
    )


def answer_summary(scored: DataFrame, sets: Sequence[Sequence[str]], floor: float = 1e-15) -> DataFrame:
    """Count, accuracy, NLL, Brier and expected-stage error of ``(p, gold)`` rows over all ``sets`` of grouping columns in one pass."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    p, gold = F.col("p"), F.col("gold")
    rows = scored.select(*every, "gold", (D.argmax(p) == gold).alias("hit"), D.nll(D.at(p, gold), floor).alias("nll"), F.when(gold.isNotNull(), D.brier(p, gold)).alias("brier"), F.abs(D.expectation(p) - gold).alias("off"))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(F.count("*").alias("n"), F.count("gold").alias("labelled"), F.count_if("hit").alias("correct"), rounded(F.avg("nll"), "nll"), rounded(F.avg("brier"), "brier"), rounded(F.avg("off"), "mae"), F.grouping_id().cast("int").alias("level"))


def with_family(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with ``family`` from the first of these columns that isn't null."""
    return rows.withColumn("family", F.coalesce(*(F.col(n).cast("string") for n in names)))


def unexpected_counts(rows: DataFrame, by: str, expected: dict[str, int]) -> DataFrame:
    """``(by, n, expected)`` of the groups whose size isn't the expected one; those not named should have no rows."""
    want = rows.sparkSession.createDataFrame(list(expected.items()), f"_k {rows.schema[by].dataType.simpleString()}, expected bigint")
    both = rows.groupBy(by).agg(F.count("*").alias("n")).join(want, F.col(by).eqNullSafe(F.col("_k")), "full_outer")
    sizes = both.select(F.coalesce(by, "_k").alias(by), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return sizes.where("n <> expected")


def balanced_new(candidates: DataFrame, known: DataFrame, key: str, id_col: str, by: Sequence[str], k: int, seed: str) -> DataFrame:
    """``k`` candidates of each group, in seeded order, of those whose key isn't known and that are the first by id with it."""
    first = candidates.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias(id_col))
    new = candidates.join(first, [key, id_col], "left_semi").join(known.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return sampled(new, id_col, by, k, seed)


def positional(rows: DataFrame, keep: Sequence[str], **arrays: str) -> DataFrame:
    """One row for each position of the arrays, with their entries side by side; a shorter array has nulls."""
    zipped = F.posexplode(F.arrays_zip(*(F.col(c).alias(n) for n, c in arrays.items()))).alias("pos", "_z")
    return rows.select(*keep, zipped).select(*keep, "pos", *(F.col("_z").getField(n).alias(n) for n in arrays))


def order_free(entries: Column) -> Column:
    """SHA-256 of a list of texts whose order and repeats don't matter; nulls stay out."""
    return F.sha2(F.concat_ws("\x1e", F.array_sort(F.array_distinct(entries))), 256)


def is_sha256(col: Column) -> Column:
    return F.coalesce(col.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_commit(col: Column) -> Column:
    return F.coalesce(col.rlike("^[0-9a-f]{40}$"), F.lit(False))
