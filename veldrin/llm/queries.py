"""Queries of the training-data operators; most have no SQL form and are tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import table
from .format_duplicates import copy_counts, format_copies
from .leaks import leaked_items
from .near_duplicates import near_duplicate_groups, near_duplicate_pairs
from .selection import select_percentiles, sorted_runs
from .split_overlap import overlap_report, overlapping
from .tokens import encoded
from .truncation import truncated, truncation_rates


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf_dir, "eval_ja"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "eval_ja"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies(table(spark, sf_dir, "eval_ja"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_counts(table(spark, sf_dir, "eval_ja"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlapping(table(spark, sf_dir, "eval_ja"))
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "eval_ja")
    return overlap_report(overlapping(cases), cases)


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "run_acceptance")
    dimensions = {"type": F.col("type"), "source": F.col("source"), "engine": F.col("engine"), "day": F.date_format("started_at", "yyyy-MM-dd")}
    return select_percentiles(sorted_runs(answers, dimensions, ["wall_ms", "input_tokens"]), [500, 900, 950, 990])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the leaks within the budget of edits those that hold a whole run unchanged."""
    return p7_evidence(spark, sf_dir).where("longest >= 40").select("doc_id", "item_id")


def p7_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_item"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_rates(truncated(table(spark, sf_dir, "documents")))


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p5_percentiles": p5_percentiles,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_evidence": p7_evidence,
    "p8_found": p8_found,
    "p8_rates": p8_rates,
}
ORACLE_SQL: dict[str, str] = {
    "p5_percentiles": """
        WITH longer AS (
            SELECT u.dimension, u.grp, m.metric, m.v
            FROM run_acceptance,
                LATERAL (VALUES ('type', type), ('source', source), ('engine', engine), ('day', strftime(started_at, '%Y-%m-%d'))) u(dimension, grp),
                LATERAL (VALUES ('wall_ms', wall_ms), ('input_tokens', CAST(input_tokens AS DOUBLE))) m(metric, v)
            WHERE m.v IS NOT NULL AND NOT isnan(m.v)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY dimension, grp, metric ORDER BY v) AS rn, count(*) OVER (PARTITION BY dimension, grp, metric) AS n
            FROM longer
        )
        SELECT dimension, grp, metric, CAST(p AS INTEGER) AS permille, n, v AS value
        FROM ranked, (VALUES (500), (900), (950), (990)) q(p)
        WHERE rn = greatest((n * p + 999) // 1000, 1)
    """,
}
