"""Candidate sets of labelled cases: criteria as JSON text become ordered options.

Choices are sorted by key, or stay as written; binary cases have ``false`` and ``true`` in this order, with default
descriptions where criteria are missing; scores have their stages ``0, 1, ...``. Criteria that aren't valid for the
type, or that repeat a key, give no options; those of binary cases have both keys and no other. Nulls in other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPTION = "array<struct<key:string,description:string>>"


def kind_of(col: Column) -> Column:
    """The type of a case, however it is written."""
    return F.lower(F.trim(col))


def options(kind: Column, criteria: Column, canonical: bool = True) -> Column:
    """The ordered options of a case as ``(key, description)`` structs."""
    strict = F.when(F.try_parse_json(criteria).isNotNull(), criteria)
    entries = F.transform(F.map_entries(F.from_json(strict, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("description")))
    choice = F.array_sort(entries) if canonical else entries
    binary = F.from_json(strict, "map<string,string>")
    both = criteria.isNull() | (F.array_sort(F.map_keys(binary)) == F.array(F.lit("false"), F.lit("true")))
    noul = F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(F.try_element_at(binary, F.lit(k)), F.lit(k)).alias("description")) for k in ("false", "true")))
    stages = F.transform(F.from_json(strict, "array<string>"), lambda d, i: F.struct(i.cast("string").alias("key"), d.alias("description")))
    return F.when(kind == "choice", choice.cast(OPTION)).when((kind == "noul") & both, noul.cast(OPTION)).when(kind == "score", stages.cast(OPTION))


def with_options(cases: DataFrame, canonical: bool = True) -> DataFrame:
    """Cases with ``kind`` and ``options``."""
    kinds = cases.withColumn("kind", kind_of(F.col("type")))
    return kinds.withColumn("options", options(F.col("kind"), F.col("criteria"), canonical))


def option_rows(cases: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, kind, ord, key, description)``: one row for each option."""
    return with_options(cases).select(id_col, "kind", F.posexplode("options").alias("ord", "o")).select(id_col, "kind", "ord", "o.key", "o.description")


def first_error(cases: DataFrame, least: int = 2, most: int = 26) -> DataFrame:
    """Cases with ``error``: the first rule that a case breaks, null for valid cases."""
    keys = F.col("options.key")
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    rules = [
        ("no id", blank("id")), ("unknown type", ~F.coalesce(F.col("kind").isin("choice", "noul", "score"), F.lit(False))), ("no state", blank("state")), ("no instructions", blank("instructions")),
        ("criteria unreadable", F.coalesce(F.size("options"), F.lit(0)) <= 0), ("too few candidates", F.size("options") < least), ("too many candidates", F.size("options") > most),
        ("no label", blank("label")), ("label is no candidate", ~F.coalesce(F.array_contains(keys, F.trim("label")), F.lit(False))),
    ]
    return with_options(cases).withColumn("error", F.coalesce(*(F.when(broken, name) for name, broken in rules)))
