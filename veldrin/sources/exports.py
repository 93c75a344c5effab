"""Exports: JSON lines and CSV side by side, never over other data, and read back to compare."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jsonl import inventory


def export_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as text; nested ones as JSON."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*((F.to_json(c) if isinstance(df.schema[c].dataType, nested) else F.col(c).cast("string")).alias(c) for c in columns))


def export(df: DataFrame, folder: str, columns: Sequence[str]) -> None:
    """Write ``folder/jsonl`` and ``folder/csv``; an existing folder is an error."""
    rows = export_rows(df, columns)
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{folder}/jsonl")
    rows.write.mode("errorifexists").options(header=True, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).option("quoteAll", True).option("escape", '"').option("nullValue", "\\N").option("emptyValue", "").csv(f"{folder}/csv")


def write_json(df: DataFrame, path: str) -> None:
    """Write JSON lines over what is there; a NaN or an infinite number in a column stops the write before it is committed."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    endless = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    guarded = {n: F.when(endless(F.col(f"`{n}`")), F.raise_error(F.lit(f"{n} isn't a finite number"))).otherwise(F.col(f"`{n}`")) for n in numbers}
    (df.withColumns(guarded) if guarded else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, size, sha256)`` of the data files of an export, with paths below its folder."""
    below = F.regexp_extract("path", r"((?:jsonl|csv)/[^/]+)$", 1)
    return inventory(spark, folder, "part-*").select(below.alias("path"), "size", "sha256")


def attempted(spark: SparkSession, folder: str, work: Callable[[], None]) -> None:
    """Do ``work``; if it fails, leave ``folder/failure`` with the kind and text of the error, and what was written until
    then, and fail."""
    try:
        work()
    except Exception as e:
        record = json.dumps({"error": type(e).__name__, "message": str(e)}, ensure_ascii=False)
        spark.range(1).select(F.lit(record).alias("value")).write.mode("overwrite").text(f"{folder}/failure")
        raise


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """An exported CSV, all columns as text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(header=True, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).option("multiLine", True).option("escape", '"').option("nullValue", "\\N").option("emptyValue", "").csv(path)


def round_trip_differences(df: DataFrame, folder: str, columns: Sequence[str]) -> DataFrame:
    """Rows that the two exports and ``df`` don't have alike, with where they stand; empty for a faithful export."""
    spark = df.sparkSession
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = export_rows(df, columns)
    jsonl = spark.read.schema(schema).json(f"{folder}/jsonl")
    csv = read_csv(spark, f"{folder}/csv", columns)
    parts = [(a.exceptAll(b)).withColumn("only_in", F.lit(name)) for name, a, b in (("data", rows, jsonl), ("jsonl", jsonl, rows), ("data", rows, csv), ("csv", csv, rows))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
