"""Strict JSON lines: every record is either read or rejected with a reason, and nothing is lost.

Blank lines are skipped, a byte order mark at the start of a file is allowed, records over the limit, broken JSON,
repeated keys, ``NaN`` and missing or unknown fields are rejected. An empty file gives no rows on either side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 1 << 20


def checked(lines: DataFrame, required: Sequence[str], optional: Sequence[str] = (), value: str = "value", limit: int = LIMIT) -> DataFrame:
    """Lines with ``record`` as VARIANT and ``error``, null for good ones."""
    text = F.regexp_replace(F.col(value), "^\ufeff", "")
    parsed = lines.withColumn("_text", text).where(F.trim("_text") != "").withColumn("record", F.try_parse_json("_text"))
    keys = F.json_object_keys("_text")
    lists = F.array(*map(F.lit, required)), F.array(*map(F.lit, [*required, *optional]))
    error = F.coalesce(
        F.when(F.octet_length("_text") > limit, "too long"), F.when(F.col("record").isNull(), "not valid JSON"), F.when(keys.isNull(), "not an object"),
        F.when(F.size(F.array_except(lists[0], keys)) > 0, "missing field"), F.when(F.size(F.array_except(keys, lists[1])) > 0, "unknown field"),
    )
    return parsed.withColumn("error", error)


def read_cases(spark: SparkSession, path: str, schema: T.StructType, optional: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Typed rows and rejected lines ``(file, error, value)`` of JSON lines files; ``schema`` names the required fields
    and the ``optional`` ones."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    required = [f.name for f in schema.fields if f.name not in optional]
    marked = checked(lines, required, optional)
    rows = marked.where("error IS NULL").select(F.from_json("_text", schema).alias("r")).select("r.*")
    return rows, marked.where("error IS NOT NULL").select("file", "error", "value")


def unlabelled(spark: SparkSession, path: str, schema: T.StructType, label: str = "label") -> DataFrame:
    """Prediction input, a JSON object or an array of them: rows with ids ``prediction-0``, ``prediction-1``, ...; a row
    that carries a label is an error."""
    whole = spark.read.text(path, wholetext=True)
    as_list = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    rows = whole.select(F.posexplode(F.from_json(as_list, T.ArrayType(T.StructType([*schema.fields, T.StructField(label, T.StringType())])))))
    guarded = F.when(F.col(f"col.{label}").isNotNull(), F.raise_error(F.lit("prediction input must not carry a label"))).otherwise(F.concat(F.lit("prediction-"), "pos"))
    return rows.select(guarded.alias("id"), *(F.col(f"col.{f.name}").alias(f.name) for f in schema.fields))


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, size, sha256)`` of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_differences(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths that are missing, new or changed against a manifest of ``(path, sha256)``."""
    old = manifest.select("path", F.col("sha256").alias("was"))
    both = now.select("path", "sha256").join(old, "path", "full_outer")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("sha256") != F.col("was"), "changed")
    return both.select("path", state.alias("state")).where("state IS NOT NULL")
