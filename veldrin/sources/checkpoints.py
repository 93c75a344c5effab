"""What is kept between runs: trained heads with the identity of what they were trained on, features by fingerprint,
the environment, and small reports."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.learning import Head

SCHEMA_VERSION = 1


def fingerprint(settings: dict) -> str:
    """SHA-256 of settings, whatever the order of their names."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def save_head(spark: SparkSession, head: Head, folder: str, temperature: float, identity: dict) -> None:
    """Write a head; an existing folder is an error."""
    rows = [(i, w, b) for i, (w, b) in enumerate(zip(head.weights.tolist(), head.bias.tolist()))]
    weights = spark.createDataFrame(rows, "slot int, weight array<double>, bias double")
    config = {"schema_version": SCHEMA_VERSION, "temperature": temperature, "identity": fingerprint(identity), "weights": _digest(head), "dev_nll": head.dev_nll, "rate": head.rate, "penalty": head.penalty, "epoch": head.epoch}
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/config")
    weights.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/weights")


def _digest(head: Head) -> str:
    return hashlib.sha256(np.ascontiguousarray(np.concatenate([head.weights, head.bias[:, None]], axis=1)).tobytes()).hexdigest()


def load_head(spark: SparkSession, folder: str, identity: dict) -> tuple[Head, float]:
    """Read a head and its temperature; anything that isn't as it was saved is an error."""
    config = json.loads(spark.read.text(f"{folder}/config").first()["value"])
    rows = spark.read.parquet(f"{folder}/weights").orderBy("slot").collect()  # as many as there are candidates
    head = Head(np.array([r["weight"] for r in rows]), np.array([r["bias"] for r in rows]), config["dev_nll"], config["rate"], config["penalty"], config["epoch"])
    wrong = [
        name
        for name, broken in (
            ("schema version", config["schema_version"] != SCHEMA_VERSION), ("identity", config["identity"] != fingerprint(identity)), ("weights", config["weights"] != _digest(head)),
            ("slots", [r["slot"] for r in rows] != list(range(len(rows)))), ("finite weights", not np.isfinite(head.weights).all()), ("temperature", not config["temperature"] > 0),
        )
        if broken
    ]
    if wrong:
        raise ValueError(f"checkpoint differs in: {', '.join(wrong)}")
    return head, config["temperature"]


def cached(spark: SparkSession, folder: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A table kept under the fingerprint of what it was made from; made once, then read."""
    path = f"{folder}/{fingerprint(settings)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def provenance(spark: SparkSession) -> DataFrame:
    """One row that says what ran where."""
    conf = {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith("spark.sql.")}
    return spark.createDataFrame([(spark.version, platform.python_version(), platform.machine(), fingerprint(conf))], "spark string, python string, machine string, settings string")


def file_rule_breaks(files: DataFrame, most: int = 50 << 20, endings: tuple[str, ...] = (".env", ".pem", ".key"), required: tuple[str, ...] = ()) -> DataFrame:
    """``(path, rule)``: files of an inventory that are too large or of a kind that isn't published, and missing ones."""
    name = F.substring_index("path", "/", -1)
    kind = F.lit(False)
    for e in endings:
        kind = kind | F.lower(name).endswith(e)
    broken = files.select("path", F.explode(F.array_compact(F.array(F.when(F.col("size") > most, "too large"), F.when(kind, "not for publication")))).alias("rule"))
    if not required:
        return broken
    wanted = files.sparkSession.createDataFrame([(r,) for r in required], "path string")
    missing = wanted.join(files.select(name.alias("path")), "path", "left_anti").withColumn("rule", F.lit("missing"))
    return broken.unionByName(missing)


def markdown(table: DataFrame, path: str, most: int = 1000) -> str:
    """A small metric table as Markdown, written to a local file; a table of more than ``most`` rows is an error."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    text = "\n".join([line(table.columns), line(["---"] * len(table.columns)), *map(line, rows)]) + "\n"
    Path(path).write_text(text, encoding="utf-8")
    return text
