"""Typed answers of a scorer: prompts, logits with a residual head, the answer itself, and everything that may be wrong.

Rows come with ``kind``, ``keys`` and ``z``, the candidates and their logits by position. Nulls in an answer are
errors of their own name; rows without logits have a null answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decision as D


def prompt(state: Column, instructions: Column, options: Column, symbols: Column, repeat: int = 1) -> Column:
    """The text shown to a scorer: state, question and lettered options; ``repeat`` puts the whole body so many times."""
    shown = F.array_join(F.zip_with(symbols, options, lambda s, o: F.concat(s, F.lit(") "), F.coalesce(o["description"], o["key"]))), "\n")
    body = F.concat_ws("\n", F.lit("[state]"), state, F.lit("[question]"), instructions, F.lit("[options]"), shown)
    return F.concat_ws("\n\n", *[body] * repeat)


def gathered(full: Column, ids: Column) -> Column:
    """The logits of the candidates, by their places from 0 in the whole vocabulary."""
    return F.transform(ids, lambda i: F.get(full, i))


def candidate_mass(candidates: Column, full: Column) -> Column:
    """The share of the whole vocabulary's probability that the candidates have."""
    return F.exp(D.log_sum_exp(candidates) - D.log_sum_exp(full))


def projected(hidden: Column, rows: Column) -> Column:
    """Logits of the candidates only: the products of a hidden vector with their rows."""
    return F.transform(rows, lambda w: D.dot(w, hidden))


def residual_logits(base: Column, hidden: Column, weights: Column, bias: Column) -> Column:
    """Base logits plus a linear correction of the normalised hidden vector."""
    correction = D.let(D.rms_normalised(hidden), lambda h: F.zip_with(F.transform(weights, lambda w: D.dot(w, h)), bias, lambda a, b: a + b))
    return F.zip_with(base, correction, lambda a, b: a + b)


def typed_answer(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Rows with ``answer``: label, probabilities, confidence and the value of the type."""
    p, kind = F.col("_p"), F.col("kind")
    answer = F.struct(
        D.at(F.col("keys"), D.argmax(p)).alias("label"), p.alias("probabilities"), D.confidence(p).alias("confidence"), F.when(kind == "choice", D.at(F.col("keys"), D.argmax(p))).alias("choice"),
        F.when(kind == "noul", D.at(p, F.array_position("keys", F.lit("true")).cast("int") - 1)).alias("noul"), F.when(kind == "score", D.expectation(p)).alias("score"), F.lit(float(temperature)).alias("temperature"), F.lit(False).alias("calibrated"),
    )
    return rows.withColumn("_p", D.softmax(F.col("z"), temperature)).withColumn("answer", F.when(F.col("_p").isNotNull(), answer)).drop("_p")


def answer_errors(label: Column, keys: Column, probabilities: Column, logits: Column, confidence: Column, tokens: Column, latency: Column) -> Column:
    """Everything that is wrong with an answer whose ``probabilities`` are a map by key; an empty array if nothing is."""
    values = F.map_values(probabilities)
    present = F.filter(values, lambda x: x.isNotNull())
    number = lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
    same_keys = (F.size(probabilities) == F.size(keys)) & (F.size(F.array_except(keys, F.map_keys(probabilities))) == 0)
    rules = [
        ("no label", label.isNull()), ("label is no candidate", ~F.array_contains(keys, label)), ("no probabilities", probabilities.isNull() | (F.size(probabilities) == 0)), ("other keys", ~same_keys),
        ("probability missing", F.size(present) < F.size(values)), ("probability out of range", F.exists(present, lambda x: F.isnan(x) | (x < 0) | (x > 1))), ("sum is not one", (F.size(present) > 0) & (F.abs(D.total(present) - 1) > 1e-5)),
        ("label is not the likeliest", F.try_element_at(probabilities, label) < F.array_max(present) - 1e-7), ("logits missing", logits.isNull() | (F.size(logits) != F.size(keys))), ("logit not finite", F.exists(logits, lambda x: ~D.finite(x))),
        ("confidence out of range", ~number(confidence) | (confidence < 0) | (confidence > 1)), ("no tokens", tokens.isNull() | (tokens <= 0)), ("no latency", ~number(latency) | (latency < 0)),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules)))


def same_decision(a: Column, b: Column, fields: Sequence[str], tolerance: float = 0.0) -> Column:
    """Whether two answers agree in all fields; numbers may differ by ``tolerance``."""
    same = F.lit(True)
    for f in fields:
        exact = a[f].eqNullSafe(b[f])
        same = same & (exact if not tolerance else F.coalesce(exact | (F.abs(a[f].try_cast("double") - b[f].try_cast("double")) <= tolerance), F.lit(False)))
    return same


def within_limit(rows: DataFrame, tokens: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows that fit, and the others, which are errors: nothing is ever cut to fit. Unknown sizes are errors too."""
    fits = F.coalesce(F.col(tokens) <= limit, F.lit(False))
    return rows.where(fits), rows.where(~fits)


def count_differences(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups that two tables don't have equally often: ``(by, left, right)``; null keys are a group."""
    marked = a.select(*by, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(*by, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return marked.groupBy(*by).agg(F.sum("l").alias("left"), F.sum("r").alias("right")).where(F.col("left") != F.col("right"))
