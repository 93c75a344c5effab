"""Contracts of requests, features and answers: everything that breaks one, as names in an array.

A null in a field that a rule needs breaks the rule; an empty array means that nothing is wrong.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decision as D

#: Roles of messages, a fixed list.
ROLES = ("system", "user", "assistant")


def broken(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the rules that are broken; a rule that can't be judged is."""
    return F.array_compact(F.array(*(F.when(F.coalesce(wrong, F.lit(True)), F.lit(name)) for name, wrong in rules)))


def request_errors(request: Column, least: int = 2, most: int = 26, tokens: int = 32_768) -> Column:
    """What is wrong with a request of messages and candidates."""
    messages, candidates = request["messages"], request["candidates"]
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return broken([
        ("no id", request["id"].isNull()), ("no messages", F.size(messages) < 1), ("unknown role", F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)))),
        ("no content", F.exists(messages, lambda m: blank(m["content"]))), ("number of candidates", ~F.size(candidates).between(least, most)), ("blank candidate", F.exists(candidates, blank)),
        ("repeated candidate", F.size(F.array_distinct(candidates)) < F.size(candidates)), ("token limit", ~request["max_input_tokens"].between(1, tokens)),
    ])


def feature_errors(x: Column, z: Column, gold: Column, features: int, most: int) -> Column:
    """What is wrong with a row to train on: its features, its logits, and the place of its gold candidate."""
    return broken([
        ("number of features", F.size(x) != features), ("feature not finite", F.exists(x, lambda v: ~D.finite(v))), ("number of candidates", ~F.size(z).between(2, most)),
        ("logit not finite", F.exists(z, lambda v: ~D.finite(v))), ("gold out of range", ~gold.between(0, F.size(z) - 1)),
    ])


def rederived(kind: Column, keys: Column, probabilities: Column) -> Column:
    """What follows from the probabilities by key: the likeliest label, its value by type, and the confidence."""
    p = F.transform(keys, lambda k: F.try_element_at(probabilities, k))
    whole = (F.size(keys) > 0) & ~F.exists(p, lambda x: x.isNull())
    value = F.when(kind == "score", D.expectation(p)).when(kind == "noul", F.try_element_at(probabilities, F.lit("true")))
    return F.when(whole, F.struct(D.at(keys, D.argmax(p)).alias("label"), F.array_max(p).alias("top"), value.alias("value"), D.confidence(p).alias("confidence")))


def parsed_label(text: Column, keys: Column) -> Column:
    """The candidate that a generated text names: the text itself without blanks, or the ``label`` of a JSON object."""
    plain = F.trim(text)
    of_json = F.try_variant_get(F.try_parse_json(text), "$.label", "string")
    return F.when(F.array_contains(keys, plain), plain).when(F.array_contains(keys, of_json), of_json)


def crossing_fields(cases: DataFrame, fields: Sequence[str], policy: str, split: str = "split") -> DataFrame:
    """``(field, value, splits)``: values that stand in several splits, of the fields that a policy keeps apart.

    ``none`` keeps nothing apart, ``group`` and ``family`` one field each (the first and second of ``fields``), ``both`` both.
    """
    kept = {"none": [], "group": fields[:1], "family": fields[1:2], "both": fields[:2]}[policy]
    rows = cases.select(split, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("t")).select(split, "t.*").where(F.col("field").isin(list(kept)) & F.col("value").isNotNull())
    return rows.groupBy("field", "value").agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits")).where(F.contains("splits", F.lit(",")))
