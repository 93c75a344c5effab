"""Audits of data sets: signatures, leakage across splits, overlaps, similarity, balance and hygiene.

Null keys are no keys: they never count as repeated or leaking. Null texts have no pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of things that shouldn't be published, as fixed values.
SECRETS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}",
    "url": r"https?://[^\s]+",
    "private_path": r"/(?:home|Users)/[A-Za-z0-9._-]+",
    "long_number": r"[0-9]{12,}",
    "reference_code": r"[A-Z]{2}-?[0-9]{6}",
    "chat_mark": r"<\|[a-z_]+\|>",
}


def collapsed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def signature(*fields: Column) -> Column:
    """SHA-256 of fields that keeps null apart from empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), f), F.lit("!")) for f in fields)), 256)


def repeated(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that stand more than once, with how often."""
    whole = df.dropna(subset=list(key))
    return whole.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def crossing(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Values of ``key`` that stand in more than one split: ``(key, rows, splits)``, the splits in order."""
    found = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"))
    return found.where(F.contains("splits", F.lit(",")))


def protected_overlap(new: DataFrame, protected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` that share any of the keys with ``protected``, with the names of these keys."""
    marked = new
    for k in keys:
        known = protected.select(F.col(k).alias(f"_{k}")).distinct()
        marked = marked.join(known, F.col(k) == F.col(f"_{k}"), "left")
    hits = F.array_compact(F.array(*(F.when(F.col(f"_{k}").isNotNull(), k) for k in keys)))
    return marked.withColumn("shared", hits).drop(*(f"_{k}" for k in keys)).where(F.size("shared") > 0)


def with_trigrams(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the distinct character trigrams of a text whose digit runs are masked, each packed into one number.

    The characters are a column of their own on the way, so that they are made once.
    """
    c, n = F.col("_chars"), F.size("_chars")
    pair = lambda x, y: F.shiftleft(x, 21) + y
    two = F.zip_with(F.slice(c, 1, n - 2), F.slice(c, 2, n - 2), pair)
    grams = F.when(n >= 3, F.array_distinct(F.zip_with(two, F.slice(c, 3, n - 2), pair))).otherwise(F.array().cast("array<bigint>"))
    chars = F.transform(F.split(F.regexp_replace(F.col(text), "[0-9０-９]+", "N"), ""), lambda x: F.ascii(x).cast("long"))
    return df.withColumn("_chars", chars).withColumn(name, grams).drop("_chars")


def nearest_protected(new: DataFrame, new_id: str, new_text: str, protected: DataFrame, protected_id: str, protected_text: str) -> DataFrame:
    """``(new_id, protected_id, likeness)``: of each new text the most similar protected one by trigram Jaccard.

    Shared trigrams are found by an equality join on the trigram, so only pairs that share one are counted; the
    protected side is the small one. Ties go to the smaller id.
    """
    a = with_trigrams(new.select(F.col(new_id).alias("a"), F.col(new_text).alias("_text")), "_text", "t").withColumn("na", F.size("t"))
    b = with_trigrams(protected.select(F.col(protected_id).alias("b"), F.col(protected_text).alias("_text")), "_text", "t").withColumn("nb", F.size("t"))
    # the outer form, for the inner one is preceded by a filter that makes all trigrams once more
    shared = a.select("a", "na", F.explode_outer("t").alias("g")).join(b.select("b", "nb", F.explode_outer("t").alias("g")), "g").groupBy("a", "na", "b", "nb").agg(F.count("*").alias("s"))
    likeness = F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))
    best = shared.withColumn("likeness", likeness).groupBy("a").agg(F.min(F.struct((-F.col("likeness")).alias("m"), "b")).alias("top"))
    return best.select(F.col("a").alias(new_id), F.col("top.b").alias(protected_id), F.round(-F.col("top.m"), 6).alias("likeness"))


def balance(df: DataFrame, by: Sequence[str], position: str, most: str) -> DataFrame:
    """Per stratum the counts of positions from 0 to ``most`` - 1, unused ones too: largest and smallest count."""
    counts = df.groupBy(*by, most, position).agg(F.count("*").alias("_n"))
    strata = counts.select(*by, most).distinct().select(*by, most, F.explode(F.sequence(F.lit(0), F.col(most) - 1)).alias(position))
    full = strata.join(counts, [*by, most, position], "left").fillna({"_n": 0})
    return full.groupBy(*by, most).agg(F.max("_n").alias("largest"), F.min("_n").alias("smallest"))


def secret_counts(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """Matches of each pattern, in rows and in all; the matches themselves are never shown."""
    found = [F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)).alias(name) for name, p in SECRETS.items()]
    sums = [F.sum(name).cast("long").alias(name) for name in SECRETS]
    return df.select(*by, *found).groupBy(*by).agg(F.count("*").alias("rows"), *sums)
