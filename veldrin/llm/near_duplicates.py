"""Near-equal records: ProbMinHash signatures, banding, and an exact check of every candidate.

Texts are cut into distinct three-character pieces whose weights rise from 1 to ``RATIO`` with their inverse document
frequencies over the whole table, so that a plain likeness bounds the weighted one that bands work on. Equal texts are one class, which is one row from the bands on; classes are compared, and ids come back by joins at the end.

Nulls: a record without an id, or whose required text folds to nothing, never counts; other null texts count
as empty. Repeated rows are one record. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folding import fold_codes, likeness, mix, piece_keys, pieces, to_codes, to_texts
from ..plans.staging import stage

REGISTERS = 64
#: 64-bit words that hold two bits of each register.
WORDS = REGISTERS // 32
BUCKETS = 1 << 16
#: Largest weight of a piece against the smallest.
RATIO = 1.2
BLOCK = 2000
#: Classes that a task remembers as already seen before it starts afresh.
REMEMBERED = 500_000
#: Classes seen by several tasks up to which they are broadcast to all rows; beyond it they are joined by a shuffle.
BROADCAST_CLASSES = 500_000

_U = np.uint64


def text_hash(text: str) -> tuple[int, int]:
    """128 bits of a text as two signed 64-bit numbers."""
    d = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def folded_records(df: DataFrame, id_col: str, required: str, others: Sequence[str]) -> DataFrame:
    """``(id, cls, alt, head, text)``: the folded texts one after another, 128 bits of them, and whether this row
    is the first of its class that its task saw (``head``); only heads go on to costly steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                ids = b.column(0).to_pylist()
                parts = [to_texts(*fold_codes(b.column(k + 1).to_pylist())) for k in range(1 + len(others))]
                out: list[tuple] = []
                for i, first, *rest in zip(ids, *parts):
                    if i is None or not first:
                        continue
                    text = first + "".join(rest)
                    h = text_hash(text)
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    out.append((i, *h, h not in seen, text))
                    seen.add(h)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    schema = pa.schema([("id", pa.string()), ("cls", pa.int64()), ("alt", pa.int64()), ("head", pa.bool_()), ("text", pa.string())])
    cols = [F.col(f"`{id_col}`").cast("string").alias("id"), *(F.col(f"`{c}`").alias(f"t{k}") for k, c in enumerate((required, *others)))]
    return df.select(*cols).mapInArrow(run, "id string, cls long, alt long, head boolean, text string")


def one_head(records: DataFrame, heads: dict[str, tuple[str, tuple[str, str]]]) -> dict[str, DataFrame]:
    """Of staged ``records`` with ``rid``, a row number, the first head of each class, for several kinds of class at once:
    by name, which rows are heads and the two hashes of their class.

    Tasks mark heads on their own, so that a popular text has as many as there are tasks. Only classes with several
    heads are looked at again: by their hashes, without their texts.
    """
    marks = [records.where(rows).select(F.lit(name).alias("_name"), F.col(key[0]).alias("_c"), F.col(key[1]).alias("_a"), "rid") for name, (rows, key) in heads.items()]
    counted = functools.reduce(DataFrame.unionByName, marks).groupBy("_name", "_c", "_a").agg(F.min("rid").alias("_keep"), F.max("rid").alias("_last"))
    several = stage(counted.where("_keep <> _last").drop("_last"), "repeated-heads")
    known = F.broadcast if several.count() <= BROADCAST_CLASSES else lambda df: df
    out = {}
    for name, (rows, key) in heads.items():
        own = known(several.where(F.col("_name") == name).select(F.col("_c").alias(key[0]), F.col("_a").alias(key[1]), "_keep"))
        out[name] = records.where(rows).join(own, list(key), "left").where("_keep IS NULL OR rid = _keep").drop("_keep")
    return out


def staged_records(records: DataFrame) -> DataFrame:
    """``records`` written once, with ``rid``, a row number of its own for each row."""
    return stage(records.withColumn("rid", F.monotonically_increasing_id()), "records")


def _elements(texts: list[str]) -> np.ndarray:
    return piece_keys(*pieces(*to_codes(texts)))


def piece_weights(texts: DataFrame) -> np.ndarray:
    """Weights of pieces in a fixed number of hash buckets, from 1 for a piece of all ``text`` rows to ``RATIO`` for one
    of a single row, by inverse document frequency."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS + 1, np.int64)
        for whole in batches:
            texts = whole.column(0).to_pylist()
            for at in range(0, len(texts), BLOCK):
                block = texts[at : at + BLOCK]
                n[:BUCKETS] += np.bincount((_elements(block) & _U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                n[BUCKETS] += len(block)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    n = np.zeros(BUCKETS + 1)
    for bucket, total in counted.collect():  # at most BUCKETS + 1 rows
        n[bucket] = total
    rarity = np.log((n[BUCKETS] + 1) / np.maximum(n[:BUCKETS], 1)) / np.log(n[BUCKETS] + 2)
    return 1 + (RATIO - 1) * np.clip(rarity, 0, 1)


def signatures(keys: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """ProbMinHash of ``n`` weighted sets.

    Every element is a Poisson process whose rate is its weight; each of its points falls into a random register,
    which keeps the element of its earliest point. The k-th points of all elements are drawn together, and an
    element stops as soon as its next point comes after the latest entry of its set's registers.
    """
    row = (keys >> _U(50)).astype(np.int64)
    element = keys & _U((1 << 50) - 1)
    rate = weights[(element & _U(BUCKETS - 1)).astype(np.int64)]
    first = np.full(n * REGISTERS, np.inf)
    holder = np.zeros(n * REGISTERS, _U)
    clock = np.zeros(len(keys))
    live, k = np.arange(len(keys)), 0
    while len(live):
        k += 1
        draw = mix(element[live] + _U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        clock = clock - np.log1p(-((draw >> _U(11)) * 2.0**-53)) / rate[live]
        at = row[live] * REGISTERS + (mix(draw ^ _U(0xD1B54A32D192ED03)) & _U(REGISTERS - 1)).astype(np.int64)
        better = np.flatnonzero(clock < first[at])
        np.minimum.at(first, at[better], clock[better])
        won = better[clock[better] == first[at[better]]]
        holder[at[won]] = element[live[won]]
        keep = clock < first.reshape(n, REGISTERS).max(axis=1)[row[live]]
        live, clock = live[keep], clock[keep]
    return holder.reshape(n, REGISTERS)


def band_rows(texts: DataFrame, weights: np.ndarray, bands: int, rows: int) -> DataFrame:
    """``(key, cls, s0, s1)``: one row for each band of each text; ``s0`` and ``s1`` hold two bits of every register."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers, whatever the table's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            classes = whole.column(0).to_numpy()
            texts = whole.column(1).to_pylist()
            for at in range(0, len(texts), BLOCK):
                block = texts[at : at + BLOCK]
                sig = signatures(_elements(block), len(block), shared.value)
                scattered = mix(sig)
                two = (scattered >> _U(62)).reshape(len(block), WORDS, 32) << (2 * np.arange(32)).astype(_U)
                words = [pa.array(w) for w in two.sum(axis=2, dtype=_U).view(np.int64).T.copy()]
                cls = classes[at : at + BLOCK]
                for band in range(bands):
                    key = np.full(len(block), band + 1, _U)
                    for r in range(band * rows, (band + 1) * rows):
                        key = mix(key * _U(0x9E3779B97F4A7C15) + scattered[:, r])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cls), *words], ["key", "cls", *(f"s{k}" for k in range(WORDS))])

    return texts.select("cls", "text").mapInArrow(run, "key long, cls long, " + ", ".join(f"s{k} long" for k in range(WORDS)))


def _differing(a: str, b: str) -> Column:
    """Registers whose two bits differ, of the 32 in a word."""
    x = F.col(a).bitwiseXOR(F.col(b))
    return F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))


def candidate_pairs(bands: DataFrame, most_differing: int) -> DataFrame:
    """``(a, b)``: classes that share a band and whose two-bit registers do not rule them out."""
    left = bands.select("key", F.col("cls").alias("a"), *(F.col(f"s{k}").alias(f"a{k}") for k in range(WORDS)))
    right = bands.select("key", F.col("cls").alias("b"), *(F.col(f"s{k}").alias(f"b{k}") for k in range(WORDS)))
    differing = functools.reduce(Column.__add__, (_differing(f"a{k}", f"b{k}") for k in range(WORDS)))
    near = left.join(right, "key").where(F.col("a") < F.col("b")).where(differing <= most_differing)
    return near.select("a", "b").distinct()


def checked_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Candidates ``(a, b)`` whose texts, from ``(cls, alt, text)`` rows, are at least ``threshold`` alike; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                alike = likeness(b.column("ta").to_pylist(), b.column("tb").to_pylist()) >= threshold
                yield b.filter(pa.array(alike)).select(["a", "aa", "b", "ab"])

    texts_a = left.select(F.col("cls").alias("a"), F.col("alt").alias("aa"), F.col("text").alias("ta"))
    texts_b = right.select(F.col("cls").alias("b"), F.col("alt").alias("ab"), F.col("text").alias("tb"))
    both = pairs.join(texts_a, "a").join(texts_b, "b").select("a", "aa", "ta", "b", "ab", "tb")
    return both.mapInArrow(run, "a long, aa long, b long, ab long").distinct()


def class_pairs(records: DataFrame, threshold: float = 0.6, bands: int = 21, rows: int = 3, most_differing: int = 32) -> DataFrame:
    """``(a, aa, b, ab)``: pairs of different texts, by their two hashes, that are at least ``threshold`` alike.

    Recall follows from the bands: two texts whose plain likeness is t have a weighted one s of at least
    ``t / (t + RATIO * (1 - t))``, 0.556 at 0.6, and share a band with probability ``1 - (1 - s**rows)**bands``, 0.98
    at 0.6. Of their registers ``3 / 4 * (1 - s)`` are expected to differ in two bits, at most 21.3 of 64 at 0.6 with a
    deviation of 3.8, so that 32 rule out one such pair in seven hundred. Precision is exact. ``records`` are staged.
    """
    heads = one_head(records, {"text": ("head", ("cls", "alt"))})["text"]
    keyed = band_rows(heads, piece_weights(heads), bands, rows)
    found = stage(candidate_pairs(keyed, most_differing), "candidates")
    texts = heads.select("cls", "alt", "text")
    return checked_pairs(found, texts, texts, threshold)


def expanded(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, smaller first: all pairs of ids within a class and across a pair of classes."""
    members = records.select("id", "cls", "alt").distinct()
    repeated = members.groupBy("cls", "alt").agg(F.count("*").alias("n")).where("n > 1")
    own = repeated.select(F.col("cls").alias("a"), F.col("alt").alias("aa"), F.col("cls").alias("b"), F.col("alt").alias("ab"))
    left = members.select(F.col("id").alias("x"), F.col("cls").alias("a"), F.col("alt").alias("aa"))
    right = members.select(F.col("id").alias("y"), F.col("cls").alias("b"), F.col("alt").alias("ab"))
    both = pairs.unionByName(own).join(left, ["a", "aa"]).join(right, ["b", "ab"])
    same = (F.col("a") == F.col("b")) & (F.col("aa") == F.col("ab"))
    return both.where(~same | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_pairs(df: DataFrame, id_col: str = "id", required: str = "state", others: Sequence[str] = ("instructions",), threshold: float = 0.6) -> DataFrame:
    """``(id_a, id_b)``: all pairs of records whose folded texts are at least ``threshold`` alike, equal ones too."""
    records = staged_records(folded_records(df, id_col, required, others))
    return expanded(class_pairs(records, threshold), records)


def near_duplicate_groups(df: DataFrame, id_col: str = "id", required: str = "state", others: Sequence[str] = ("instructions",), threshold: float = 0.6) -> DataFrame:
    """``(id, group_id, copies, links)``: one row for each record.

    ``group_id`` is the smallest id of the connected group, ``copies`` the number of records with the same text,
    itself included, and ``links`` the number of other texts that are at least ``threshold`` alike.
    """
    records = staged_records(folded_records(df, id_col, required, others))
    pairs = stage(class_pairs(records, threshold), "pairs")
    members = records.select("id", "cls", "alt").distinct()
    classes = stage(members.groupBy("cls", "alt").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "classes")
    a = classes.select(F.col("cls").alias("a"), F.col("alt").alias("aa"), F.col("node").alias("u"))
    b = classes.select(F.col("cls").alias("b"), F.col("alt").alias("ab"), F.col("node").alias("v"))
    edges = stage(pairs.join(a, ["a", "aa"]).join(b, ["b", "ab"]).select("u", "v"), "edges")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = both.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("links"))
    labels = smallest_reachable(edges)
    full = classes.join(labels, "node", "left").join(links, "node", "left")
    out = members.join(full, ["cls", "alt"])
    return out.select("id", F.coalesce("label", "node").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node of each connected group of ``(u, v)`` links.

    Each round hangs the larger neighbours of a node onto its smallest one, then the neighbours below it, until no
    link changes: the number of rounds grows with the logarithm of a group's diameter.
    """

    def hang(links: DataFrame, onto_larger: bool) -> DataFrame:
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if onto_larger else links
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        joined = around.join(least, "u")
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if onto_larger else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    links = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = mark(links)
    while True:
        wide = stage(hang(links, True), "large-star")
        links = stage(hang(wide.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), "small-star")
        now = mark(links)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
