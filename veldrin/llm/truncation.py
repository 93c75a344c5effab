"""Texts cut off before their end: a backward model of the characters that texts end with.

Texts are read as symbols: a letter run of one script, a number or a word that begins in upper case is one symbol of
its class and size, a lower-case word one of its own, other characters stand for themselves. For the last 1, 2, ... ``ORDER`` symbols of each text, read backward, the model knows
how often they stand anywhere in the corpus, how often a line ends there, and how often a different text does. The longer contexts are
smoothed by the shorter ones, without the text's own end, and the log-odds of ending against going on are held
against a threshold for the text's language and source. Blanks and omission marks at the end are left out first.

Nulls: null, empty and blank texts are not cases; a row without an id gives nothing; null sources and languages are
groups of their own. Texts that are repeated count once in the model and each get their result. An empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folding import mix, to_codes
from ..plans.staging import stage

ORDER = 12
BLOCK = 500
#: Texts that a task remembers as already seen before it starts afresh.
REMEMBERED = 500_000
#: Bits of the filter for each final context, and how many bits it has at least and at most (32 MB, which is broadcast).
BITS_A_CONTEXT, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
#: Weight of the shorter context in that of the longer one.
KAPPA = 100.0
#: What the end of a line counts for against the end of a text.
LINE = 0.1
#: Log-odds above those of ending anywhere between which the threshold of a group is looked for, and the width of a bin.
LOWEST, HIGHEST, BIN = 0.75, 2.0, 0.25
#: Texts whose weight the threshold of all has in that of a language, and that of a language in that of its sources.
WEIGHT_OF_ALL, WEIGHT_OF_LANGUAGE = 500, 5000
#: How much more a text at a size where its source piles up may speak for an end and still be a cut.
AT_LIMIT = 0.6
#: A size is a limit where so many times as many texts of its source have it as other sizes up to ``AROUND`` away, each of
#: which counts as half a text at least.
PILED, AROUND, LEAST_OTHERS = 10, 25, 0.5
#: Blanks and omission marks that may follow a cut; fixed values.
TAIL = regex.compile(r"(?:\s|…|‥|⋯|\.{2,}|�|\[(?:\.{3}|…|truncated|cut|more|続く|以下略|省略)\]|[(（](?:\.{3}|…|truncated|cut|more|続く|以下略|省略)[)）])+\Z", regex.IGNORECASE)

_U = np.uint64
#: Classes of code points: others stand for themselves.
_SELF, _DIGIT, _UPPER, _LOWER, _KATAKANA, _SCRIPT = range(6)


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point up to U+FFFF; beyond it characters stand for themselves."""
    out = np.zeros(0x10000, np.int8)
    for c in range(0x10000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Nd":
            out[c] = _DIGIT
        elif 0x30A1 <= c <= 0x30FA or c == 0x30FC:
            out[c] = _KATAKANA
        elif c < 0x250:
            out[c] = _UPPER if kind == "Lu" else _LOWER if kind == "Ll" else _SELF
        elif kind[0] in "LM" and c < 0x2E80:
            out[c] = _SCRIPT
    return out


class Filter:
    """Lets through all contexts whose bit is set."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, ctx: np.ndarray) -> np.ndarray:
        at = (ctx >> _U(20) & _U(64 * len(self.words) - 1)).astype(np.int64)
        return (self.words[at >> 6] >> (at & 63).astype(_U) & _U(1)).astype(bool)


class Symbols:
    """The texts of a block (each with one character at least) as symbols.

    ``value`` is, for each character, the symbol of its run as far as this character, so that a word that stops early
    looks like the beginning of longer ones; ``whole`` are the symbols of whole runs, ``run`` is the run of each
    character, and ``first`` the first run of its text, which is a mark of the beginning.
    """

    def __init__(self, texts: list[str]):
        codes, starts = to_codes(texts)
        kind = np.where(codes < 0x10000, _classes()[np.minimum(codes, 0xFFFF)], _SELF)
        row = np.repeat(np.arange(len(texts)), np.diff(starts))
        group = np.where(kind == _LOWER, _UPPER, kind)
        new = np.ones(len(codes), bool)
        new[1:] = (group[1:] != group[:-1]) | (group[1:] == _SELF) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(codes)))
        start = np.repeat(begin, length)
        so_far = np.arange(len(codes)) - start + 1
        first_kind = kind[start]
        # the hash of a lower-case word grows by each letter
        sums = np.cumsum(mix(codes.astype(_U) + (so_far.astype(_U) << _U(32))), dtype=_U)
        word = sums - np.where(start > 0, sums[start - 1], _U(0))
        self.value = np.select(
            [first_kind == _SELF, first_kind == _DIGIT, first_kind == _UPPER, first_kind == _LOWER],
            [codes.astype(_U), (np.clip(so_far, 3, 9) + (1 << 32)).astype(_U), (np.clip(so_far, 1, 5) + (2 << 32)).astype(_U), word | _U(1 << 63)],
            (first_kind.astype(_U) + _U(3)) << _U(32),
        )
        # a single lower-case letter, as in a code, is a class of its own
        self.value[(first_kind == _LOWER) & (so_far == 1)] = 6 << 40
        runs = np.bincount(row[begin], minlength=len(texts)) + 1
        edges = np.concatenate([[0], np.cumsum(runs)])
        place = np.arange(len(begin)) + row[begin] + 1
        self.whole = np.full(edges[-1], 7 << 40, _U)
        self.whole[place] = self.value[begin + length - 1]
        self.run = np.repeat(place, length)
        self.first = edges[:-1][row]
        self.ends = starts[1:] - 1
        breaks = np.append((codes[1:] == 10) | (codes[1:] == 13), False)
        breaks[self.ends] = False
        self.breaks = breaks.astype(_U)

    def contexts(self, at: np.ndarray, open_: Filter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order, characters and the hashes (even numbers) of the symbols that end there.

        Characters before which the text has no further symbol drop out, and so do those that a filter ``open_`` keeps
        out: it lets through all final contexts, of which every longer one ends with a shorter one.
        """
        h = np.zeros(len(at), _U)
        for n in range(ORDER):
            there = self.run[at] - n >= self.first[at]
            if not there.all():
                at, h = at[there], h[there]
            h = mix(h * _U(0x9E3779B97F4A7C15) + (self.value[at] if n == 0 else self.whole[self.run[at] - n]) + _U(n + 1))
            if open_ is not None:
                passed = open_.has(h & ~_U(1))
                at, h = at[passed], h[passed]
            yield at, h & ~_U(1)


def trimmed(text: str) -> str:
    """The text without blanks and omission marks at its end."""
    return TAIL.sub("", text.rstrip()) if text else ""


def _same(text: str) -> int:
    """64 bits of a text, signed."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _blocks(batches: Iterator[pa.RecordBatch], col: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[str]]]:
    """Blocks of rows whose trimmed text isn't empty."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            b = whole.slice(at, BLOCK)
            texts = [trimmed(t) if t else "" for t in b.column(col).to_pylist()]
            kept = np.array([i for i, t in enumerate(texts) if t], np.int64)
            if len(kept):
                yield b, kept, [texts[i] for i in kept.tolist()]


def final_contexts(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, lang, same, chars, bytes, ctx)``: the hashes of each text's final contexts by order."""
    names = ["doc_id", "source", "lang", "same", "chars", "bytes", "ctx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, kept, texts in _blocks(batches, 3):
            found = list((own := Symbols(texts)).contexts(own.ends))
            row = np.searchsorted(own.ends, np.concatenate([at for at, _ in found]))
            order = np.argsort(row, kind="stable")
            values = np.concatenate([h for _, h in found])[order].view(np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]), pa.int32())
            same = pa.array([_same(t) for t in texts], pa.int64())
            rows = b.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), same, pa.array([len(t) for t in texts], pa.int32()), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(values))], names)

    return docs.mapInArrow(run, "doc_id long, source string, lang string, same long, chars int, bytes int, ctx array<long>")


def endings(ends: DataFrame) -> DataFrame:
    """``(ctx, ends)``: final contexts and how many different texts end with them."""
    distinct = ends.groupBy("same").agg(F.first("ctx").alias("ctx"))
    return distinct.select(F.explode("ctx").alias("ctx")).groupBy("ctx").agg(F.count("*").alias("ends"))


def final_filter(known: DataFrame) -> Filter:
    """A filter that lets through every final context, of a size in proportion to their number up to ``MOST_BITS``."""
    bits = min(max(known.count() * BITS_A_CONTEXT, LEAST_BITS), MOST_BITS)
    size = 1 << int(bits - 1).bit_length()
    at = F.shiftrightunsigned("ctx", 20).bitwiseAND(F.lit(size - 1))
    word, bit = F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    found = known.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()  # MOST_BITS / 64 rows at most
    out = np.zeros(size // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return Filter(out.view(_U))


def different_texts(docs: DataFrame) -> DataFrame:
    """``(text)``: every trimmed text once, however often it is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, texts in _blocks(batches, 0):
            if len(seen) > REMEMBERED:
                seen.clear()
            new = {h: t for t in texts if (h := _same(t)) not in seen}
            seen |= new.keys()
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.string())], ["same", "text"])

    return docs.select("text").mapInArrow(run, "same long, text string").groupBy("same").agg(F.first("text").alias("text")).select("text")


def occurrences(docs: DataFrame, final: Filter) -> DataFrame:
    """``(ctx, n, lines)``: how often contexts that pass the filter stand anywhere in the different texts, and at a
    line's end."""
    shared = docs.sparkSession.sparkContext.broadcast(final.words)  # MOST_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = Filter(shared.value)
        for _, _, texts in _blocks(batches, 0):
            own = Symbols(texts)
            every = np.sort(np.concatenate([h | own.breaks[at] for at, h in own.contexts(np.arange(len(own.value)), open_)]))
            new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(every)))
            at_line = (every[new] & _U(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((every[new] & ~_U(1)).view(np.int64)), pa.array(n, pa.int64()), pa.array(n * at_line, pa.int64())], ["ctx", "n", "lines"])

    return different_texts(docs).mapInArrow(run, "ctx long, n long, lines long").groupBy("ctx").agg(F.sum("n").alias("n"), F.sum("lines").alias("lines"))


def end_odds(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """``(doc_id, source, lang, same, chars, bytes, log_odds)`` of every text that isn't blank: of ending where it does
    against going on, above those of ending anywhere, so that they don't depend on how long texts are; ``same`` are 64
    bits of the text."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    ends = stage(final_contexts(slim), "ends")
    known = stage(endings(ends), "endings")
    model = stage(known.join(occurrences(slim, final_filter(known)), "ctx"), "end-model")
    n, total = ends.groupBy("same").agg(F.first("chars").alias("chars")).agg(F.count("*"), F.sum("chars")).first()
    base = min((n or 0) / max(total or 0, 1), 0.5) or 0.5
    anywhere = float(np.log(base / (1 - base)))
    looked = ends.select("doc_id", F.posexplode("ctx").alias("order", "ctx")).distinct().join(model, "ctx")
    per_text = looked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("order", "ends", "n", "lines"))).alias("seen"))  # ORDER entries at most
    smooth = lambda p, x: F.least(F.lit(1.0), (x["ends"] - 1 + LINE * x["lines"] + KAPPA * p) / (x["n"] - 1 + KAPPA))
    scored = ends.drop("ctx").distinct().join(per_text, "doc_id", "left")
    p = F.aggregate(F.coalesce("seen", F.array().cast("array<struct<order:int,ends:bigint,n:bigint,lines:bigint>>")), F.lit(base), smooth)
    kept = ["doc_id", "source", "lang", "same", "chars", "bytes"]
    return scored.select(*kept, p.alias("p")).select(*kept, (F.log(F.col("p") / F.greatest(F.lit(1e-9), 1 - F.col("p"))) - anywhere).alias("log_odds"))


def language(col: Column) -> Column:
    """The language of unevenly written codes: ``JA`` and ``ja-JP`` are ``ja``."""
    return F.regexp_extract(F.lower(F.coalesce(col, F.lit(""))), r"[a-z]+", 0)


def thresholds(odds: DataFrame) -> DataFrame:
    """``(lang, source, threshold)``: where the log-odds of a language and source are fewest between those of cut and of
    whole texts, with that of its language, and in that the one of all texts, weighing as much as so many texts."""
    bin_ = F.floor((F.col("log_odds") - LOWEST) / BIN).cast("int")
    counted = odds.groupBy("lang", "source", bin_.alias("bin")).agg(F.count("*").alias("n"))
    last = round((HIGHEST - LOWEST) / BIN)
    bins = [F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0)) for b in range(-1, last + 1)]

    def lowest(by: list[str], name: str) -> DataFrame:
        sums = counted.groupBy(*by).agg(F.sum("n").alias(f"{name}_n"), F.array(*bins).alias("bins"))
        smooth = F.transform(F.sequence(F.lit(1), F.lit(last)), lambda b: F.struct((F.get("bins", b - 1) + 2 * F.get("bins", b) + F.get("bins", b + 1)).alias("n"), (-b).alias("b")))
        at = F.array_min(smooth)["b"]
        return sums.select(*by, f"{name}_n", (LOWEST + BIN * (-at - F.lit(0.5))).alias(name))

    of_all = lowest([], "all_texts").first()["all_texts"]  # one number
    n = F.col("language_n")
    by_language = lowest(["lang"], "language").select("lang", ((n * F.col("language") + WEIGHT_OF_ALL * of_all) / (n + WEIGHT_OF_ALL)).alias("language"))
    n = F.col("own_n")
    joined = lowest(["lang", "source"], "own").join(by_language, "lang")
    return joined.select("lang", "source", ((n * F.col("own") + WEIGHT_OF_LANGUAGE * F.col("language")) / (n + WEIGHT_OF_LANGUAGE)).alias("threshold"))


def limits(odds: DataFrame) -> DataFrame:
    """``(source, unit, size)``: sizes, in characters or in fours of bytes, at which the texts of a source pile up."""
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.ceil(F.col("bytes") / 4).cast("int").alias("size")))).alias("u")
    sizes = odds.select("source", unit).groupBy("source", "u.unit", "u.size").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-AROUND, AROUND)
    others = (F.sum("n").over(near) - F.col("n")) / (2 * AROUND)
    return sizes.withColumn("others", others).where(F.col("n") >= PILED * F.greatest("others", F.lit(LEAST_OTHERS))).select("source", "unit", "size")


def truncated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """``(doc_id, source, lang, log_odds, threshold, at_limit, cut)`` of every text that isn't blank."""
    odds = stage(end_odds(docs, doc_id, text, source, lang).withColumn("lang", language(F.col("lang"))), "end-odds")
    once = odds.dropDuplicates(["lang", "source", "same"])
    piled = limits(odds.dropDuplicates(["source", "same"]))
    at = odds.select("doc_id", "source", "chars", F.ceil(F.col("bytes") / 4).cast("int").alias("fours"))
    hits = [at.join(piled.where(F.col("unit") == u).select(F.col("source").alias("s"), "size"), F.col("source").eqNullSafe(F.col("s")) & (F.col(c) == F.col("size"))).select("doc_id") for u, c in (("chars", "chars"), ("bytes", "fours"))]
    at_limit = hits[0].unionByName(hits[1]).distinct().withColumn("at_limit", F.lit(True))
    rules = thresholds(once).select(F.col("lang").alias("l"), F.col("source").alias("s"), "threshold")
    judged = odds.join(rules, (F.col("lang") == F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).join(at_limit, "doc_id", "left").withColumn("at_limit", F.coalesce("at_limit", F.lit(False)))
    bar = F.col("threshold") + F.when(F.col("at_limit"), AT_LIMIT).otherwise(0.0)
    return judged.select("doc_id", "source", "lang", "log_odds", "threshold", "at_limit", (F.col("log_odds") < bar).alias("cut"))


def truncation_rates(found: DataFrame) -> DataFrame:
    """``(source, texts, cut, share)``: how often each source cuts."""
    return found.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut")).withColumn("share", F.col("cut") / F.col("texts"))
