"""The same or almost the same records across splits: training texts streamed through full-text indexes of evaluation texts.

Equal texts of a type are one text class, whatever their criteria. The evaluation classes of a type are laid into
shards, and its training classes are streamed through backward search on a compressed full-text index of each shard
(a wavelet matrix over the transform of the shard's texts). Two texts that are alike enough share one of the rarest
pieces of both, so only these are looked up, and only their texts kept with the index; pieces that stand in the same
places one after another are one maximal match. The matches of a training text lead to evaluation texts, where they
are merged: how large a text may be, how many rarer pieces it may have and in how many the parity of its pieces may
differ all follow from the likeness, so that no pair is ruled out that is alike enough. What is left is counted
exactly: shared pieces of the texts first, then of the criteria of all records with them.

Evaluation texts, then the training texts for them, reach a task through one shuffle by shard, so the index is read
through Spark and neither side passes through the driver. No pair is lost; the search grows with the training texts
times the shards of their type.

Nulls: a record without an id or whose folded state is empty never counts; null instructions and types count as
empty, a null or blank criteria is missing, and a null split isn't the training split. Repeated rows are one record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folding import fold, fold_codes, likeness, mix, sorted_unique, to_codes, to_texts
from ..functions.strict_json import read, sorted_text
from ..plans.staging import stage
from .near_duplicates import one_head, staged_records, text_hash
from .tokens import ragged

BLOCK = 2000
REMEMBERED = 500_000
#: Characters of evaluation texts in a shard, training texts that are sent to one copy of it, and those searched for together.
SHARD_CHARACTERS, SHARD_QUERIES, STREAM = 8_000_000, 200_000, 6000
#: Bits of the parity of a text's pieces, and what they are folded to for a first look.
PARITY_BITS, COARSE_BITS = 1024, 256
#: Suffixes are ordered by so many characters: a match is found by three and told apart by the one before.
DEPTH = 4
#: Places of the index that are looked at together.
LOOKED = 500_000

_U = np.uint64


def ranked(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of at most ``bits`` bits in order, and where each was; equal ones in the order of places.

    Where a value and its place fit into one number, these are sorted, which is many times faster than sorting places.
    """
    place_bits = len(values).bit_length()
    if bits + place_bits < 64:
        packed = values << place_bits
        packed |= np.arange(len(values), dtype=np.uint32)
        packed.sort()
        in_order = packed >> place_bits
        packed &= (1 << place_bits) - 1
        return in_order, packed
    order = np.argsort(values, kind="stable")
    return values[order], order


def numbered(in_order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value begins among values in order, and which of the distinct ones each value is."""
    new = np.ones(len(in_order), bool)
    np.not_equal(in_order[1:], in_order[:-1], out=new[1:])
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    return np.flatnonzero(new), number


def numbered_codes(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """For each code point its number among those that occur, from 1 on, or 0; and how many occur."""
    there = np.zeros(0x110000, bool)
    there[codes] = True
    numbers = np.cumsum(there, dtype=np.int32)
    return numbers * there, int(numbers[-1])


class TextIndex:
    """A compressed full-text index of texts given as code points: a wavelet matrix over their transform, with ranks by
    64-bit words. ``order`` are the places of its rows."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        texts = len(starts) - 1
        self.numbers, known = numbered_codes(codes)
        n = len(codes) + texts
        row = np.repeat(np.arange(texts), np.diff(starts))
        symbol = np.zeros(n, np.int32)  # 0 ends each text
        symbol[np.arange(len(codes)) + row] = self.numbers[codes]
        del row
        self.levels = max(known.bit_length(), 1)
        rank, bits, width = symbol, self.levels, 1
        while True:  # ordered by twice as many symbols each time
            key = rank.astype(np.int64) << bits
            key[: max(n - width, 0)] |= rank[width:]
            del rank
            key, order = ranked(key, 2 * bits)
            width *= 2
            if width >= DEPTH:
                break
            begins, number = numbered(key)
            rank, bits = np.empty(n, np.int32), max(len(begins).bit_length(), 1)
            rank[order] = number
        del key
        self.order, self.n = order.astype(np.int32), n
        del order
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(symbol, minlength=known + 1))])
        left = symbol.astype(np.uint16 if self.levels <= 16 else np.uint32)[self.order - 1]
        del symbol
        self.words, self.ones, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (left >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-n % 64 + 64, bool)]), bitorder="little").view(_U)
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            left = np.concatenate([left[~bit], left[bit]])
        every = np.arange(known + 1)
        self.offset = self.begins[:-1] - self._walk(every, np.zeros(len(every), np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            ones = self.ones[k][word] + np.bitwise_count(self.words[k][word] & ((_U(1) << (at & 63).astype(_U)) - _U(1)))
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbol of each character, 0 where no text has it."""
        return self.numbers[codes]

    def whole(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with each symbol, none for the symbol that no text has."""
        return np.where(symbol, self.begins[symbol], 0), np.where(symbol, self.begins[symbol + 1], 0)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: rows that begin with ``symbol`` and go on as the rows from ``low`` to ``high`` begin."""
        there = (symbol > 0) & (high > low)
        low, high = (np.where(there, self.offset[symbol] + self._walk(symbol, x), 0) for x in (low, high))
        return low, high


def distinct_pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and first place of each distinct piece of three characters, in the order of places, and the code points and
    starts of the texts. Texts of less than three characters are like no other and have none."""
    codes, starts = to_codes(texts)
    numbers, known = numbered_codes(codes)
    symbol, bits = numbers[codes], known.bit_length()
    three = symbol.astype(np.int64)
    for k in (1, 2):
        three <<= bits
        three[:-k] |= symbol[k:]
    rows, places = [], []
    for at in range(0, len(texts), BLOCK):
        first = starts[at : min(at + BLOCK, len(texts)) + 1]
        lengths = np.diff(first)
        counts = np.maximum(lengths - 2, 0)
        row, place = np.repeat(np.arange(len(lengths)), counts), ragged(first[:-1], counts)
        used = 3 * bits + len(lengths).bit_length()
        if used < 64:
            key, order = ranked(row << 3 * bits | three[place], used)
        else:  # more code points than fit with the row
            key = row.astype(_U) << _U(50) | mix(three[place].astype(_U)) >> _U(14)
            order = np.argsort(key, kind="stable")
            key = key[order]
        there = np.zeros(first[-1] - first[0], bool)
        there[place[order[numbered(key)[0]]] - first[0]] = True
        chosen = np.flatnonzero(there)
        rows.append(np.repeat(np.arange(at, at + len(lengths), dtype=np.int32), lengths)[chosen])
        places.append((chosen + first[0]).astype(np.int32))
    empty = np.zeros(0, np.int32)
    return np.concatenate([empty, *rows]), np.concatenate([empty, *places]), codes, starts


class Rare(NamedTuple):
    """The rarest pieces of texts: what each text may lack and one more, and all that stand as often as the last of them."""

    row: np.ndarray  #: text
    place: np.ndarray
    low: np.ndarray  #: rows of the index that begin with the piece
    high: np.ndarray
    rarer: np.ndarray  #: how many pieces of the text are rarer than this one


def rarest(index: TextIndex, row: np.ndarray, place: np.ndarray, symbol: np.ndarray, size: np.ndarray, threshold: float) -> Rare:
    """The rarest pieces of each text, by backward search for all of them; those that the shard hasn't are the rarest."""
    bits = index.levels
    three, order = ranked(symbol[place].astype(np.int64) << 2 * bits | symbol[place + 1] << bits | symbol[place + 2], 3 * bits)
    begins, number = numbered(three)
    three, at = three[begins], np.empty(len(order), np.int32)
    at[order] = number
    last = (1 << bits) - 1
    low, high = index.whole(three & last)
    for shift in (bits, 2 * bits):
        low, high = index.step(three >> shift & last, low, high)
    count_bits = index.n.bit_length()
    in_order, order = ranked(row.astype(np.int64) << count_bits | (high - low)[at], len(size).bit_length() + count_bits)
    may_lack = size - np.ceil(threshold * size - 1e-6).astype(np.int64)
    begin = np.cumsum(size) - size
    has = np.flatnonzero(size)
    most = np.zeros(len(size), np.int64)
    most[has] = in_order[(begin + may_lack)[has]]
    begins, number = numbered(in_order)
    of = in_order >> count_bits
    chosen = np.flatnonzero((in_order <= most[of]) & ((in_order & ((1 << count_bits) - 1)) > 0))
    rarer = np.full(len(row), -1, np.int32)
    rarer[order[chosen]] = begins[number[chosen]] - begin[of[chosen]]
    rare = np.flatnonzero(rarer >= 0)
    return Rare(row[rare], place[rare], low[at[rare]], high[at[rare]], rarer[rare])


def maximal_matches(index: TextIndex, rare: Rare, symbol: np.ndarray) -> np.ndarray:
    """Where the maximal matches of rare pieces begin among them.

    Neighbouring pieces of a text that stand in the very same places of the index are one match: the four characters
    of both stand as often as each. All its pieces lead to the same texts, so one of them is looked up.
    """
    count = rare.high - rare.low
    joined = np.zeros(len(count), bool)
    joined[1:] = (rare.row[1:] == rare.row[:-1]) & (rare.place[1:] == rare.place[:-1] + 1) & (count[1:] == count[:-1])
    open_ = np.flatnonzero(joined)
    low, high = index.step(symbol[rare.place[open_] - 1].astype(np.int64), rare.low[open_], rare.high[open_])
    joined[open_] = high - low == count[open_]
    return np.flatnonzero(~joined)


def parities(row: np.ndarray, place: np.ndarray, codes: np.ndarray, texts: int) -> np.ndarray:
    """Bits of the parity of each text's pieces, given by their text and first place: texts differ in as many pieces as
    bits at least, and folding the bits keeps that."""
    bit = np.empty(len(place), np.int64)
    for at in range(0, len(place), LOOKED):
        p = place[at : at + LOOKED]
        one, two, three = (codes[p + k].astype(_U) for k in range(3))
        bit[at : at + LOOKED] = mix(one << _U(42) | two << _U(21) | three) >> _U(14) & _U(PARITY_BITS - 1)
    out = [np.zeros((0, PARITY_BITS // 64), _U)]
    for at in range(0, texts, BLOCK // 4):
        n = min(BLOCK // 4, texts - at)
        begin, end = np.searchsorted(row, np.array([at, at + n], row.dtype))
        odd = np.bincount((row[begin:end] - at) * PARITY_BITS + bit[begin:end], minlength=n * PARITY_BITS) & 1
        out.append(np.packbits(odd.astype(bool).reshape(n, PARITY_BITS), axis=1).view(_U))
    return np.concatenate(out)


def coarse(parity: np.ndarray) -> np.ndarray:
    """Parities folded to fewer bits, in which unrelated texts of a few hundred pieces still differ too much."""
    return np.bitwise_xor.reduce(parity.reshape(len(parity), -1, COARSE_BITS // 64), axis=1)


class Shard:
    """Evaluation texts with their index; for the rows of each piece, the texts of which it is a rare piece, by size."""

    def __init__(self, texts: list[str], threshold: float):
        row, place, codes, starts = distinct_pieces(texts)
        self.texts, self.threshold, self.share = texts, threshold, threshold / (1 + threshold)
        self.size = np.bincount(row, minlength=len(texts))
        self.parity = parities(row, place, codes, len(texts))
        self.coarse = coarse(self.parity)
        self.index = TextIndex(codes, starts)
        symbol = self.index.symbols(codes)
        del codes, starts, self.index.order
        #: Sizes have so many bits in the keys that one number is above them all.
        self.bits = int(self.size.max(initial=0) + 1).bit_length()
        keys, of, most = [], [], []
        for at in range(0, len(texts), STREAM):  # in parts, which take less memory
            begin, end = np.searchsorted(row, np.array([at, at + STREAM], row.dtype))
            rare = rarest(self.index, row[begin:end] - np.int32(at), place[begin:end], symbol, self.size[at : at + STREAM], threshold)
            size = self.size[at : at + STREAM][rare.row]
            keys.append(rare.low << self.bits | size)
            of.append(rare.row + np.int32(at))
            # how large a training text may be, since rarer pieces of the evaluation text aren't common
            most.append(np.floor((size - rare.rarer + 1e-6) / self.share - size + 1e-6).astype(np.int32))
        del row, place, symbol
        keys = np.concatenate(keys)
        self.keys, order = ranked(keys, self.index.n.bit_length() + self.bits)
        del keys
        order = order.astype(np.int32)
        self.of, self.most = np.concatenate(of)[order], np.concatenate(most)[order]

    def search(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Training and evaluation texts that are alike enough.

        Of two texts with m and n pieces, ``share * (m + n)`` must be common. If a piece is the rarest one that they share,
        those that are rarer aren't common, which bounds n and the number of rarer pieces in the other text.
        """
        row, place, codes, _ = distinct_pieces(texts)
        size, symbol = np.bincount(row, minlength=len(texts)), self.index.symbols(codes)
        own = parities(row, place, codes, len(texts))
        rare = rarest(self.index, row, place, symbol, size, self.threshold)
        match = maximal_matches(self.index, rare, symbol)
        of, rarer, m = rare.row[match], rare.rarer[match], size[rare.row[match]]
        least, most = np.ceil(self.threshold * m - 1e-6).astype(np.int64), np.floor((m - rarer) / self.share - m + 1e-6).astype(np.int64)
        _, order = ranked(rare.low[match], self.index.n.bit_length())  # keys that are near each other are looked up together
        piece, top = rare.low[match][order] << self.bits, (1 << self.bits) - 1
        low, high = np.empty(len(match), np.int64), np.empty(len(match), np.int64)
        low[order] = np.searchsorted(self.keys, piece | np.minimum(least[order], top))
        high[order] = np.searchsorted(self.keys, piece | np.clip(most[order], 0, top), "right")
        a, b = self.near(own, size, *self.merged(of, size, low, np.maximum(high, low)))
        alike = np.zeros(len(a), bool)
        for at in range(0, len(a), BLOCK):
            x, y = a[at : at + BLOCK], b[at : at + BLOCK]
            alike[at : at + BLOCK] = likeness([texts[i] for i in x.tolist()], [self.texts[i] for i in y.tolist()]) >= self.threshold
        return a[alike], b[alike]

    def merged(self, of: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training and evaluation texts that any match leads to; the matches of a pair are merged."""
        total = np.cumsum(high - low)
        pairs, begin = [np.zeros(0, np.int64)], 0
        while begin < len(of):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + LOOKED, "right")))
            n = (high - low)[begin:end]
            at = ragged(low[begin:end], n)
            good = np.repeat(size[of[begin:end]], n) <= self.most[at]
            pairs.append(sorted_unique(np.repeat(of[begin:end].astype(np.int64), n)[good] << 32 | self.of[at[good]]))
            begin = end
        pair = sorted_unique(np.concatenate(pairs))
        return pair >> 32, pair & 0xFFFFFFFF

    def near(self, own: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of texts those whose parities, folded and then whole, differ in no more bits than their pieces may."""
        total = np.arange(size.max(initial=0) + self.size.max(initial=0) + 1)
        may_differ = (total - 2 * np.ceil(self.share * total - 1e-6)).astype(np.int64)
        for x, y in ((coarse(own), self.coarse), (own, self.parity)):
            left = [np.zeros(0, np.int64)]
            for at in range(0, len(a), LOOKED // 16):
                i, j = a[at : at + LOOKED // 16], b[at : at + LOOKED // 16]
                differ = np.bitwise_count(x.take(i, 0) ^ y.take(j, 0)) @ np.ones(x.shape[1], np.uint16)
                left.append(at + np.flatnonzero(differ <= may_differ[size[i] + self.size[j]]))
            left = np.concatenate(left)
            a, b = a[left], b[left]
        return a, b


def criteria_text(text: str | None) -> str | None:
    """Folded criteria with the keys of objects sorted; None where they are missing."""
    if text is None or not text.strip():
        return None
    try:
        return fold(json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False))
    except ValueError:
        return fold(text)
    except RecursionError:  # nested more deeply than the library goes
        try:
            return fold(sorted_text(read(text, number=json.loads)))
        except ValueError:
            return fold(text)


def split_records(df: DataFrame, train: str) -> DataFrame:
    """``(id, train, split, source, cls, alt, head, tcls, talt, thead, kind, text, criteria)`` of every record that
    counts; ``tcls`` and ``talt`` are the class of its type and text alone, ``head`` and ``thead`` mark the first row of
    a class and of a text class on their side that its task saw."""
    schema = pa.schema([("id", pa.string()), ("train", pa.bool_()), ("split", pa.string()), ("source", pa.string()), ("cls", pa.int64()), ("alt", pa.int64()), ("head", pa.bool_()), ("tcls", pa.int64()), ("talt", pa.int64()), ("thead", pa.bool_()), ("kind", pa.string()), ("text", pa.string()), ("criteria", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                col = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
                kinds, states, asked = (to_texts(*fold_codes(col[n])) for n in ("type", "state", "instructions"))
                out = []
                for i, split, source, kind, state, ask, criteria in zip(col["id"], col["split"], col["source"], kinds, states, asked, col["criteria"]):
                    if i is None or not state:
                        continue
                    text, own = state + ask, criteria_text(criteria)
                    h = text_hash(f"{kind}\0{text}\0" + ("-" if own is None else "+" + own))
                    t = text_hash(f"{kind}\0{text}")
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    side = split == train
                    out.append((i, side, split, source, *h, (side, h) not in seen, *t, (side, t) not in seen, kind, text, own))
                    seen |= {(side, h), (side, t)}
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in ("id", "split", "source", "type", "state", "instructions", "criteria"))).mapInArrow(
        run, "id string, train boolean, split string, source string, cls long, alt long, head boolean, tcls long, talt long, thead boolean, kind string, text string, criteria string"
    )


def alike_classes(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """``(a, aa, b, ab)``: training and evaluation text classes of one kind that differ and are at least ``threshold``
    alike. Each training class goes to all shards of its kind."""
    shards = b.groupBy("kh").agg(F.ceil(F.sum(F.length("text")) / SHARD_CHARACTERS).cast("int").alias("parts"))
    shards = stage(shards.join(a.groupBy("kh").agg(F.ceil(F.count("*") / SHARD_QUERIES).cast("int").alias("copies")), "kh"), "shards")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    names = ["kh", "part", "copy", "train", "tcls", "talt", "text"]
    evaluation = b.join(shards, "kh").withColumns({"part": F.pmod("tcls", "parts").cast("int"), "copy": every("copies"), "train": F.lit(False)})
    training = a.join(shards, "kh").withColumns({"part": every("parts"), "copy": F.pmod(F.xxhash64("tcls"), "copies").cast("int"), "train": F.lit(True)})
    sent = evaluation.select(*names).unionByName(training.select(*names)).repartition("kh", "part", "copy").sortWithinPartitions("kh", "part", "copy", "train")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        shard: Shard | None = None
        held: list[tuple] = []  # the shard's texts
        asked: list[tuple] = []

        def answered() -> Iterator[pa.RecordBatch]:
            if asked and shard:
                x, y = shard.search([r[2] for r in asked])
                pairs = [p for i, j in zip(x.tolist(), y.tolist()) if (p := (*asked[i][:2], *held[j][:2]))[:2] != p[2:]]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(4)], ["a", "aa", "b", "ab"])
            asked.clear()

        for whole in batches:
            for *key, train, cls, alt, text in zip(*(c.to_pylist() for c in whole.columns)):
                if tuple(key) != here:
                    yield from answered()
                    here, shard, held = tuple(key), None, []
                if not train:
                    held.append((cls, alt, text))
                elif held:
                    shard = shard or Shard([r[2] for r in held], threshold)
                    asked.append((cls, alt, text))
                    if len(asked) == STREAM:
                        yield from answered()
        yield from answered()

    return sent.mapInArrow(run, "a long, aa long, b long, ab long")


def overlapping(df: DataFrame, threshold: float = 0.6, train: str = "train") -> DataFrame:
    """``(train_id, eval_id, split, source, same)``: all pairs of a training and another record of equal types whose
    texts are at least ``threshold`` alike, and whose criteria are both missing or at least ``threshold`` alike.

    ``split`` and ``source`` are those of the other record; ``same`` says that all four fields are equal when folded.
    """
    records = staged_records(split_records(df, train))
    kh = F.xxhash64("kind").alias("kh")
    text_key, key = ("tcls", "talt"), ("cls", "alt")
    heads = one_head(records, {"train text": ("thead AND train", text_key), "text": ("thead AND NOT train", text_key), "train": ("head AND train", key), "other": ("head AND NOT train", key)})
    a, b = (heads[n].select("tcls", "talt", kh, "text") for n in ("train text", "text"))
    equal = a.select("tcls", "talt").join(b.select("tcls", "talt"), ["tcls", "talt"], "left_semi").select(F.col("tcls").alias("a"), F.col("talt").alias("aa"), F.col("tcls").alias("b"), F.col("talt").alias("ab"))
    found = stage(alike_classes(a, b, threshold), "alike-texts")

    def check_criteria(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                r = whole.slice(at, BLOCK)
                left, right = r.column("criteria_a").to_pylist(), r.column("criteria_b").to_pylist()
                missing = np.array([(x is None) + (y is None) for x, y in zip(left, right)])
                alike = likeness([x or "" for x in left], [x or "" for x in right]) >= threshold
                yield r.filter(pa.array(np.where(missing == 0, alike, missing == 2), pa.bool_())).select(["a", "aa", "b", "ab"])

    def classes(name: str, x: str) -> DataFrame:
        return heads[name].select(F.col("tcls").alias(f"t{x}"), F.col("talt").alias(f"ta{x}"), F.col("cls").alias(x), F.col("alt").alias(f"a{x}"), F.col("criteria").alias(f"criteria_{x}"))

    alike = found.unionByName(equal).distinct().toDF("ta", "taa", "tb", "tab")
    of_records = alike.join(classes("train", "a"), ["ta", "taa"]).join(classes("other", "b"), ["tb", "tab"])
    pairs = of_records.select("a", "aa", "criteria_a", "b", "ab", "criteria_b").mapInArrow(check_criteria, "a long, aa long, b long, ab long").distinct()
    train_ids = records.where("train").select(F.col("id").alias("train_id"), F.col("cls").alias("a"), F.col("alt").alias("aa")).distinct()
    eval_ids = records.where("NOT train").select(F.col("id").alias("eval_id"), "split", "source", F.col("cls").alias("b"), F.col("alt").alias("ab")).distinct()
    same = (F.col("a") == F.col("b")) & (F.col("aa") == F.col("ab"))
    return pairs.join(train_ids, ["a", "aa"]).join(eval_ids, ["b", "ab"]).select("train_id", "eval_id", "split", "source", same.alias("same"))


def overlap_report(pairs: DataFrame, df: DataFrame, train: str = "train") -> DataFrame:
    """``(split, source, cases, overlapping, same, pairs)``: for each split and source outside of training, how many
    cases there are, how many stand in training almost or exactly the same, and by how many pairs."""
    per_case = pairs.groupBy(F.col("eval_id").alias("id"), "split", "source").agg(F.count("*").alias("n"), F.max(F.col("same").cast("int")).alias("same"))
    found = per_case.groupBy("split", "source").agg(F.count("*").alias("overlapping"), F.sum("same").alias("same"), F.sum("n").alias("pairs"))
    cases = df.where("split IS NULL OR split <> '%s'" % train).groupBy("split", "source").agg(F.count("*").alias("cases"))
    joined = cases.alias("c").join(found.alias("f"), F.col("c.split").eqNullSafe(F.col("f.split")) & F.col("c.source").eqNullSafe(F.col("f.source")), "left")
    zero = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c)
    return joined.select("c.split", "c.source", "cases", zero("overlapping"), zero("same"), zero("pairs"))
