"""Held-out texts inside a corpus: exact hits of item pieces, then Myers' bit-parallel distance decides.

A passage is a part of an item, ``run`` characters long. With a budget of ``errors`` edits, items are cut into pieces so
short that every passage, wherever it starts, holds one piece more than it may have errors: a text that holds the
passage within the budget then holds one of its pieces unchanged. All passages around each hit are verified by the
edit distance to the text beside it. The longest run that a hit shows unchanged comes along.

Nulls: a row without an id or text and an item without an id or text give nothing. Items whose folded text is
shorter than the least run can't be found. Repeated rows give their pairs once. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folding import fold, fold_codes, to_texts

BLOCK = 1000
#: Characters of items that are searched for in one pass; more items take more passes.
PASS_CHARACTERS = 4_000_000
#: Hits that are verified together.
SLICE = 3000

_U = np.uint64


def reaches(patterns: np.ndarray, texts: np.ndarray, errors: int) -> np.ndarray:
    """For each row and 0 to ``errors`` edits the most first characters of the pattern (at most 64) that some first
    characters of the text can be made into.

    Myers' algorithm in Hyyrö's form, one word a row, all rows together, begun at the first character of both; the
    columns' differences give the distance of each beginning of the pattern.
    """
    n, width = patterns.shape
    word = np.uint32 if width <= 32 else _U
    size = word(0).nbytes
    patterns = np.pad(patterns, ((0, 0), (0, 8 * size - width)))
    bits = lambda x: np.unpackbits(x.view(np.uint8).reshape(n, size), axis=1, bitorder="little").view(np.int8)
    one = word(1)
    plus, minus = np.full(n, ~word(0)), np.zeros(n, word)
    least = np.broadcast_to(np.arange(1, 8 * size + 1, dtype=np.int8), patterns.shape).copy()  # against no text at all
    for k in range(texts.shape[1]):
        equal = np.packbits(patterns == texts[:, k, None], axis=1, bitorder="little").view(word).ravel()
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = (minus | ~(horizontal | plus)) << one | one
        down = (plus & horizontal) << one
        plus = down | ~(vertical | up)
        minus = up & vertical
        step = bits(plus) - bits(minus)
        step[:, 0] += np.int8(k + 1)
        np.minimum(least, np.cumsum(step, axis=1, dtype=np.int8), out=least)
    least = least[:, :width]
    place = np.arange(1, width + 1)
    return np.stack([np.where(least <= e, place, 0).max(axis=1, initial=0) for e in range(errors + 1)], axis=1)


class Items:
    """Pieces of a block of items in an automaton."""

    def __init__(self, ids: list[int], texts: list[str], run: int, errors: int):
        self.piece, self.run, self.errors = (run + 1) // (errors + 2), run, errors
        self.ids = np.array(ids, np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        places: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(texts):
            for at in range(0, len(t) - self.piece + 1, self.piece):
                places.setdefault(t[at : at + self.piece], []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        if places:
            self.automaton.make_automaton()

    def hits(self, texts: list[str], done: set[tuple[int, int]]) -> Iterator[np.ndarray]:
        """``(text, item, place in item, place in text)`` of every piece in every text, but for pairs that are done, in
        slices: a text may hold a piece any number of times."""
        if not len(self.automaton):
            return
        out: list[tuple] = []
        for d, t in enumerate(texts):
            for end, where in self.automaton.iter(t):
                out.extend([(d, i, at, end - self.piece + 1) for i, at in where if (d, i) not in done])
                if len(out) >= SLICE:
                    yield np.array(out, np.int64)
                    out = []
        if out:
            yield np.array(out, np.int64)

    def _item(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Characters of items at places within them, 0 outside."""
        size = (self.starts[i + 1] - self.starts[i])[:, None]
        return np.where((at >= 0) & (at < size), self.codes[np.clip(self.starts[i][:, None] + at, 0, len(self.codes) - 1)], 0)

    def verified(self, codes: np.ndarray, starts: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hit the least number of edits within the budget by which a passage through its piece becomes what
        stands in the text, beyond the budget if none does; and how many characters around the piece are unchanged,
        up to ``run`` in all each way."""

        def text(d: np.ndarray, at: np.ndarray) -> np.ndarray:
            there = (at >= 0) & (at < (starts[d + 1] - starts[d])[:, None])
            return np.where(there, codes[np.clip(starts[d][:, None] + at, 0, len(codes) - 1)], 1)

        d, i, at, place = hits.T
        side = self.run - self.piece
        away, further = np.arange(1, side + 1), np.arange(1, side + self.errors + 1)
        left = reaches(self._item(i, at[:, None] - away), text(d, place[:, None] - further), self.errors)
        right = reaches(self._item(i, at[:, None] + self.piece - 1 + away), text(d, place[:, None] + self.piece - 1 + further), self.errors)
        left, right = np.minimum(left, at[:, None]), np.minimum(right, (self.starts[i + 1] - self.starts[i] - at - self.piece)[:, None])
        distance = np.full(len(hits), self.errors + 1, np.int64)
        for total in range(self.errors, -1, -1):
            for e in range(total + 1):
                distance[left[:, e] + self.piece + right[:, total - e] >= self.run] = total
        return distance, left[:, 0] + self.piece + right[:, 0]


def leaked_items(docs: DataFrame, items: DataFrame, run: int = 40, errors: int = 2, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """``(doc_id, item_id, pieces, distance, longest)``: documents that hold ``run`` folded characters in a row of an item
    with at most ``errors`` edits, how many piece hits show it, the least distance of a passage, and the longest run
    that stands there unchanged, counted up to ``run`` characters beyond each hit.
    """
    if not 2 <= run <= 64 or not 0 <= errors <= run - 2:
        raise ValueError("run must be between 2 and 64, and errors less than run - 1")
    schema = "doc_id long, item_id long, pieces int, distance int, longest int"
    spark = docs.sparkSession

    def one_pass(ids: list[int], texts: list[str]) -> DataFrame:
        known = spark.sparkContext.broadcast((ids, texts))  # PASS_CHARACTERS bound it

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Items(*known.value, run, errors)
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    b = whole.slice(at, BLOCK)
                    codes, starts = fold_codes(b.column(1).to_pylist())
                    done: set[tuple[int, int]] = set()
                    for hits in own.hits(to_texts(codes, starts), done):
                        distance, longest = own.verified(codes, starts, hits)
                        good = distance <= errors
                        hits, distance, longest = hits[good], distance[good], longest[good]
                        pairs, which, n = np.unique(hits[:, 0] << 32 | hits[:, 1], return_inverse=True, return_counts=True)
                        least, most = np.full(len(pairs), errors + 1), np.zeros(len(pairs), np.int64)
                        np.minimum.at(least, which, distance)
                        np.maximum.at(most, which, longest)
                        full = pairs[most >= run]  # nothing that comes later could show more
                        done.update(zip((full >> 32).tolist(), (full & 0xFFFFFFFF).tolist()))
                        docs_of = b.column(0).to_numpy()[pairs >> 32]
                        yield pa.RecordBatch.from_arrays([pa.array(docs_of, pa.int64()), pa.array(own.ids[pairs & 0xFFFFFFFF]), *(pa.array(x, pa.int32()) for x in (n, least, most))], ["doc_id", "item_id", "pieces", "distance", "longest"])

        texts_only = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{doc_text}`").cast("string").alias("text"))
        return texts_only.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(scan, schema)

    passes: list[DataFrame] = []
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    chosen = items.select(F.col(f"`{item_id}`").cast("long"), F.col(f"`{item_text}`").cast("string")).distinct()
    for i, text in chosen.toLocalIterator():  # a pass's worth of items at a time
        text = fold(text)
        if i is None or len(text) < run:
            continue
        if size + len(text) > PASS_CHARACTERS and ids:
            passes.append(one_pass(ids, texts))
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(text)
        size += len(text)
    if ids or not passes:
        passes.append(one_pass(ids, texts))
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    return found.groupBy("doc_id", "item_id").agg(F.max("pieces").alias("pieces"), F.min("distance").alias("distance"), F.max("longest").alias("longest"))
