"""Token ids by a public byte-level BPE vocabulary: merging through segment trees over adjacent pair ranks.

Texts are cut into words by the vocabulary's pattern. Each distinct word of a batch is a row of symbols with a
segment tree over the ranks of its adjacent pairs; the root yields the lowest rank at its leftmost place, the two
symbols become one, and the ranks beside it are updated up the tree. All words of one length class take this
step together, until no pair of theirs can be merged.

Null and empty texts have an empty list of ids. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folding import mix

TOKENIZERS = "/opt/tokenizers"
#: The pattern by which byte-level BPE vocabularies of this family cut text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
BLOCK = 500
#: Words whose ids a task keeps.
CACHED = 20_000
#: Symbols that one step's trees hold at most, but for a single longer word.
STEP_SYMBOLS = 1 << 19

_U = np.uint64


class PairRanks:
    """Ranks of mergeable pairs and the ids they become, in an open hash table that whole arrays are looked up in."""

    def __init__(self, path: str):
        whole = json.loads(Path(path).read_text())
        model, cuts = whole["model"], whole.get("pre_tokenizer") or {}
        plain = not (whole.get("normalizer") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"))
        if not plain or model.get("type") != "BPE" or cuts.get("type") != "ByteLevel" or cuts.get("add_prefix_space") or not cuts.get("use_regex", True):
            raise ValueError(f"{path} is not a byte-level BPE vocabulary that cuts words by the known pattern")
        vocab: dict[str, int] = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.of_byte = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.uint64)
        self.becomes = np.array([vocab[a + b] for a, b in pairs] + [0], np.int32)
        self.bits = int(len(keys) * 4 - 1).bit_length()
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        at, left, self.probes = self._home(keys), np.arange(len(keys)), 0
        while len(left):
            free = self.keys[at[left]] == np.iinfo(np.uint64).max
            here, first = np.unique(at[left][free], return_index=True)
            placed = left[free][first]
            self.keys[here], self.ranks[here] = keys[placed], placed
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``NONE`` where it can't be merged."""
        keys = left.astype(_U) << _U(20) | right.astype(_U)
        at = self._home(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.keys[at] != np.iinfo(np.uint64).max))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (there != np.iinfo(np.uint64).max)]
        return out


@functools.lru_cache(2)
def pair_ranks(path: str) -> PairRanks:
    return PairRanks(path)


def merge_words(symbols: np.ndarray, lengths: np.ndarray, ranks: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Merge the rows of ``symbols`` (first ``lengths`` of each) as far as they go: ids row by row, and how many each has.

    A tree's leaf ``i`` holds the rank of symbol ``i`` and the next symbol that is still there; inner nodes hold
    the place of the lowest rank below them, the left one of two equal ones.
    """
    n, width = symbols.shape
    size = 1 << max(int(width - 1).bit_length(), 1)
    levels = size.bit_length() - 1
    leaf = np.full((n, size), NONE, np.int32)
    inner = np.arange(width - 1)[None, :] < lengths[:, None] - 1
    r, c = np.nonzero(inner)
    leaf[r, c] = ranks(symbols[r, c], symbols[r, c + 1])
    low = [leaf]  # level by level, the lowest rank below each node
    for _ in range(levels):
        low.append(np.minimum(low[-1][:, 0::2], low[-1][:, 1::2]))
    place = np.arange(width, dtype=np.int32)
    after = np.where(place[None, :] + 1 < lengths[:, None], place[None, :] + 1, width).astype(np.int32)
    before = np.broadcast_to(place - 1, (n, width)).copy()
    there = place[None, :] < lengths[:, None]
    rows = np.flatnonzero(low[-1][:, 0] != NONE)

    def update(row: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        low[0][row, at] = rank
        for level in range(1, levels + 1):
            at = at >> 1
            low[level][row, at] = np.minimum(low[level - 1][row, 2 * at], low[level - 1][row, 2 * at + 1])

    while len(rows):
        at = np.zeros(len(rows), np.int64)
        best = low[-1][rows, 0]
        for level in range(levels - 1, -1, -1):
            at = 2 * at
            at += low[level][rows, at] != best
        gone = after[rows, at].astype(np.int64)
        symbols[rows, at] = ranks.becomes[best]
        there[rows, gone] = False
        follow = after[rows, gone].astype(np.int64)
        after[rows, at] = follow
        more = follow < width
        before[rows[more], follow[more]] = at[more]
        update(rows, gone, np.full(len(rows), NONE, np.int32))
        rank = np.full(len(rows), NONE, np.int32)
        rank[more] = ranks(symbols[rows[more], at[more]], symbols[rows[more], follow[more]])
        update(rows, at, rank)
        prior = before[rows, at].astype(np.int64)
        has = prior >= 0
        update(rows[has], prior[has], ranks(symbols[rows[has], prior[has]], symbols[rows[has], at[has]]))
        rows = rows[low[-1][rows, 0] != NONE]
    return symbols[there], there.sum(axis=1)


def encode_words(words: list[bytes], ranks: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words one after another, and where each word's start (one more entry than words)."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = ranks.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    order = np.argsort(lengths, kind="stable")
    counts = np.zeros(len(words), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(order):
        width = 1 << max(int(lengths[order[at]] - 1).bit_length(), 1)
        end = min(int(np.searchsorted(lengths[order], width, side="right")), at + max(STEP_SYMBOLS // width, 1))
        chosen = order[at:end]
        width = int(lengths[chosen[-1]])
        reach = np.arange(width)[None, :] < lengths[chosen][:, None]
        symbols = np.zeros((len(chosen), width), np.int32)
        symbols[reach] = flat[(starts[chosen][:, None] + np.arange(width)[None, :])[reach]]
        if width == 1:
            ids, n = symbols[:, 0], np.ones(len(chosen), np.int64)
        else:
            ids, n = merge_words(symbols, lengths[chosen], ranks)
        counts[chosen] = n
        parts.append((chosen, ids))
        at = end
    out_starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(out_starts[-1], np.int32)
    for chosen, ids in parts:
        out[ragged(out_starts[chosen], counts[chosen])] = ids
    return out, out_starts


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``starts[i], starts[i] + 1, ...`` (``counts[i]`` of them) for all i in a row."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


class Words:
    """Ids of the words that a task has met, up to ``CACHED`` of them; then it starts afresh."""

    def __init__(self, ranks: PairRanks):
        self.ranks, self.pattern = ranks, regex.compile(WORDS)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts one after another, and the number of each."""
        number, known = self.number, len(self.number)
        found: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                own = self.pattern.findall(t)
                sizes[i] = len(own)
                found.extend([number.setdefault(w, len(number)) for w in own])
        if len(number) > known:
            new = [w.encode("utf-8", "surrogatepass") for w in itertools.islice(number, known, None)]
            ids, starts = encode_words(new, self.ranks)
            self.starts = np.concatenate([self.starts, starts[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        use = np.array(found, np.int64)
        counts = np.diff(self.starts)[use]
        edges = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(sizes)
        out = self.ids[ragged(self.starts[use], counts)], edges[ends] - edges[ends - sizes]
        if len(number) > CACHED or len(self.ids) > 8 * CACHED:
            self.clear()
        return out


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(id_col, ids)``: the ids of every row's text, an empty list for null and empty texts."""
    path = f"{folder}/{vocabulary}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(pair_ranks(path))
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                ids, sizes = words.encode(b.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "ids"])

    kind = df.select(F.col(f"`{id_col}`")).dtypes[0][1]
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
