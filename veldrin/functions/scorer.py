"""Scorers: anything that gives one logit for each candidate, applied to batches of rows.

A scorer sees whole Arrow batches and must give the same logits whatever the batches are. Rows whose candidates are
null or empty get a null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .folding import mix, pieces, to_codes


class Scorer(Protocol):
    def score(self, prompts: Sequence[str], candidates: Sequence[Sequence[str]]) -> list[list[float]]: ...


class HashScorer:
    """A deterministic stand-in for a model: features are hashed pieces of three characters, a candidate's logit is the
    cosine of its pieces and the prompt's."""

    def __init__(self, width: int = 256, scale: float = 10.0):
        self.width, self.scale = width, scale

    def _vectors(self, texts: Sequence[str]) -> np.ndarray:
        packed, row = pieces(*to_codes(texts))
        h = mix(packed)
        place = row * self.width + (h % np.uint64(self.width)).astype(np.int64)
        v = np.bincount(place, np.where(h >> np.uint64(63), 1.0, -1.0), len(texts) * self.width).reshape(len(texts), self.width)
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)

    def score(self, prompts: Sequence[str], candidates: Sequence[Sequence[str]]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(prompts), 500):
            own = candidates[at : at + 500]
            sizes = np.array([len(c) for c in own], np.int64)
            shown = self._vectors([x for c in own for x in c])
            logits = self.scale * (np.repeat(self._vectors(prompts[at : at + 500]), sizes, axis=0) * shown).sum(axis=1)
            out.extend(x.tolist() for x in np.split(np.round(logits, 6), np.cumsum(sizes)[:-1]))
        return out


def with_logits(df: DataFrame, scorer: Scorer, prompt: str, candidates: str, id_col: str = "id") -> DataFrame:
    """``(id, logits)`` of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts, own = [p or "" for p in b.column(1).to_pylist()], b.column(2).to_pylist()
            scores = iter(scorer.score([p for p, c in zip(prompts, own) if c], [["" if x is None else x for x in c] for c in own if c]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([next(scores) if c else None for c in own], pa.list_(pa.float64()))], ["id", "logits"])

    return df.select(df[id_col].alias("id"), prompt, candidates).mapInArrow(run, "id string, logits array<double>")
