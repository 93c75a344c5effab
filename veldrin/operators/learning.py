"""A linear correction of candidate logits, trained on rows ``(x, z, gold)`` by full-batch Adam.

``x`` are features, ``z`` the frozen base logits of a row's own candidates, as many as it has, ``gold`` the position of the
right one, ``dev`` marks the rows that the result is chosen by. The penalty is on the mean square of the correction
of those candidates; weights themselves don't decay. Every epoch is one Spark job that sums the gradients of all
trials over all rows; only the sums, candidates times features, come to the driver. Gradients are clipped, and the
epoch of least loss on the dev rows is kept, the start (no correction) included, so the result is never worse there.
The control ``bias`` trains the biases alone, ``residual`` the weights too. Rows with a null in any column stay out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLIP = 5.0


@dataclass
class Head:
    """Weights ``(candidates, features)``, biases, and the dev loss they were chosen by."""

    weights: np.ndarray
    bias: np.ndarray
    dev_nll: float
    rate: float = 0.0
    penalty: float = 0.0
    epoch: int = 0


def _dense(lists: pa.Array, width: int, fill: float) -> tuple[np.ndarray, np.ndarray]:
    """Lists of at most ``width`` numbers as rows, filled up, and which places they have."""
    length = np.diff(lists.offsets.to_numpy())
    there = np.arange(width) < length[:, None]
    out = np.full((len(lists), width), fill)
    out[there] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, there


def _sums(rows: DataFrame, thetas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each trial's weights (the last column are the biases): the gradients of the loss and of the squared correction
    summed over training rows, and the loss summed over dev rows; and how many training rows, dev rows, and candidates
    of training rows there are."""
    trials, k, h = thetas.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square, loss, n = np.zeros((trials, k, h)), np.zeros((trials, k, h)), np.zeros(trials), np.zeros(3)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            z, there = _dense(batch.column(1), k, -1e9)
            gold, dev = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            n += (~dev).sum(), dev.sum(), there[~dev].sum()
            for i, theta in enumerate(thetas):
                delta = x @ theta.T * there
                logits = z + delta
                logits -= logits.max(axis=1, keepdims=True)
                p = np.exp(logits) * there
                p /= p.sum(axis=1, keepdims=True)
                loss[i] -= np.log(np.maximum(p[np.arange(len(gold)), gold], 1e-300))[dev].sum()
                p[np.arange(len(gold)), gold] -= 1
                total[i] += p[~dev].T @ x[~dev]
                square[i] += 2 * delta[~dev].T @ x[~dev]
        values = np.concatenate([total.ravel(), square.ravel(), loss, n])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "v"])

    whole = rows.select("x", F.transform("z", lambda v: v.cast("double")).alias("z"), F.col("gold").cast("long").alias("gold"), "dev").where("x IS NOT NULL AND z IS NOT NULL AND gold IS NOT NULL AND dev IS NOT NULL")
    got = whole.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(2 * thetas.size + trials + 3)
    for i, x in got:  # as many as there are weights
        v[i] = x
    gradient, square, loss, n = np.split(v, np.cumsum([thetas.size, thetas.size, trials]))
    return gradient.reshape(thetas.shape), square.reshape(thetas.shape), loss, n


def train_heads(rows: DataFrame, candidates: int, features: int, rates: Sequence[float] = (0.001, 0.003), penalties: Sequence[float] = (0.01, 0.1), epochs: int = 120, every: int = 5, controls: Sequence[str] = ("bias", "residual"), history: list | None = None) -> dict[str, Head]:
    """The best head of each control over all rates and penalties, by the rows with ``dev``; the others are trained on.

    All trials move together, one job an epoch. Of equal losses the earlier trial wins, then its earlier epoch.
    ``history`` takes ``(control, rate, penalty, epoch, dev loss)`` of each epoch that is looked at.
    """
    trials = [(c, r, p) for c in controls for r in rates for p in penalties]
    theta = np.zeros((len(trials), candidates, features + 1))
    free = np.ones_like(theta)
    free[[i for i, t in enumerate(trials) if t[0] == "bias"], :, :-1] = 0
    rate, penalty = (np.array([t[k] for t in trials])[:, None, None] for k in (1, 2))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    best: list[Head | None] = [None] * len(trials)
    for epoch in range(epochs + 1):
        g, square, loss, (n, dev, places) = _sums(rows, theta)
        if epoch % every == 0 or epoch == epochs:
            for i, trial in enumerate(trials):
                mean = loss[i] / max(dev, 1)
                if history is not None:
                    history.append((*trial, epoch, mean))
                if best[i] is None or mean < best[i].dev_nll:
                    best[i] = Head(theta[i, :, :-1].copy(), theta[i, :, -1].copy(), mean, *trial[1:], epoch)
        g = (g / max(n, 1) + penalty * square / max(places, 1)) * free
        size = np.sqrt((g * g).sum(axis=(1, 2), keepdims=True))
        g = g * np.minimum(1.0, CLIP / (size + 1e-6))
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        theta = theta - rate * (first / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    return {c: min((b for b, t in zip(best, trials) if t[0] == c), key=lambda b: b.dev_nll) for c in controls}


def train_head(rows: DataFrame, candidates: int, features: int, rates: Sequence[float] = (0.03, 0.1), penalties: Sequence[float] = (0.001,), epochs: int = 10, every: int = 5) -> Head:
    """The best residual head."""
    return train_heads(rows, candidates, features, rates, penalties, epochs, every, ("residual",))["residual"]
