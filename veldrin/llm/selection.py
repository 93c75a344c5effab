"""Exact percentiles per group by distributed multi-select.

Every task turns its rows into sorted runs of distinct values and their counts, one for each group and column; this
is the form in which separate days or loads are combined: unite their runs and select. Then, for all groups and
percentiles together, each run proposes the median of its values that are still possible, the weighted median of
the proposals, first within tasks and then across them, becomes the pivot, all runs count what lies below, at and above it, and the side that can't hold the
wanted rank is ruled out. Values that no percentile of their group can take any more leave the runs as they shrink.
Once few enough are left for a percentile, they are ranked.

A percentile ``p`` of ``n`` values is the value of rank ``ceil(n * p)``, at least 1, in ascending order: an error of 0.
Nulls and NaN are not values; a group without values has no row. Null group keys are a group. Infinite values count.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

#: Rows that a task sorts together, and the distinct values that a run holds at most.
SORTED_ROWS, RUN_VALUES = 250_000, 65_536
#: Values left for a percentile from which they are ranked instead of halved again.
FINISH = 512
#: Groups up to which the state of the search is broadcast to the runs; beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 20_000
#: Rounds after which ruled-out values are taken out of the runs.
SHRINK_EVERY = 3

RUNS = "dimension string, grp string, metric string, vals array<double>, counts array<long>"
KEY = ["dimension", "grp", "metric"]


def sorted_runs(df: DataFrame, dimensions: dict[str, Column], metrics: Sequence[str]) -> DataFrame:
    """The combinable form of a load: for each dimension, group and metric, runs of distinct values with counts."""
    dims, names = list(dimensions), list(metrics)
    schema = pa.schema([("dimension", pa.string()), ("grp", pa.string()), ("metric", pa.string()), ("vals", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64()))])

    def runs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for k, dim in enumerate(dims):
            coded = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            code, labels = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            for j, metric in enumerate(names):
                v = table.column(len(dims) + j).to_numpy()
                there = ~np.isnan(v)
                order = np.lexsort((v[there], code[there]))
                value, group = v[there][order] + 0.0, code[there][order]  # -0.0 becomes 0.0
                if not len(value):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (group[1:] != group[:-1])]))
                count, value, group = np.diff(np.append(new, len(value))), value[new], group[new]
                edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
                rows = [(labels[group[a]], at, min(at + RUN_VALUES, b)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) for at in range(a, b, RUN_VALUES)]
                offsets = pa.array([r[1] for r in rows] + [rows[-1][2]], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(rows)), pa.array([r[0] for r in rows], pa.string()), pa.array([metric] * len(rows)), pa.ListArray.from_arrays(offsets, pa.array(value)), pa.ListArray.from_arrays(offsets, pa.array(count))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= SORTED_ROWS:
                yield from runs(pa.Table.from_batches(held))
                held = []
        if held:
            yield from runs(pa.Table.from_batches(held))

    cols = [c.cast("string").alias(f"d{k}") for k, c in enumerate(dimensions.values())] + [F.col(f"`{m}`").cast("double").alias(f"m{k}") for k, m in enumerate(names)]
    return df.select(*cols).mapInArrow(run, RUNS)


def _matched(rows: DataFrame, state: DataFrame, groups: int, key: Sequence[str] = KEY) -> DataFrame:
    """Rows beside the state of their group; null keys match."""
    s = state.select(*(F.col(k).alias(f"_{k}") for k in key), *(c for c in state.columns if c not in key))
    on = functools.reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key))
    return rows.join(F.broadcast(s) if groups <= BROADCAST_GROUPS else s, on).drop(*(f"_{k}" for k in key))


def _places(vals: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where and to where the values between two bounds go; NaN is no bound."""
    return np.where(np.isnan(low), 0, np.searchsorted(vals, low, "right")), np.searchsorted(vals, high, "left")


def _lists(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The lists of each row as arrays, without copying values."""
    parts = []
    for n in names:
        c = batch.column(batch.schema.get_field_index(n))
        parts.append((c.offsets.to_numpy().tolist(), c.values.to_numpy(zero_copy_only=False)))
    for i in range(batch.num_rows):
        yield tuple(v[o[i] : o[i + 1]] for o, v in parts)


def _median(vals: np.ndarray, cum: np.ndarray, a: int, b: int) -> float:
    """Lower median of the values from place ``a`` to ``b``, by their cumulative counts."""
    if a >= b:
        return np.nan
    base = cum[a - 1] if a else 0
    return vals[np.searchsorted(cum, base + (cum[b - 1] - base + 1) // 2)]


def _weighted(proposals: list[tuple[float, int]]) -> float:
    """The weighted lower median of ``(value, weight)``; NaN of none."""
    if not proposals:
        return np.nan
    value, weight = (np.array(x) for x in zip(*sorted(proposals)))
    cum = np.cumsum(weight)
    return float(value[np.searchsorted(cum, (cum[-1] + 1) // 2)])


def _counted(runs: DataFrame, state: DataFrame, groups: int) -> DataFrame:
    """``KEY, i, below, at, above, low_median, high_median``: what the runs of a task together say to each open
    percentile's pivot, one row for each task that holds values of its group: the counts are sums, the medians the weighted
    ones of the runs' medians."""
    names = [*KEY, "i", "below", "at", "above", "low_median", "high_median"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[tuple, tuple[list[int], list, list]] = {}
        for b in batches:
            keys = list(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in KEY)))
            for key, (vals, counts, i, low, high, pivot) in zip(keys, _lists(b, "vals", "counts", "i", "low", "high", "pivot")):
                cum = np.cumsum(counts)
                total = lambda x: int(cum[x - 1]) if x else 0
                a, e = (x.tolist() for x in _places(vals, low, high))
                x, y = np.searchsorted(vals, pivot, "left").tolist(), np.searchsorted(vals, pivot, "right").tolist()
                for k in range(len(i)):
                    if a[k] < e[k]:
                        lo, up = max(a[k], min(x[k], e[k])), max(a[k], min(y[k], e[k]))
                        sums, lows, highs = told.setdefault((*key, int(i[k])), ([0, 0, 0], [], []))
                        below, above = total(lo) - total(a[k]), total(e[k]) - total(up)
                        sums[0], sums[1], sums[2] = sums[0] + below, sums[1] + total(up) - total(lo), sums[2] + above
                        if below:
                            lows.append((_median(vals, cum, a[k], lo), below))
                        if above:
                            highs.append((_median(vals, cum, up, e[k]), above))
        rows = [(*key, *sums, _weighted(lows), _weighted(highs)) for key, (sums, lows, highs) in told.items()]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

    return _matched(runs, state, groups).select(*KEY, "vals", "counts", "i", "low", "high", "pivot").mapInArrow(run, "dimension string, grp string, metric string, i int, below long, at long, above long, low_median double, high_median double")


def _kept(runs: DataFrame, state: DataFrame, groups: int) -> DataFrame:
    """Runs without the values that no open percentile can take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new_vals, new_counts, rows = [], [], []
            for row, (vals, counts, low, high) in enumerate(_lists(b, "vals", "counts", "low", "high")):
                edge = np.zeros(len(vals) + 1, np.int64)
                first, end = _places(vals, low, high)
                np.add.at(edge, first, 1)
                np.add.at(edge, np.maximum(first, end), -1)
                open_ = np.cumsum(edge[:-1]) > 0
                if open_.any():
                    rows.append(row)
                    new_vals.append(vals[open_])
                    new_counts.append(counts[open_])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(v) for v in new_vals])]), pa.int32())
            flat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((new_vals, np.float64), (new_counts, np.int64))]
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)).take(taken) for k in KEY), *(pa.ListArray.from_arrays(offsets, pa.array(f)) for f in flat)], [*KEY, "vals", "counts"])

    return _matched(runs, state, groups).select(*KEY, "vals", "counts", "low", "high").mapInArrow(run, RUNS)


def _left(runs: DataFrame, state: DataFrame, groups: int) -> DataFrame:
    """``KEY, i, rank, value, count``: the values that are still possible for each percentile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, (vals, counts, i, low, high, rank) in enumerate(_lists(b, "vals", "counts", "i", "low", "high", "rank")):
                for k, (a, e) in enumerate(zip(*_places(vals, low, high))):
                    if a < e:
                        same = lambda x, t: pa.array(np.full(e - a, x), t)
                        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).take(same(row, pa.int64())) for c in KEY), same(i[k], pa.int32()), same(rank[k], pa.int64()), pa.array(vals[a:e]), pa.array(counts[a:e])], [*KEY, "i", "rank", "value", "count"])

    return _matched(runs, state, groups).select(*KEY, "vals", "counts", "i", "low", "high", "rank").mapInArrow(run, "dimension string, grp string, metric string, i int, rank long, value double, count long")


def _gathered(open_: DataFrame) -> DataFrame:
    """One row for each group, with the open percentiles as lists."""
    s = F.collect_list(F.struct("i", "low", "high", "pivot", "rank"))
    return open_.groupBy(*KEY).agg(s.alias("s")).select(*KEY, *(F.col(f"s.{c}").alias(c) for c in ("i", "low", "high", "pivot", "rank")))


def _weighted_median(proposals: Column) -> Column:
    """The weighted lower median of an array of ``(value, weight)`` structs, as many as there are tasks at most."""
    there = F.array_sort(F.filter(proposals, lambda x: x["weight"] > 0))
    whole = F.aggregate(proposals, F.lit(0).cast("long"), lambda a, x: a + x["weight"])
    begin = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("value"), whole.alias("whole"))
    step = lambda a, x: F.struct((a["seen"] + x["weight"]).alias("seen"), F.coalesce(a["value"], F.when(2 * (a["seen"] + x["weight"]) >= a["whole"], x["value"])).alias("value"), a["whole"].alias("whole"))
    return F.aggregate(there, begin, step)["value"]


def select_percentiles(runs: DataFrame, permille: Sequence[int]) -> DataFrame:
    """``(dimension, grp, metric, permille, n, value)`` of the united ``runs``."""
    runs = stage(runs, "runs")
    weight = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    none = F.lit(float("nan"))
    sizes = stage(runs.select(*KEY, weight.alias("n")).groupBy(*KEY).agg(F.sum("n").alias("n")), "sizes")
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(permille)))).alias("w")
    ranks = sizes.select(*KEY, "n", wanted).select(*KEY, F.col("w.i").alias("i"), F.greatest(F.ceil(F.col("n") * F.col("w.p") / 1000).cast("long"), F.lit(1)).alias("rank"), F.col("n").alias("remaining"), none.alias("low"), none.alias("high"), none.alias("pivot"))
    # nothing is known yet, and all values lie below a pivot that is no number
    state = stage(ranks.withColumn("found", F.lit(None).cast("double")), "state")
    groups, rounds = sizes.count(), 0
    finished: list[DataFrame] = []
    while True:
        open_ = state.where("found IS NULL AND remaining > %d" % FINISH)
        finished.append(state.where("found IS NOT NULL OR remaining <= %d" % FINISH))
        if open_.isEmpty():
            break
        told = _counted(runs, _gathered(open_), groups)
        proposed = lambda value, weight: F.collect_list(F.struct(F.col(value).alias("value"), F.col(weight).alias("weight")))
        sums = told.groupBy(*KEY, "i").agg(F.sum("below").alias("b"), F.sum("at").alias("e"), F.sum("above").alias("m"), proposed("low_median", "below").alias("lows"), proposed("high_median", "above").alias("highs"))
        sums = _matched(sums, open_.select(*KEY, "i", "rank", "low", "high", "pivot"), groups, (*KEY, "i"))
        side = F.when(F.col("rank") <= F.col("b"), -1).when(F.col("rank") <= F.col("b") + F.col("e"), 0).otherwise(1)
        state = stage(
            sums.withColumn("side", side).select(
                *KEY, "i", F.when(F.col("side") == 1, F.col("rank") - F.col("b") - F.col("e")).otherwise(F.col("rank")).alias("rank"),
                F.when(F.col("side") == -1, F.col("b")).when(F.col("side") == 1, F.col("m")).otherwise(F.col("e")).alias("remaining"),
                F.when(F.col("side") == 1, F.col("pivot")).otherwise(F.col("low")).alias("low"), F.when(F.col("side") == -1, F.col("pivot")).otherwise(F.col("high")).alias("high"),
                F.when(F.col("side") == 0, F.col("pivot")).otherwise(_weighted_median(F.when(F.col("side") == -1, F.col("lows")).otherwise(F.col("highs")))).alias("pivot"), F.when(F.col("side") == 0, F.col("pivot")).alias("found"),
            ),
            "state",
        )
        rounds += 1
        if rounds % SHRINK_EVERY == 0:
            # percentiles that are to be ranked keep their values too
            alive = state.where("found IS NULL")
            for f in finished:
                alive = alive.unionByName(f.where("found IS NULL").select(alive.columns))
            runs = stage(_kept(runs, _gathered(alive), groups), "runs")
    ended = finished[0]
    for f in finished[1:]:
        ended = ended.unionByName(f.select(ended.columns))
    values = _left(runs, _gathered(ended.where("found IS NULL")), groups)
    below = Window.partitionBy(*KEY, "i").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("seen", F.sum("count").over(below)).where("seen >= rank").groupBy(*KEY, "i").agg(F.min("value").alias("value"))
    all_found = ended.where("found IS NOT NULL").select(*KEY, "i", F.col("found").alias("value")).unionByName(ranked)
    p = F.element_at(F.array(*map(F.lit, permille)), F.col("i") + 1)
    return _matched(all_found, sizes, groups).select(*KEY, p.alias("permille"), "n", "value")
