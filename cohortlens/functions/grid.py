"""Exact arithmetic of the fits: features on a grid of whole numbers.

Features are multiplied by a power of two and rounded.  The scale is chosen so
that every squared distance is a whole number that a double holds exactly.
Sums are then the same in any order, and a fit does not depend on how the rows
are split over partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import _check_size, _matrix, _scatter

# Bits of a squared distance that doubles hold exactly, with room for the rounding.
EXACT_BITS = 51
# Finest grid: 2 ** -20 of a feature unit.
FINEST = 20
# Rows times centres that are compared at once.
BLOCK = 4_000_000

SUMS_SCHEMA = ("model int, cluster int, n long, sums array<long>, cost decimal(38,0), "
               "squares decimal(38,0), compared long")
# Columns of a point's bounds: nearest centre, distance to it, distance to the second nearest.
BOUNDS = ("_near", "_upper", "_lower")


def grid_scale(largest: float, dim: int) -> float:
    """The power of two that features with components up to ``largest`` are multiplied by."""
    if not math.isfinite(largest):
        raise ValueError("features must be finite")
    if largest == 0 or dim == 0:
        return 2.0 ** FINEST
    return 2.0 ** min(FINEST, math.floor(math.log2(math.sqrt(2.0 ** EXACT_BITS / dim) / (2 * largest))))


def on_grid(features: str | Column, scale: float) -> Column:
    """Whole-number features as a column; the same rounding as :func:`grid_matrix`."""
    col = F.col(features) if isinstance(features, str) else features
    return F.transform(col, lambda x: F.floor(x * F.lit(scale) + F.lit(0.5)).cast("long"))


def grid_matrix(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    x, valid = _matrix(column, dim)
    return np.floor(x * scale + 0.5), valid


def exact_nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre (ties to the lower) and the squared distance, all whole numbers."""
    index = np.empty(len(x), np.int64)
    dist = np.empty(len(x))
    c2 = (centres * centres).sum(axis=1)
    step = max(1, BLOCK // max(1, len(centres)))
    for s in range(0, len(x), step):
        part = x[s:s + step]
        d = (part * part).sum(axis=1)[:, None] + c2[None, :] - 2.0 * (part @ centres.T)
        index[s:s + step] = d.argmin(axis=1)
        dist[s:s + step] = d[np.arange(len(d)), index[s:s + step]]
    return index, dist


def _whole(values: np.ndarray) -> int:
    """Exact sum of whole numbers below 2 ** 52."""
    high = np.floor(values / 2.0 ** 26)
    low = values - high * 2.0 ** 26
    return (int(high.sum(dtype=np.float64)) << 26) + int(low.sum()) if len(values) < 1 << 26 else sum(
        map(int, values.tolist()))


class _Sums:
    """Running sums by (model, cluster)."""

    def __init__(self):
        self.found: dict[tuple[int, int], list] = {}

    def add(self, model: int, cluster: int, *values) -> None:
        """``values``: n, sums, cost, squares, compared."""
        old = self.found.get((model, cluster))
        self.found[model, cluster] = values if old is None else [a + b for a, b in zip(old, values)]

    def batch(self) -> pa.RecordBatch:
        keys, rows = list(self.found), list(self.found.values())
        number = pa.decimal128(38, 0)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([r[0] for r in rows], pa.int64()),
             pa.array([r[1].tolist() for r in rows], pa.list_(pa.int64())),
             pa.array([Decimal(r[2]) for r in rows], number),
             pa.array([Decimal(r[3]) for r in rows], number), pa.array([r[4] for r in rows], pa.int64())],
            names=["model", "cluster", "n", "sums", "cost", "squares", "compared"])


def with_bounds(points: DataFrame, centres: list, scale: float, features_col: str = "features") -> DataFrame:
    """Features with the BOUNDS of each point for ``centres`` (two or more), in grid units."""
    mat = np.asarray(centres, np.float64)
    _check_size([mat])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, valid = grid_matrix(b.column(features_col), mat.shape[1], scale)
            index, dist = exact_nearest(x, mat)
            second = np.full(len(x), np.inf)
            for s in range(0, len(x), max(1, BLOCK // len(mat))):
                part = x[s:s + max(1, BLOCK // len(mat))]
                d = (part * part).sum(axis=1)[:, None] + (mat * mat).sum(axis=1)[None, :] - 2.0 * (part @ mat.T)
                d[np.arange(len(d)), index[s:s + len(d)]] = np.inf
                second[s:s + len(d)] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, _scatter(index.astype(np.int32), valid, pa.int32()),
                 _scatter(np.sqrt(dist), valid, pa.float64()), _scatter(np.sqrt(second), valid, pa.float64())],
                names=[*b.schema.names, *BOUNDS])

    kinds = (T.IntegerType(), T.DoubleType(), T.DoubleType())
    return points.mapInArrow(run, T.StructType(
        [*points.schema.fields, *[T.StructField(c, k, True) for c, k in zip(BOUNDS, kinds)]]))


def bounded_nearest(x: np.ndarray, bounds: tuple[np.ndarray, ...], then: np.ndarray,
                    now: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """:func:`exact_nearest` of ``now`` with bounds taken for ``then``, and how many points it compared.

    A point whose nearest centre cannot have come as near as any other, by how
    far the centres moved, keeps it and only its distance is computed.
    """
    near, upper, lower = bounds
    index = near.astype(np.int64)
    drift = np.sqrt(((now - then) ** 2).sum(axis=1))
    most = int(drift.argmax())
    others = np.full(len(drift), drift[most])
    others[most] = np.delete(drift, most).max()
    # for the rounding of the roots
    slack = 1e-6 * (1.0 + upper + np.where(np.isfinite(lower), lower, 0.0))
    is_open = upper + drift[index] + others[index] + slack >= lower
    dist = ((x - now[index]) ** 2).sum(axis=1)
    if is_open.any():
        index[is_open], dist[is_open] = exact_nearest(x[is_open], now)
    return index, dist, int(is_open.sum())


def cluster_sums(points: DataFrame, models: dict[int, np.ndarray], scale: float,
                 features_col: str = "features", then: list | None = None, single: bool = False) -> list:
    """Exact sums of every cluster of several models, in one pass: rows of SUMS_SCHEMA.

    Points go to their nearest centre.  A task sends one row per model and
    cluster; unless the points are a ``single`` partition, those rows are dealt
    out by model and cluster and added up.  ``squares`` sums the squared lengths of the points,
    ``compared`` counts those that were compared with every centre: all, unless
    ``points`` carry bounds for the centres ``then`` (of a single model).
    """
    mats = {m: np.asarray(c, np.float64) for m, c in models.items()}
    _check_size(mats.values())
    dim = next(iter(mats.values())).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for b in batches:
            x, _ = grid_matrix(b.column(0), dim, scale)
            squares = (x * x).sum(axis=1)
            whole = x.astype(np.int64)
            for m, centres in mats.items():
                if then is None:
                    index, dist = exact_nearest(x, centres)
                    compared = len(x)
                else:
                    index, dist, compared = bounded_nearest(x, _bounds_of(b), before, centres)
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                if not len(used):
                    continue
                totals = np.add.reduceat(whole[order], starts, axis=0)
                for c, s, e, t in zip(used.tolist(), starts.tolist(),
                                      [*starts[1:].tolist(), len(order)], totals):
                    sums.add(m, c, e - s, t, _whole(dist[order[s:e]]), _whole(squares[order[s:e]]), compared)
                    compared = 0  # counted once a batch
        yield sums.batch()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for b in batches:
            for r in b.to_pylist():
                sums.add(r["model"], r["cluster"], r["n"], np.array(r["sums"], np.int64),
                         int(r["cost"]), int(r["squares"]), r["compared"])
        yield sums.batch()

    before = None if then is None else np.asarray(then, np.float64)
    rows = points.select(features_col, *(BOUNDS if then is not None else ())).mapInArrow(run, SUMS_SCHEMA)
    if not single:
        rows = rows.repartition("model", "cluster").mapInArrow(fold, SUMS_SCHEMA)
    return rows.collect()


def _bounds_of(batch: pa.RecordBatch, valid: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    got = [batch.column(c).to_numpy(zero_copy_only=False) for c in BOUNDS]
    return tuple(v if valid is None else v[valid] for v in got)


def moved_centre(sums: list[int], n: int) -> list[int]:
    """The mean on the grid, halves rounded up."""
    return [(2 * int(s) + n) // (2 * n) for s in sums]


def silhouette_sums(points: DataFrame, models: dict[int, tuple[np.ndarray, list]], scale: float,
                    features_col: str = "features") -> dict[int, float]:
    """Mean silhouette of several models in one pass.

    ``models`` maps a model to its centres and the rows of :func:`cluster_sums`
    for those centres.  A point alone in its cluster scores 0.
    """
    packed = {}
    for m, (centres, rows) in models.items():
        rows = sorted(rows, key=lambda r: r["cluster"])
        packed[m] = (np.asarray(centres, np.float64), np.array([r["cluster"] for r in rows]),
                     np.array([r["n"] for r in rows], np.float64),
                     np.array([r["sums"] for r in rows], np.float64),
                     np.array([float(r["squares"]) for r in rows]))
    dim = next(iter(packed.values()))[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: [0.0, 0] for m in packed}
        for b in batches:
            x, _ = grid_matrix(b.column(0), dim, scale)
            squares = (x * x).sum(axis=1)
            for m, (centres, ids, n, sums, psi) in packed.items():
                index, _ = exact_nearest(x, centres)
                own = np.searchsorted(ids, index)
                rows = np.arange(len(x))
                mean = squares[:, None] + (psi / n)[None, :] - 2.0 * (x @ sums.T) / n[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    a = mean[rows, own] * n[own] / (n[own] - 1)
                    mean[rows, own] = np.inf
                    near = mean.min(axis=1)
                    most = np.maximum(a, near)
                    s = np.where((n[own] <= 1) | (most == 0), 0.0, (near - a) / most)
                total[m][0] += float(s.sum())
                total[m][1] += len(s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.float64()),
             pa.array([t[1] for t in total.values()], pa.int64())], names=["model", "s", "n"])

    got = (points.select(features_col).mapInArrow(run, "model int, s double, n long")
           .groupBy("model").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect())
    return {r["model"]: r["s"] / r["n"] for r in got if r["n"]}


def with_grid_nearest(df: DataFrame, centre_sets: list, scale: float, features_col: str, outs: list[str],
                      dist_outs: list[str | None] | None = None) -> DataFrame:
    """Add, for each set of grid centres, the index of the nearest (ties to the lower) and on
    demand the distance in feature units; null features get nulls."""
    mats = [np.asarray(c, np.float64) for c in centre_sets]
    _check_size(mats)
    dist_outs = dist_outs or [None] * len(mats)
    fields = list(df.schema.fields)
    for o, do in zip(outs, dist_outs):
        fields.append(T.StructField(o, T.IntegerType(), True))
        if do:
            fields.append(T.StructField(do, T.DoubleType(), True))
    dim = mats[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, valid = grid_matrix(b.column(features_col), dim, scale)
            cols, names = list(b.columns), list(b.schema.names)
            for m, o, do in zip(mats, outs, dist_outs):
                index, dist = exact_nearest(x, m)
                cols.append(_scatter(index.astype(np.int32), valid, pa.int32()))
                names.append(o)
                if do:
                    cols.append(_scatter(dist / (scale * scale), valid, pa.float64()))
                    names.append(do)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, T.StructType(fields))


def with_bounded_peaks(bounded: DataFrame, then: list, coarse: list, peaks: list[int], scale: float,
                       features_col: str, out: str) -> DataFrame:
    """Add the index in ``peaks`` of the nearest peak, and drop the bounds.

    ``bounded`` carries bounds for the centres ``then``; ``peaks`` are indexes
    of the ``coarse`` centres those have become.  By the triangle inequality a
    point nearer to its coarse centre than half the gap between that centre's
    nearest and second nearest peak goes to the nearest; only the others are
    compared with the peaks.
    """
    centres, before = np.asarray(coarse, np.float64), np.asarray(then, np.float64)
    targets = centres[peaks]
    _check_size([centres])
    between = np.sqrt(((centres[:, None, :] - targets[None, :, :]) ** 2).sum(axis=2))
    best = between.argmin(axis=1)
    if len(peaks) > 1:
        two = np.partition(between, 1, axis=1)
        # a little less than half the gap, for the rounding of the roots
        reach = (two[:, 1] - two[:, 0]) / 2 * (1 - 1e-9) - 1e-6
    else:
        reach = np.full(len(centres), np.inf)
    kept = [f for f in bounded.schema.fields if f.name not in BOUNDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, valid = grid_matrix(b.column(features_col), centres.shape[1], scale)
            label, dist, _ = bounded_nearest(x, _bounds_of(b, valid), before, centres)
            index = best[label]
            is_open = np.sqrt(dist) >= reach[label]
            if is_open.any():
                index[is_open] = exact_nearest(x[is_open], targets)[0]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(f.name) for f in kept], _scatter(index.astype(np.int32), valid, pa.int32())],
                names=[*[f.name for f in kept], out])

    return bounded.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.IntegerType(), True)]))
