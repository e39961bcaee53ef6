"""Vectorised per-partition kernels for the distance-heavy steps.

Nearest-centre assignment and silhouette scoring cost O(n * k * d).  As
Spark higher-order functions they are interpreted element by element; here
each Arrow batch of a partition becomes one numpy matrix and the same
arithmetic runs in compiled loops.  Spark still partitions the rows and owns
every shuffle and aggregate around these kernels; only small fitted
matrices (centres, per-cluster sums, size-checked) travel with the function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .vectors import MAX_LITERAL_DOUBLES

# Rows per numpy block: bounds the n x k x d temporary of exact distances.
BLOCK_ELEMENTS = 4_000_000


def _check_size(mats) -> None:
    total = sum(int(np.asarray(m).size) for m in mats)
    if total > MAX_LITERAL_DOUBLES:
        raise ValueError(f"{total} doubles of centres exceed the bound {MAX_LITERAL_DOUBLES}")


def _matrix(arr: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(valid rows as an n_valid x d float64 matrix, validity mask)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    lengths = pc.list_value_length(arr).to_numpy(zero_copy_only=False)
    lengths = np.where(np.isnan(lengths.astype("float64")), -1, lengths).astype(np.int64)
    valid = lengths == d
    if (~valid & (lengths >= 0)).any():
        raise ValueError(f"a vector has not the expected length {d}")
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if valid.all():
        return flat.reshape(-1, d), valid
    # flatten() keeps the values of the non-null lists in order: find where
    # each valid row starts and gather its d values in one indexing step
    sizes = np.maximum(lengths, 0)
    starts = np.cumsum(sizes) - sizes
    take = starts[valid][:, None] + np.arange(d)[None, :]
    return flat[take].reshape(-1, d), valid


def _scatter(values: np.ndarray, valid: np.ndarray, typ: pa.DataType) -> pa.Array:
    if valid.all():
        return pa.array(values, type=typ)
    full = np.zeros(len(valid), dtype=values.dtype)
    full[valid] = values
    return pa.array(full, type=typ, mask=~valid)


def sq_dists(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances n x k, computed block by block."""
    out = np.empty((x.shape[0], c.shape[0]))
    step = max(1, BLOCK_ELEMENTS // max(1, c.shape[0] * c.shape[1]))
    for s in range(0, x.shape[0], step):
        diff = x[s:s + step, None, :] - c[None, :, :]
        out[s:s + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the closest centre (first on ties) and its squared distance."""
    d = sq_dists(x, c)
    idx = d.argmin(axis=1)
    return idx.astype(np.int32), d[np.arange(len(idx)), idx]


def with_nearest(df: DataFrame, centre_sets: list, features_col: str, outs: list[str],
                 dist_outs: list[str | None] | None = None) -> DataFrame:
    """Add, for each centre set, the nearest-centre index (and optionally its distance)."""
    mats = [np.asarray(c, dtype=np.float64) for c in centre_sets]
    _check_size(mats)
    dist_outs = dist_outs or [None] * len(mats)
    fields = list(df.schema.fields)
    for o, do in zip(outs, dist_outs):
        fields.append(T.StructField(o, T.IntegerType(), True))
        if do:
            fields.append(T.StructField(do, T.DoubleType(), True))
    schema = T.StructType(fields)
    dim = mats[0].shape[1]

    def run(batches):
        for b in batches:
            x, valid = _matrix(b.column(features_col), dim)
            cols, names = list(b.columns), list(b.schema.names)
            for m, o, do in zip(mats, outs, dist_outs):
                idx, dist = nearest(x, m)
                cols.append(_scatter(idx, valid, pa.int32()))
                names.append(o)
                if do:
                    cols.append(_scatter(dist, valid, pa.float64()))
                    names.append(do)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, schema)


def silhouette_scores(df: DataFrame, models: list, features_col: str, preds: list[str],
                      outs: list[str]) -> DataFrame:
    """Add per-point silhouette columns, one per model.

    ``models`` holds, per model, (cluster ids, n, sum vectors y, sums of
    squared norms psi).  For squared Euclidean distance the mean distance
    from x to cluster k is |x|^2 + psi_k/n_k - 2 x.y_k/n_k; the own-cluster
    mean excludes the point itself (factor n/(n-1)); a point alone in its
    cluster scores 0.
    """
    packed = []
    for ids, n, y, psi in models:
        packed.append((np.asarray(ids, dtype=np.int64), np.asarray(n, dtype=np.float64),
                       np.asarray(y, dtype=np.float64), np.asarray(psi, dtype=np.float64)))
    _check_size([p[2] for p in packed])
    schema = T.StructType(list(df.schema.fields)
                          + [T.StructField(o, T.DoubleType(), True) for o in outs])
    dim = packed[0][2].shape[1]

    def run(batches):
        for b in batches:
            x, valid = _matrix(b.column(features_col), dim)
            nx = np.einsum("ij,ij->i", x, x)
            cols, names = list(b.columns), list(b.schema.names)
            for (ids, n, y, psi), p, o in zip(packed, preds, outs):
                pred = b.column(p).to_numpy(zero_copy_only=False).astype(np.float64)[valid]
                known = ~np.isnan(pred)
                pos = np.where(known, np.searchsorted(ids, pred), 0)
                f = nx[:, None] + (psi / n)[None, :] - 2.0 * (x @ y.T) / n[None, :]
                rows = np.arange(len(pos))
                n_own = n[pos]
                with np.errstate(divide="ignore", invalid="ignore"):
                    a = f[rows, pos] * n_own / (n_own - 1)
                    f_other = f.copy()
                    f_other[rows, pos] = np.inf
                    bmin = f_other.min(axis=1)
                    m = np.maximum(a, bmin)
                    s = np.where((n_own <= 1) | (m == 0), 0.0, (bmin - a) / m)
                scored = valid.copy()
                scored[valid] = known
                cols.append(_scatter(s[known], scored, pa.float64()))
                names.append(o)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, schema)
