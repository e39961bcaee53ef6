"""k-means (C1), the silhouette-driven k sweep (C2) and the coarse fit.

One seeded k-means|| start serves every k: rows are drawn by a hash of seed,
id and features with a chance that follows their squared distance, the drawn
candidates are weighted by the points next to them, and a weighted k-means++
walk over them gives an ordered list of starts.  A fit with k clusters begins
with the first k.

Lloyd passes carry all unfinished k at once and add whole numbers
(:mod:`..functions.grid`), so a fit is the same for any partitioning and a
sweep needs as many jobs as its longest fit.  A model is finished when none of
its centres moves on the grid.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..defaults import COARSE_K_MAX, K_MAX, K_MIN, KMEANS_MAX_ITER, SEED
from ..functions.grid import (
    cluster_sums,
    grid_scale,
    moved_centre,
    on_grid,
    silhouette_sums,
    with_bounds,
    with_grid_nearest,
)
from ..plans.lineage import materialize
from .metrics import NO_SILHOUETTE

# Rows of a partition of the fit input; the partition count follows the row
# count, or is given by the caller.  The result does not depend on it.
ROWS_PER_PARTITION = 50_000
# Drawing rounds of the start, and rows drawn in each on average: twice the
# largest k, and at least twice the largest coarse k.
START_ROUNDS = 2
DRAWN = 2 * COARSE_K_MAX
# Rows of a round that may reach the driver, in multiples of the average; more
# has no chance and is an error.
DRAWN_LIMIT = 20
# Share of points that had to be compared, beyond which new bounds are taken.
RENEW = 0.3
_HASH_RANGE = 1 << 32


@dataclass
class Starts:
    """Ordered start centres on the grid, with what the points were found to be."""

    scale: float
    centres: list[list[int]]
    n: int
    dim: int
    seed: int


@dataclass
class KMeansResult:
    k: int
    centres: list[list[float]]
    cost: float
    iterations: int
    scale: float = 1.0
    grid_centres: list[list[int]] = field(default_factory=list)
    stats: list = field(default_factory=list)  # rows of cluster_sums for the final centres
    compared: list[int] = field(default_factory=list)  # points compared with every centre, by iteration
    bounded: DataFrame | None = None  # points with their bounds, persisted
    bounds_for: list[list[int]] | None = None  # the centres those bounds were taken for


def fit_record(res: KMeansResult) -> dict:
    """A fit as plain values, without its stored points."""
    return {"k": res.k, "cost": res.cost, "iterations": res.iterations, "scale": res.scale,
            "grid_centres": res.grid_centres,
            "stats": [[s["model"], s["cluster"], s["n"], list(s["sums"]), str(s["cost"]), str(s["squares"]),
                       s["compared"]] for s in res.stats]}


def fit_from_record(found: dict) -> KMeansResult:
    stat = Row("model", "cluster", "n", "sums", "cost", "squares", "compared")
    return KMeansResult(found["k"], [[v / found["scale"] for v in c] for c in found["grid_centres"]],
                        found["cost"], found["iterations"], found["scale"], found["grid_centres"],
                        [stat(m, c, n, sums, Decimal(cost), Decimal(squares), seen)
                         for m, c, n, sums, cost, squares, seen in found["stats"]])


def fit_input(df: DataFrame, id_col: str, features_col: str = "features",
              partitions: int | None = None, keep=(), n: int | None = None,
              store: str = "persist", rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Id + features (+ ``keep`` columns), dealt out by the hash of the id and computed once.

    ``partitions`` defaults to one per ``rows_per_partition`` rows.  The result
    is persisted (memory, then disk) for the repeated passes; pass
    ``store="checkpoint"`` to also cut lineage when the input is expensive
    to recompute.
    """
    cols = df.select(id_col, features_col, *keep)
    if partitions is None:
        n = cols.count() if n is None else n
        partitions = max(1, math.ceil(n / rows_per_partition))
    laid = cols.coalesce(1) if partitions == 1 else cols.repartition(partitions, id_col)
    if store == "checkpoint":
        laid = materialize(laid)
    stored = laid.persist(StorageLevel.MEMORY_AND_DISK)
    stored.count()
    return stored


def is_single(points: DataFrame) -> bool:
    """Whether stored points are one partition, so that their sums need no second stage."""
    return points.storageLevel != StorageLevel.NONE and points.rdd.getNumPartitions() == 1


def check_k(k: int, n: int) -> None:
    if k < 2 or k > n:
        raise ValueError(f"k must be between 2 and the number of rows ({n}), got {k}")


def _draw(name: str, *parts: str | Column) -> Column:
    """A whole number below 2 ** 32 from the md5 of ``name`` and the parts."""
    text = F.concat_ws(":", F.lit(name), *[F.coalesce(p, F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _hash_number(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:8], 16)


def seeded_starts(points: DataFrame, id_col: str = "user", features_col: str = "features",
                  seed: int = SEED, most: int = COARSE_K_MAX) -> Starts:
    """The ordered starts of every k up to ``most``: 2 + 2 * START_ROUNDS jobs.

    Rows with null features take no part.  Rows that repeat id and features
    are drawn together and count as one candidate.  Fewer distinct rows than
    ``most`` give fewer starts.
    """
    x = F.col(features_col)
    name = F.col(id_col).cast("string")
    rows = points.where(x.isNotNull())
    single = is_single(points)
    top = rows.agg(
        F.max(F.greatest(F.array_max(x), -F.array_min(x))).alias("largest"), F.max(F.size(x)).alias("dim"),
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(_draw(f"{seed}:first", name).alias("draw"), name.alias("id"), x.alias("x"))).alias("first")
    ).first()
    if not top["n"]:
        raise ValueError(f"no non-null {features_col!r} rows")
    scale = grid_scale(float(top["largest"] or 0.0), int(top["dim"]))
    found = {tuple(math.floor(v * scale + 0.5) for v in top["first"]["x"])}
    drawn = max(DRAWN, 2 * most)
    for r in range(1, START_ROUNDS + 1):
        centres = sorted(found)
        total = sum(int(s["cost"]) for s in cluster_sums(rows, {0: centres}, scale, features_col,
                                                        single=single))
        if not total:
            break
        chance = F.col("_dist") * F.lit(float(scale * scale)) * F.lit(float(drawn))
        number = _draw(f"{seed}:{r}", name, F.array_join(F.col("_grid").cast("array<string>"), ","))
        near = with_grid_nearest(rows.select(id_col, features_col), [centres], scale, features_col,
                                 ["_index"], ["_dist"]).withColumn("_grid", on_grid(features_col, scale))
        got = (near.where(number.cast("double") / F.lit(float(_HASH_RANGE)) * F.lit(float(total)) < chance)
               .select("_grid").distinct().limit(DRAWN_LIMIT * drawn + 1).collect())
        if len(got) > DRAWN_LIMIT * drawn:
            raise ValueError("far more rows were drawn than the draw allows")
        found |= {tuple(g[0]) for g in got}
    candidates = sorted(found)
    weights = {s["cluster"]: s["n"] for s in cluster_sums(rows, {0: candidates}, scale, features_col,
                                                           single=single)}
    order = _weighted_walk(np.array(candidates, object).reshape(len(candidates), -1),
                           [weights.get(i, 0) for i in range(len(candidates))], most, seed)
    return Starts(scale, [list(candidates[i]) for i in order], int(top["n"]), int(top["dim"]), seed)


def _weighted_walk(candidates: np.ndarray, weights: list[int], most: int, seed: int) -> list[int]:
    """Weighted k-means++ over the candidates: each next one by a draw that follows weight times
    squared distance to those before it, in whole numbers."""
    mass = list(weights)
    gap: list[int] | None = None
    order: list[int] = []
    while len(order) < min(most, len(candidates)) and sum(mass):
        target = _hash_number(f"{seed}:start:{len(order)}") * sum(mass)
        reached, pick = 0, 0
        for i, w in enumerate(mass):
            reached += w
            if reached * _HASH_RANGE > target:
                pick = i
                break
        order.append(pick)
        dist = ((candidates - candidates[pick]) ** 2).sum(axis=1).tolist()
        gap = dist if gap is None else list(map(min, gap, dist))
        mass = [w * g for w, g in zip(weights, gap)]
    return order


def fit_all(points: DataFrame, ks, starts: Starts, *, features_col: str = "features",
            max_iter: int = KMEANS_MAX_ITER) -> dict[int, KMeansResult]:
    """Lloyd fits of all ``ks`` from the first k starts each, one job per iteration for all of them.

    Finished models leave.  A centre without points stays where it is.  A model
    that still moves after ``max_iter`` iterations gets one more pass for the
    sums of its last centres.
    """
    rows = points.where(F.col(features_col).isNotNull())
    single = is_single(points)
    now = {k: [list(c) for c in starts.centres[:k]] for k in ks}
    out: dict[int, KMeansResult] = {}

    def finished(k: int, sums: list, iterations: int) -> KMeansResult:
        unit = starts.scale
        return KMeansResult(k, [[v / unit for v in c] for c in now[k]],
                            float(sum(int(s["cost"]) for s in sums)) / (unit * unit), iterations, unit,
                            now[k], sorted(sums, key=lambda s: s["cluster"]))

    for i in range(max_iter + 1):
        live = {k: c for k, c in now.items() if k not in out}
        if not live:
            break
        got: dict[int, list] = {k: [] for k in live}
        for s in cluster_sums(rows, live, starts.scale, features_col, single=single):
            got[s["model"]].append(s)
        for k, sums in got.items():
            fresh = list(now[k])
            for s in sums:
                fresh[s["cluster"]] = moved_centre(s["sums"], s["n"])
            if fresh == now[k] or i == max_iter:
                out[k] = finished(k, sums, i)
            else:
                now[k] = fresh
    return {k: out[k] for k in ks}


def fit_bounded(points: DataFrame, k: int, starts: Starts, *, features_col: str = "features",
                max_iter: int = KMEANS_MAX_ITER, renew: float = RENEW) -> KMeansResult:
    """The fit of :func:`fit_all` for one (large) k, with distance bounds kept per point.

    The points are stored with the distances to their nearest and second
    nearest centre.  As long as the centres have moved less than the gap, a
    point keeps its centre without being compared with the others.  When more
    than ``renew`` of the points had to be compared, the next pass stores new
    bounds; that is no job of its own.  The result carries the last bounds;
    release them with ``unpersist``.
    """
    now = [list(c) for c in starts.centres[:k]]
    if len(now) < 2:
        return fit_all(points, [k], starts, features_col=features_col, max_iter=max_iter)[k]
    bounded, taken, compared, worn, single = None, now, [], True, is_single(points)
    for i in range(max_iter + 1):
        if worn:
            old, taken = bounded, now
            bounded = with_bounds(points, now, starts.scale, features_col).persist(StorageLevel.MEMORY_AND_DISK)
        sums = cluster_sums(bounded.where(F.col(features_col).isNotNull()), {k: now}, starts.scale, features_col,
                            taken, single)
        if worn and old is not None:
            old.unpersist()
        open_points = sum(s["compared"] for s in sums)
        compared.append(starts.n if worn else open_points)
        worn = not worn and open_points > renew * starts.n
        fresh = list(now)
        for s in sums:
            fresh[s["cluster"]] = moved_centre(s["sums"], s["n"])
        if fresh == now or i == max_iter:
            break
        now = fresh
    unit = starts.scale
    return KMeansResult(k, [[v / unit for v in c] for c in now],
                        float(sum(int(s["cost"]) for s in sums)) / (unit * unit), i, unit, now,
                        sorted(sums, key=lambda s: s["cluster"]), compared, bounded, taken)


def label(df: DataFrame, res: KMeansResult, features_col: str = "features", out: str = "prediction",
          dist_col: str | None = None) -> DataFrame:
    """``df`` with the nearest centre of a fit, compared on its grid."""
    return with_grid_nearest(df, [res.grid_centres], res.scale, features_col, [out], [dist_col])


def kmeans(df: DataFrame, k: int, *, id_col: str = "user", features_col: str = "features",
           prediction_col: str = "prediction", seed: int = SEED, max_iter: int = KMEANS_MAX_ITER,
           prepared: DataFrame | None = None, n: int | None = None, partitions: int | None = None,
           starts: Starts | None = None) -> tuple[DataFrame, KMeansResult]:
    """Fixed-k k-means; returns ``df`` with ``prediction_col`` and the fit.

    The same rows, seed and k give the same centres for any partitioning.
    """
    prepared = prepared if prepared is not None else fit_input(df, id_col, features_col, partitions, n=n)
    starts = starts or seeded_starts(prepared, id_col, features_col, seed, max(k, COARSE_K_MAX))
    check_k(k, starts.n)
    res = fit_all(prepared, [k], starts, features_col=features_col, max_iter=max_iter)[k]
    return label(df, res, features_col, prediction_col), res


@dataclass
class SweepResult:
    best_k: int
    best_silhouette: float
    best: KMeansResult
    scores: list[tuple[int, float, float]]  # (k, silhouette, inertia)


def kmeans_sweep(df: DataFrame, k_range=range(K_MIN, K_MAX + 1), *, id_col: str = "user",
                 features_col: str = "features", seed: int = SEED, max_iter: int = KMEANS_MAX_ITER,
                 prepared: DataFrame | None = None, n: int | None = None, partitions: int | None = None,
                 fitted: dict | None = None, starts: Starts | None = None) -> tuple[DataFrame, SweepResult]:
    """Fit every k, score each by silhouette, keep the best (ties -> smaller k).

    Ks outside ``[2, n]`` are skipped.  All fits share one start and one job
    per iteration; all are scored in one more job.  ``fitted`` maps k to an
    existing fit on the same input, seed and iteration cap (the result would
    be identical), which is then reused.
    """
    ks = sorted(set(k_range))
    prepared = prepared if prepared is not None else fit_input(df, id_col, features_col, partitions, n=n)
    starts = starts or seeded_starts(prepared, id_col, features_col, seed, max([COARSE_K_MAX, *ks]))
    ks = [k for k in ks if 2 <= k <= starts.n]
    if not ks:
        raise ValueError(f"no k in {list(k_range)} fits {starts.n} rows")
    fits = {k: f for k, f in (fitted or {}).items() if k in ks}
    fits |= fit_all(prepared, [k for k in ks if k not in fits], starts, features_col=features_col,
                    max_iter=max_iter)
    scored = {k: (f.grid_centres, f.stats) for k, f in fits.items() if len(f.stats) >= 2}
    sils = {} if not scored else silhouette_sums(
        prepared.where(F.col(features_col).isNotNull()), scored, starts.scale, features_col)
    best, best_s = None, NO_SILHOUETTE
    for k in ks:
        if sils.get(k, NO_SILHOUETTE) > best_s:
            best, best_s = fits[k], sils[k]
    if best is None:
        raise ValueError("no k gave a silhouette above -1 (every fit used a single cluster)")
    scores = [(k, sils.get(k, NO_SILHOUETTE), fits[k].cost) for k in ks]
    return label(df, best, features_col), SweepResult(best.k, best_s, best, scores)
