"""Density-peak approximation stages.

Density of a coarse cluster is the mean squared distance of its points to
its centre (lower = denser).  Peaks are chosen greedily among the denser
half of the clusters: start at the densest, then repeatedly take the
candidate farthest (largest minimum squared distance) from the peaks chosen
so far, ties going to the denser candidate.  Points finally go to their
nearest peak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..defaults import COARSE_K_MAX, COARSE_K_MIN, COARSE_K_PER_PEAK, COARSE_MAX_ITER, SEED


def density_rank(points: DataFrame, cluster_col: str = "cluster",
                 dist_col: str = "dist", min_cluster_size: int = 1) -> DataFrame:
    """``(cluster, n, avg_dist, density_rank)``, rank 1 = densest.

    The ranking window runs over the per-cluster table (one row per coarse
    cluster, at most k_coarse rows), never over points.  Clusters with fewer
    than ``min_cluster_size`` points are left out (a lone outlier has mean
    distance 0 and would otherwise rank as the densest).
    """
    per = points.groupBy(F.col(cluster_col).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(dist_col).alias("avg_dist"))
    return rank_clusters(per, min_cluster_size)


def rank_clusters(per: DataFrame, min_cluster_size: int = 1) -> DataFrame:
    """A per-cluster table ``(cluster, n, avg_dist, ...)`` with ``density_rank``."""
    if min_cluster_size > 1:
        per = per.where(F.col("n") >= min_cluster_size)
    w = Window.orderBy("avg_dist", "cluster")
    return per.withColumn("density_rank", F.row_number().over(w))


def density_candidates(ranked: DataFrame, k_final: int) -> DataFrame:
    """The densest ``max(k_final, n_clusters // 2)`` clusters.

    The cluster count is a window over the per-cluster table (at most k_coarse
    rows, laid out like the rank window's), so the points are not read again.
    """
    n_clusters = F.count(F.lit(1)).over(Window.partitionBy())
    bound = F.greatest(F.lit(k_final), F.floor(n_clusters / 2).cast("bigint"))
    return (ranked.withColumn("_bound", bound)
            .where(F.col("density_rank") <= F.col("_bound")).drop("_bound"))


def farthest_point_peaks(candidates: DataFrame, k_final: int, centre_col: str = "centre",
                         rank_col: str = "density_rank") -> DataFrame:
    """Greedy farthest-point choice of ``k_final`` peaks among ``candidates``.

    Start at the densest candidate (lowest rank); each round takes the
    candidate with the largest minimum squared distance to the peaks chosen
    so far, ties going to the denser one.  ``candidates`` is a per-cluster
    table (at most k_coarse rows, one per coarse cluster), so it is gathered
    into one rank-sorted array and all rounds run as a single fold
    (``aggregate``) over it: one lazy plan, one job, no per-round query.  The
    fold keeps each candidate's running minimum distance, so a round costs
    O(k_coarse * d).
    Returns the chosen candidate rows with ``pick`` (0 = densest) and
    ``min_dist`` (distance to the nearer earlier peak; null for pick 0).
    Fewer than ``k_final`` rows when the candidates run out.
    """
    if k_final < 1:
        raise ValueError(f"k_final must be at least 1, got {k_final}")
    others = [c for c in candidates.columns if c != rank_col]
    packed = candidates.agg(F.sort_array(F.collect_list(F.struct(
        F.col(rank_col).alias("_rank"), *[F.col(c) for c in others]))).alias("_c"))
    c = F.col("_c")
    # one SQL expression (one call into the JVM); ``b`` binds the round's winner once
    centre = f"`{centre_col.replace('`', '``')}`"

    def dist(a: str, b: str) -> str:
        # same arithmetic and order as functions.vectors.sq_dist
        return (f"aggregate(zip_with({a}, {b}, (p, q) -> (p - q) * (p - q)), 0D, "
                f"(acc, v) -> acc + v)")

    init = (f"named_struct('picks', array(0), 'dists', array(CAST(NULL AS DOUBLE)), "
            f"'md', transform(_c, x -> {dist(f'x.{centre}', f'_c[0].{centre}')}))")
    # (min distance, -rank, index) of every candidate not chosen yet; the
    # largest is the farthest, ties to the lower rank
    best = ("array_max(filter(transform(_c, (x, j) -> named_struct('md', s.md[j], "
            "'nr', -x._rank, 'j', j)), t -> NOT array_contains(s.picks, t.j)))")
    step = (f"transform(array({best}), b -> CASE WHEN b IS NULL THEN s ELSE named_struct("
            f"'picks', concat(s.picks, array(b.j)), 'dists', concat(s.dists, array(b.md)), "
            f"'md', zip_with(s.md, _c, (m, x) -> least(m, "
            f"{dist(f'x.{centre}', f'_c[b.j].{centre}')}))) END)[0]")
    state = F.expr(f"aggregate(sequence(1, {k_final - 1}), {init}, (s, i) -> {step})"
                   if k_final > 1 else init)
    chosen = (packed.where(F.size(c) > 0)
              .select(c, state.alias("_s"))
              .select(c, "_s", F.posexplode("_s.picks").alias("pick", "_j")))
    return chosen.select(
        F.try_element_at(c, F.col("_j") + 1).alias("_cand"),
        F.col("pick").cast("int").alias("pick"),
        F.try_element_at(F.col("_s.dists"), F.col("pick") + 1).alias("min_dist"),
    ).select(*[F.col(f"_cand.{x}").alias(x) if x != rank_col
               else F.col("_cand._rank").alias(rank_col) for x in candidates.columns],
             "pick", "min_dist")


def coarse_k(k_final: int) -> int:
    """Default coarse cluster count for a given number of peaks."""
    return min(COARSE_K_MAX, max(COARSE_K_PER_PEAK * k_final, COARSE_K_MIN))


def density_peaks(df: DataFrame, k_final: int, k_coarse: int | None = None, *,
                  id_col: str = "user", features_col: str = "features",
                  prediction_col: str = "prediction", seed: int = SEED,
                  max_iter: int = COARSE_MAX_ITER,
                  prepared: DataFrame | None = None, n: int | None = None,
                  min_cluster_size: int = 1, partitions: int | None = None, starts=None,
                  bounds: bool = True):
    """Density-peak approximation (C8): coarse k-means -> density -> peaks -> assignment.

    The density of a coarse cluster comes from the sums of the fit's last
    pass, so the points are not read again for it.  With ``bounds`` the points
    keep their distance bounds from the coarse fit to the assignment, and
    those that cannot move are not compared again; the labels are the same
    without.  Returns ``(labelled df, info)``; ``info`` holds the peaks, the
    coarse k used, the peak centres and ``bounded``, the persisted points with
    their bounds (None without).  Fewer peaks than ``k_final`` are possible
    when the candidates run out; ``info['n_peaks']`` reports it.
    """
    from ..functions.grid import with_bounded_peaks, with_grid_nearest
    from .kmeans import fit_all, fit_bounded, fit_input, seeded_starts

    prepared = prepared if prepared is not None else fit_input(df, id_col, features_col, partitions, n=n)
    starts = starts or seeded_starts(prepared, id_col, features_col, seed, max(COARSE_K_MAX, k_coarse or 0))
    k_c = min(coarse_k(k_final) if k_coarse is None else k_coarse, starts.n - 1)
    if k_c < 2:
        raise ValueError(f"too few rows ({starts.n}) for a coarse clustering")
    if bounds:
        coarse = fit_bounded(prepared, k_c, starts, features_col=features_col, max_iter=max_iter)
    else:
        coarse = fit_all(prepared, [k_c], starts, features_col=features_col, max_iter=max_iter)[k_c]
    # at most k_coarse rows
    unit = coarse.scale * coarse.scale
    per = df.sparkSession.createDataFrame(
        [(s["cluster"], s["n"], float(int(s["cost"])) / s["n"] / unit, coarse.centres[s["cluster"]])
         for s in coarse.stats], "cluster int, n long, avg_dist double, centre array<double>")
    cand = density_candidates(rank_clusters(per, min_cluster_size), k_final)
    peaks = farthest_point_peaks(cand, k_final)
    # at most k_final rows
    chosen = [r["cluster"] for r in peaks.orderBy("pick").select("cluster").collect()]
    if not chosen:
        raise ValueError("no density candidates")
    grid_peaks = [coarse.grid_centres[c] for c in chosen]
    if coarse.bounded is not None and df is prepared:
        labelled = with_bounded_peaks(coarse.bounded, coarse.bounds_for, coarse.grid_centres, chosen,
                                      coarse.scale, features_col, prediction_col)
    else:
        labelled = with_grid_nearest(df, [grid_peaks], coarse.scale, features_col, [prediction_col])
    info = {"k_coarse": k_c, "n_peaks": len(chosen), "peak_centres": [coarse.centres[c] for c in chosen],
            "grid_peaks": grid_peaks, "peak_clusters": chosen, "coarse": coarse,
            "bounded": coarse.bounded}
    return labelled, info
