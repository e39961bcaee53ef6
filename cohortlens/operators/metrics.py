"""Clustering quality (E1-E9), computed exactly and in parallel.

* silhouette: the closed form for squared Euclidean distance that MLlib's
  ``ClusteringEvaluator`` documents.  Per-cluster statistics (k rows: count,
  sum vector, sum of squared norms) are gathered once; every point then needs
  only its own row and those k statistics, so the cost is O(n * k * d) with no
  pairing of points.
* NMI / ARI / purity: from the contingency table ``(label, prediction) ->
  count``; sums of per-cell and per-marginal terms, no driver sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import silhouette_scores, with_nearest
from ..functions.vectors import sq_norm
from .geometry import vector_dim

# The silhouette of a clustering with fewer than two clusters (undefined).
NO_SILHOUETTE = -1.0


def cluster_stats(df: DataFrame, pred_col: str = "prediction", features_col: str = "features",
                  dim: int | None = None) -> DataFrame:
    """``(cluster, n, y, psi)``: size, sum vector, sum of squared norms per cluster."""
    dim = vector_dim(df, features_col) if dim is None else dim
    x = F.col(features_col)
    return df.where(F.col(pred_col).isNotNull()).groupBy(F.col(pred_col).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(x.getItem(i)) for i in range(dim)]).alias("y"),
        F.sum(sq_norm(x)).alias("psi"))


def _model(stats) -> tuple:
    """(ids, n, y, psi) of one clustering from its collected per-cluster rows."""
    return ([int(r["cluster"]) for r in stats], [float(r["n"]) for r in stats],
            [list(r["y"]) for r in stats], [float(r["psi"]) for r in stats])


def _score_models(df: DataFrame, stats_list: list, preds: list[str], features_col: str,
                  outs: list[str]) -> DataFrame:
    """Add one per-point silhouette column per clustering (vectorised kernel)."""
    return silhouette_scores(df, [_model(st) for st in stats_list], features_col, preds, outs)


def silhouette_points(df: DataFrame, pred_col: str = "prediction",
                      features_col: str = "features", dim: int | None = None,
                      out: str = "silhouette", stats=None) -> DataFrame:
    """Per-point silhouette ``s`` (0 for a point alone in its cluster; null if k < 2)."""
    if stats is None:
        stats = cluster_stats(df, pred_col, features_col, dim).orderBy("cluster").collect()
    if len(stats) < 2:
        return df.withColumn(out, F.lit(None).cast("double"))
    return _score_models(df, [stats], [pred_col], features_col, [out])


def stats_many(df: DataFrame, preds: list[str], features_col: str = "features",
               dim: int | None = None) -> dict[str, list]:
    """Per-cluster statistics of several prediction columns in one job.

    The points are fanned out over the prediction columns before a partially
    aggregated group-by on ``(column, cluster)``, so every clustering costs
    one pass together.  Returns ``{pred: rows sorted by cluster}``.
    """
    dim = vector_dim(df, features_col) if dim is None else dim
    x = F.col(features_col)
    fan = df.select(features_col, F.explode(F.array(*[
        F.struct(F.lit(i).alias("m"), F.col(p).alias("c")) for i, p in enumerate(preds)]))
        .alias("mc")).where(F.col("mc.c").isNotNull())
    rows = fan.groupBy(F.col("mc.m").alias("m"), F.col("mc.c").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(x.getItem(j)) for j in range(dim)]).alias("y"),
        F.sum(sq_norm(x)).alias("psi")).collect()
    return {p: sorted([r for r in rows if r["m"] == i], key=lambda r: r["cluster"])
            for i, p in enumerate(preds)}


def silhouettes_from_stats(df: DataFrame, stats: dict[str, list],
                           features_col: str = "features") -> dict[str, float]:
    """Mean silhouette of every prediction column in one scoring pass."""
    scored = [p for p, st in stats.items() if len(st) >= 2]
    result = {p: NO_SILHOUETTE for p in stats}
    if scored:
        outs = [f"_s{i}" for i in range(len(scored))]
        pts = _score_models(df.select(features_col, *scored), [stats[p] for p in scored],
                            scored, features_col, outs)
        vals = pts.agg(*[F.avg(o).alias(o) for o in outs]).first()
        for p, o in zip(scored, outs):
            result[p] = float(vals[o])
    return result


def sse_from_stats(stats: list, centres: list) -> float:
    """Sum of squared distances of each cluster's points to a given centre per cluster.

    ``sum |x - c|^2 = psi - 2 y.c + n |c|^2``; ``centres`` is indexed by cluster id.
    """
    total = 0.0
    for r in stats:
        c = centres[int(r["cluster"])]
        total += (float(r["psi"]) - 2.0 * sum(a * b for a, b in zip(r["y"], c))
                  + float(r["n"]) * sum(v * v for v in c))
    return total


def within_ss(stats: list) -> float:
    """Sum of squared distances to the cluster means."""
    return sum(float(r["psi"]) - sum(v * v for v in r["y"]) / r["n"] for r in stats)


def silhouette_many(df: DataFrame, centre_sets: list, features_col: str = "features",
                    dim: int | None = None) -> list[float]:
    """Silhouette of several centre sets (nearest-centre labels) in two jobs."""
    names = [f"_p{i}" for i in range(len(centre_sets))]
    pts = with_nearest(df.select(features_col), centre_sets, features_col, names)
    sils = silhouettes_from_stats(pts, stats_many(pts, names, features_col, dim), features_col)
    return [sils[nm] for nm in names]


def silhouette(df: DataFrame, pred_col: str = "prediction", features_col: str = "features",
               dim: int | None = None) -> DataFrame:
    """One row ``(silhouette)``; -1.0 when fewer than two clusters are used."""
    pts = silhouette_points(df, pred_col, features_col, dim, "_s")
    return pts.agg(F.coalesce(F.avg("_s"), F.lit(NO_SILHOUETTE)).alias("silhouette"))


def silhouette_by_cluster(df: DataFrame, pred_col: str = "prediction",
                          features_col: str = "features", dim: int | None = None) -> DataFrame:
    pts = silhouette_points(df, pred_col, features_col, dim, "_s")
    return pts.groupBy(F.col(pred_col).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_s").alias("silhouette"))


def cluster_sizes(df: DataFrame, pred_col: str = "prediction") -> DataFrame:
    """``(cluster, size)``."""
    return df.where(F.col(pred_col).isNotNull()).groupBy(F.col(pred_col).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


def cluster_size_map(df: DataFrame, pred_col: str = "prediction") -> DataFrame:
    """One row: ``cluster_sizes`` map ordered by cluster id, and ``n_clusters``."""
    sizes = cluster_sizes(df, pred_col)
    return sizes.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("cluster", "size"))))
        .alias("cluster_sizes"),
        F.count(F.lit(1)).cast("int").alias("n_clusters"))


def cluster_count(df: DataFrame, pred_col: str = "prediction") -> DataFrame:
    """One row ``(n_clusters)``."""
    return df.agg(F.count_distinct(pred_col).alias("n_clusters"))


def contingency(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """``(u, v, nuv)``: rows per (label, prediction) pair; null labels excluded."""
    return (df.where(F.col(label_col).isNotNull() & F.col(pred_col).isNotNull())
            .groupBy(F.col(label_col).alias("u"), F.col(pred_col).alias("v"))
            .agg(F.count(F.lit(1)).alias("nuv")))


def _c2(c: Column) -> Column:
    return c.cast("double") * (c.cast("double") - 1) / 2


def _external_from_cells(ct: DataFrame, keys: list[str]) -> DataFrame:
    """NMI / ARI / purity per ``keys`` group of a contingency table ``(keys.., u, v, nuv)``."""
    # marginals are aggregated before the shuffle and joined back, so a cluster
    # that holds every label is no hot group
    by_u = ct.groupBy(*keys, "u").agg(F.sum("nuv").alias("a"))
    by_v = ct.groupBy(*keys, "v").agg(F.sum("nuv").alias("b"), F.max("nuv").alias("m"))
    cells = ct.join(by_u, [*keys, "u"]).join(by_v, [*keys, "v"])
    nuv, a, b = (F.col(c).cast("double") for c in ("nuv", "a", "b"))
    s = cells.groupBy(*keys).agg(
        F.sum(nuv).alias("n"),
        F.sum(nuv * F.log(nuv)).alias("sl"),
        F.sum(nuv * F.log(a)).alias("sla"),
        F.sum(nuv * F.log(b)).alias("slb"),
        F.sum(nuv * (nuv - 1) / 2).alias("suv"),
        F.sum(nuv * (a - 1) / 2).alias("sa"),
        F.sum(nuv * (b - 1) / 2).alias("sb"),
        F.sum(nuv * F.col("m") / b).alias("best"),
        (F.min("a") == F.sum("nuv")).alias("one_label"),
        (F.min("b") == F.sum("nuv")).alias("one_cluster"))
    n = F.col("n")
    hu = F.log(n) - F.col("sla") / n
    hv = F.log(n) - F.col("slb") / n
    # mutual information is never negative; clamp rounding noise of the sums
    mi = F.greatest(F.log(n) + (F.col("sl") - F.col("sla") - F.col("slb")) / n, F.lit(0.0))
    # a single labelled row has no pairs: the defined value is 1
    expected = F.try_divide(F.col("sa") * F.col("sb"), n * (n - 1) / 2)
    ari_den = (F.col("sa") + F.col("sb")) / 2 - expected
    return s.select(
        *keys,
        F.when(F.col("one_label") & F.col("one_cluster"), F.lit(1.0))
        .otherwise(F.try_divide(mi, (hu + hv) / 2)).alias("nmi"),
        F.when((n <= 1) | (ari_den == 0), F.lit(1.0))
        .otherwise(F.try_divide(F.col("suv") - expected, ari_den)).alias("ari"),
        F.try_divide(F.col("best"), n).alias("purity"))


def external_scores(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """One row ``(nmi, ari, purity)`` against a ground-truth label.

    NMI uses the arithmetic mean of the two entropies (1.0 when both are 0);
    ARI is Hubert-Arabie's (1.0 when its denominator is 0); purity is
    ``sum_v max_u n_uv / n``.

    One pass over the points builds the contingency table; its marginals are
    joined back to the cells, and a single aggregate then yields every sum, using sum_u f(a_u) = sum_cells n_uv f(a_u) / a_u.
    """
    return _external_from_cells(contingency(df, label_col, pred_col), [])


def external_scores_many(df: DataFrame, label_col: str, preds: list[str]) -> dict[str, dict]:
    """``{pred: {nmi, ari, purity}}`` for several prediction columns in one job."""
    fan = df.select(F.col(label_col).alias("u"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("m"), F.col(p).alias("v")) for i, p in enumerate(preds)]))
        .alias("mv"))
    ct = (fan.where(F.col("u").isNotNull() & F.col("mv.v").isNotNull())
          .groupBy(F.col("mv.m").alias("mi_"), "u", F.col("mv.v").alias("v"))
          .agg(F.count(F.lit(1)).alias("nuv")))
    rows = _external_from_cells(ct, ["mi_"]).collect()
    return {preds[r["mi_"]]: {"nmi": r["nmi"], "ari": r["ari"], "purity": r["purity"]}
            for r in rows}
