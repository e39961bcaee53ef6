"""Per-method metric records (E5) and their comparison table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import (
    NO_SILHOUETTE,
    cluster_stats,
    external_scores,
    external_scores_many,
    silhouette_points,
    silhouettes_from_stats,
    sse_from_stats,
    stats_many,
    within_ss,
)

METRIC_SCHEMA = T.StructType([
    T.StructField("method", T.StringType(), False),
    T.StructField("runtime_s", T.DoubleType(), True),
    T.StructField("n_clusters", T.IntegerType(), False),
    T.StructField("silhouette", T.DoubleType(), True),
    T.StructField("inertia", T.DoubleType(), True),
    T.StructField("within_ss", T.DoubleType(), True),
    T.StructField("cluster_sizes", T.MapType(T.IntegerType(), T.LongType()), True),
    T.StructField("nmi", T.DoubleType(), True),
    T.StructField("ari", T.DoubleType(), True),
    T.StructField("purity", T.DoubleType(), True),
])


def evaluate(df: DataFrame, method: str, *, prediction_col: str = "prediction",
             features_col: str = "features", label_col: str | None = None,
             inertia: float | None = None, runtime: float = 0.0,
             dim: int | None = None) -> dict:
    """Metric record of one clustering.

    :func:`evaluate_many` with one method; external scores stay empty when
    every label is null.
    ``inertia`` is the method's own cost (k-means training cost, or squared
    distance to the density peaks); ``within_ss`` is the sum of squared
    distances to the cluster means, available for every method.
    """
    return evaluate_many(df, [{"name": method, "pred": prediction_col, "runtime": runtime,
                               "inertia": inertia}],
                         features_col=features_col, label_col=label_col, dim=dim)[0]


def evaluate_many(df: DataFrame, methods: list[dict], *, features_col: str = "features",
                  label_col: str | None = None, dim: int | None = None) -> list[dict]:
    """Metric records of several clusterings carried as columns of one DataFrame.

    ``methods`` holds dicts with ``name``, ``pred`` (column), and optionally
    ``runtime``, ``inertia`` (a number) or ``centres`` (inertia is then the
    squared distance of each cluster to its centre, from the statistics).
    Three jobs in all, whatever the number of methods: per-cluster statistics
    of every column, every silhouette, and every external score.
    """
    preds = [m["pred"] for m in methods]
    stats = stats_many(df, preds, features_col, dim)
    sils = silhouettes_from_stats(df, stats, features_col)
    ext = (external_scores_many(df, label_col, preds)
           if label_col and label_col in df.columns else {})
    records = []
    for m in methods:
        st = stats[m["pred"]]
        inertia = m.get("inertia")
        if inertia is None and m.get("centres") is not None:
            inertia = sse_from_stats(st, m["centres"])
        rec = {"method": m["name"], "runtime_s": round(float(m.get("runtime", 0.0)), 2),
               "n_clusters": len(st), "silhouette": round(float(sils[m["pred"]]), 4),
               "inertia": None if inertia is None else round(float(inertia), 2),
               "within_ss": round(within_ss(st), 2),
               "cluster_sizes": {int(r["cluster"]): int(r["n"]) for r in st},
               "nmi": None, "ari": None, "purity": None}
        if m["pred"] in ext:
            rec.update({k: round(float(v), 4) for k, v in ext[m["pred"]].items()})
        records.append(rec)
    return records


def metrics_frame(spark, records: list[dict]) -> DataFrame:
    """The comparison table: one row per method."""
    rows = [tuple(r.get(f.name) for f in METRIC_SCHEMA.fields) for r in records]
    return spark.createDataFrame(rows, METRIC_SCHEMA)
