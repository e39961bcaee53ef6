"""Centres and assignments on ``array<double>`` feature columns.

Centre matrices are small (k x d, k a parameter); they travel with the task or
as a broadcast table, size-checked.  ``collect_centres`` checks the size before
anything reaches the driver.  Points are never paired with each
other: every operator here is O(n * k * d) in one pass over the points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import with_nearest
from ..functions.vectors import MAX_LITERAL_DOUBLES, sq_dist


def vector_dim(df: DataFrame, features_col: str = "features") -> int:
    """Length of the feature arrays, read from the first non-null row."""
    row = (df.where(F.col(features_col).isNotNull())
           .select(F.size(features_col)).first())
    if row is None:
        raise ValueError(f"no non-null {features_col!r} rows")
    return int(row[0])


def centroids(df: DataFrame, group_col: str, features_col: str = "features",
              dim: int | None = None, out: str = "centre") -> DataFrame:
    """``(group, n, centre)``: the mean vector of each group.

    One hash aggregation with ``dim`` averaging buffers: partial sums are
    combined map-side, so the shuffle carries one row per group per task.
    """
    dim = vector_dim(df, features_col) if dim is None else dim
    x = F.col(features_col)
    return df.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(x.getItem(i)) for i in range(dim)]).alias(out))


def collect_centres(centres: DataFrame, id_col: str, centre_col: str = "centre",
                    max_doubles: int = MAX_LITERAL_DOUBLES,
                    max_centres: int = 10_000) -> list[list[float]]:
    """Centres ordered by id, ids required to be 0..k-1.

    One job; at most ``max_centres + 1`` rows ever reach the driver, and the
    total size is checked against ``max_doubles`` before use.
    """
    rows = (centres.select(id_col, centre_col).orderBy(id_col)
            .limit(max_centres + 1).collect())
    if not rows:
        raise ValueError("no centres")
    if len(rows) > max_centres or len(rows) * len(rows[0][1]) > max_doubles:
        raise ValueError(f"more than {max_centres} centres or {max_doubles} doubles")
    ids = [r[0] for r in rows]
    if ids != list(range(len(ids))):
        raise ValueError(f"centre ids must be 0..k-1, got {ids[:10]}...")
    return [list(map(float, r[1])) for r in rows]


def assign_nearest(df: DataFrame, centres: list, features_col: str = "features",
                   out: str = "prediction", dist_col: str | None = None) -> DataFrame:
    """Index of the closest centre (ties -> lower index), optionally its distance.

    Runs as a vectorised per-partition kernel (exact squared distances);
    select the columns you need before calling, the kernel passes every
    input column through.
    """
    return with_nearest(df, [centres], features_col, [out], [dist_col])


def centre_table(spark, centres: list, id_name: str = "cluster", out: str = "centre") -> DataFrame:
    """Centres as a table ``(cluster, centre)``, size-checked for a broadcast."""
    if sum(len(c) for c in centres) > MAX_LITERAL_DOUBLES:
        raise ValueError(f"more than {MAX_LITERAL_DOUBLES} doubles of centres")
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)],
                                 f"`{id_name}` int, `{out}` array<double>")


def distance_to_own_centre(df: DataFrame, centres: list, cluster_col: str,
                           features_col: str = "features", out: str = "dist") -> DataFrame:
    """Squared distance from each point to the centre of its own cluster (C4).

    The size-checked centre table is broadcast and joined; a null or unknown
    cluster has no distance.
    """
    own = F.broadcast(centre_table(df.sparkSession, centres, "_own_id", "_own_centre"))
    return (df.join(own, F.col(cluster_col) == F.col("_own_id"), "left")
            .withColumn(out, sq_dist(features_col, "_own_centre")).drop("_own_id", "_own_centre"))


def sse(df: DataFrame, centres: list, cluster_col: str,
        features_col: str = "features") -> DataFrame:
    """One row ``(n_points, inertia)``: sum of squared distances to own centres."""
    d = distance_to_own_centre(df, centres, cluster_col, features_col, "_d")
    return d.agg(F.count(F.lit(1)).alias("n_points"), F.sum("_d").alias("inertia"))


def lloyd_step(df: DataFrame, centres: list, features_col: str = "features",
               dim: int | None = None) -> DataFrame:
    """One k-means iteration from given centres: assign, then re-average.

    Returns ``(cluster, n, centre)``; a centre that loses all its points is
    absent, as in Lloyd's algorithm without re-seeding.
    """
    dim = len(centres[0]) if dim is None else dim
    assigned = assign_nearest(df, centres, features_col, "cluster")
    return centroids(assigned, "cluster", features_col, dim)


def lloyd(df: DataFrame, centres: list, rounds: int, features_col: str = "features",
          out: str = "prediction") -> tuple[DataFrame, list]:
    """``rounds`` Lloyd steps from given centres; ``df`` with the labels, and the last centres.

    A centre that loses all its points stays where it is.  Only the centres
    (k vectors) come to the driver between the steps.
    """
    dim = len(centres[0])
    for _ in range(rounds):
        moved = {r["cluster"]: list(r["centre"])
                 for r in lloyd_step(df.select(features_col), centres, features_col, dim).collect()}
        centres = [moved.get(i, c) for i, c in enumerate(centres)]
    return assign_nearest(df, centres, features_col, out), centres
