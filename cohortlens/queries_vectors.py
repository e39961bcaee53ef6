"""Registered queries over the embeddings table (centres, density peaks, metrics).

Fixed centres make every step deterministic and SQL-checkable: the coarse
clusters are the label centroids (mean embedding per label), each point's
coarse cluster is its nearest centroid, and the density-peak stages run on
top of that exactly as they do after a coarse k-means fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import density as dn
from .operators import geometry as geo
from .operators import metrics as mt
from .sources import tables as tb

# start centres and steps of the unrolled k-means query
LLOYD_K = 5
LLOYD_ROUNDS = 3

K_FINAL = 4


def rounded(df: DataFrame) -> DataFrame:
    from .queries import rounded as r
    return r(df)


def _centred(spark: SparkSession, sf_dir: str):
    v = tb.vectors(spark, sf_dir)
    dim = geo.vector_dim(v)
    cents = geo.centroids(v, "label", "features", dim)
    centres = geo.collect_centres(cents, "label")
    return v, dim, centres


def _assigned(spark, sf_dir):
    v, dim, centres = _centred(spark, sf_dir)
    return geo.assign_nearest(v, centres, "features", "cluster", "dist"), dim, centres


def _peaks(spark, sf_dir, k_final=K_FINAL):
    pts, dim, centres = _assigned(spark, sf_dir)
    ranked = dn.density_rank(pts, "cluster", "dist")
    cand = dn.density_candidates(ranked, k_final).join(
        F.broadcast(geo.centre_table(spark, centres)), "cluster")
    return pts, dim, centres, ranked, dn.farthest_point_peaks(cand, k_final)


def _peak_centres(spark, sf_dir):
    """The chosen peaks' centres (at most K_FINAL rows), one job."""
    _, dim, _, _, peaks = _peaks(spark, sf_dir)
    rows = peaks.orderBy("pick").select("centre").collect()
    return dim, [list(r[0]) for r in rows]


def _peak_assigned(spark, sf_dir):
    dim, peak_centres = _peak_centres(spark, sf_dir)
    # from the raw vectors: the coarse assignment is not needed again
    return geo.assign_nearest(tb.vectors(spark, sf_dir), peak_centres, "features",
                              "prediction"), dim


def q_label_centroids(spark, sf_dir):
    v = tb.vectors(spark, sf_dir)
    c = geo.centroids(v, "label", "features")
    return rounded(c.select("label", "n", F.posexplode("centre").alias("dim", "value")))


def q_distance_to_center(spark, sf_dir):
    v, _, centres = _centred(spark, sf_dir)
    d = geo.distance_to_own_centre(v, centres, "label", "features", "dist")
    return rounded(d.select("vec_id", "label", "dist"))


def q_nearest_center(spark, sf_dir):
    pts, _, _ = _assigned(spark, sf_dir)
    return rounded(pts.select("vec_id", "cluster", "dist"))


def q_cluster_sizes(spark, sf_dir):
    pts, _, _ = _assigned(spark, sf_dir)
    return mt.cluster_sizes(pts, "cluster")


def q_cluster_count(spark, sf_dir):
    pts, _, _ = _assigned(spark, sf_dir)
    return mt.cluster_count(pts, "cluster")


def q_inertia(spark, sf_dir):
    pts, _, centres = _assigned(spark, sf_dir)
    return rounded(geo.sse(pts, centres, "cluster"))


def q_density_rank(spark, sf_dir):
    pts, _, _ = _assigned(spark, sf_dir)
    return rounded(dn.density_rank(pts, "cluster", "dist"))


def q_density_candidates(spark, sf_dir):
    pts, _, _ = _assigned(spark, sf_dir)
    return rounded(dn.density_candidates(dn.density_rank(pts, "cluster", "dist"), K_FINAL))


def q_farthest_point_peaks(spark, sf_dir):
    # lazy: the density pass and the peak choice run once, when the result is read
    _, _, _, _, peaks = _peaks(spark, sf_dir)
    return rounded(peaks.select("pick", "cluster", "density_rank", "min_dist"))


def q_nearest_peak(spark, sf_dir):
    pts, _ = _peak_assigned(spark, sf_dir)
    return pts.select("vec_id", "prediction")


def q_lloyd_step(spark, sf_dir):
    v, dim, centres = _centred(spark, sf_dir)
    new = geo.lloyd_step(v, centres, "features", dim)
    return rounded(new.select("cluster", "n", F.posexplode("centre").alias("dim", "value")))


def q_lloyd_rounds(spark, sf_dir):
    """k-means iterations from the vectors of the smallest ids as start centres."""
    v = tb.vectors(spark, sf_dir)
    start = [list(r["features"]) for r in v.orderBy("vec_id").limit(LLOYD_K).collect()]
    labelled, _ = geo.lloyd(v.select("vec_id", "features"), start, LLOYD_ROUNDS)
    return labelled.select("vec_id", "prediction")


def q_silhouette(spark, sf_dir):
    pts, dim = _peak_assigned(spark, sf_dir)
    return rounded(mt.silhouette(pts, "prediction", "features", dim))


def q_silhouette_by_cluster(spark, sf_dir):
    pts, dim = _peak_assigned(spark, sf_dir)
    return rounded(mt.silhouette_by_cluster(pts, "prediction", "features", dim))


def q_contingency_metrics(spark, sf_dir):
    pts, _ = _peak_assigned(spark, sf_dir)
    return rounded(mt.external_scores(pts, "label", "prediction"))


def q_method_record(spark, sf_dir):
    """E5: the metric record of a deterministic clustering (fixed-centre density peaks)."""
    from .operators.evaluate import evaluate, metrics_frame

    dim, peak_centres = _peak_centres(spark, sf_dir)
    labelled = geo.assign_nearest(tb.vectors(spark, sf_dir), peak_centres, "features",
                                  "prediction")
    cost = geo.sse(labelled, peak_centres, "prediction").first()["inertia"]
    rec = evaluate(labelled, "DensityPeaks-fixed", label_col="label", inertia=cost, dim=dim)
    return metrics_frame(spark, [rec]).select(
        "method", "n_clusters", "silhouette", "inertia", "within_ss", F.concat_ws(",", F.transform(
            F.array_sort(F.map_entries("cluster_sizes")), lambda e: F.concat_ws(
                ":", e["key"].cast("string"), e["value"].cast("string")))).alias("cluster_sizes"),
        "nmi", "ari", "purity")


QUERIES = {
    "method_record": q_method_record,
    "label_centroids": q_label_centroids,
    "distance_to_center": q_distance_to_center,
    "nearest_center": q_nearest_center,
    "cluster_sizes": q_cluster_sizes,
    "cluster_count": q_cluster_count,
    "inertia": q_inertia,
    "density_rank": q_density_rank,
    "density_candidates": q_density_candidates,
    "farthest_point_peaks": q_farthest_point_peaks,
    "nearest_peak": q_nearest_peak,
    "lloyd_step": q_lloyd_step,
    "lloyd_rounds": q_lloyd_rounds,
    "silhouette": q_silhouette,
    "silhouette_by_cluster": q_silhouette_by_cluster,
    "contingency_metrics": q_contingency_metrics,
}


# --- DuckDB side ------------------------------------------------------------------

def sqd(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def sqn(a: str) -> str:
    return f"list_sum(list_transform({a}, lambda v: v * v))"


BASE_CTE = f"""pts AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
lng AS (SELECT label, unnest(generate_series(0, len(x) - 1)) AS i, unnest(x) AS v FROM pts),
cent_long AS (SELECT label, i, count(*) AS n, avg(v) AS v FROM lng GROUP BY label, i),
cent AS (SELECT label AS cluster, max(n) AS n, list(v ORDER BY i) AS c FROM cent_long GROUP BY label),
pc AS (SELECT p.vec_id, p.label, p.x, c.cluster, {sqd('p.x', 'c.c')} AS d FROM pts p CROSS JOIN cent c),
near AS (SELECT vec_id, label, x, cluster, d FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS rn FROM pc)
  WHERE rn = 1),
dens AS (SELECT cluster, count(*) AS n, avg(d) AS avg_dist,
    row_number() OVER (ORDER BY avg(d), cluster) AS density_rank FROM near GROUP BY cluster),
cand AS (SELECT dens.*, cent.c FROM dens JOIN cent USING (cluster)
  WHERE density_rank <= greatest({K_FINAL}, (SELECT count(*) FROM dens) // 2))"""


def _lloyd_ctes() -> str:
    """The rounds unrolled: labels ``a<r>`` and centres ``c<r>`` of every round."""
    parts = [f"c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, x AS c FROM pts "
             f"ORDER BY vec_id LIMIT {LLOYD_K})"]
    for r in range(LLOYD_ROUNDS + 1):
        parts.append(f"""a{r} AS (SELECT vec_id, x, k FROM (SELECT vec_id, x, k, row_number() OVER (
            PARTITION BY vec_id ORDER BY {sqd('x', 'c')}, k) AS rn FROM pts CROSS JOIN c{r}) WHERE rn = 1)""")
        parts.append(f"""c{r + 1} AS (SELECT c{r}.k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
            SELECT k, list(v ORDER BY i) AS c FROM (SELECT k, i, avg(v) AS v FROM (
              SELECT k, unnest(generate_series(0, len(x) - 1)) AS i, unnest(x) AS v FROM a{r})
              GROUP BY k, i) GROUP BY k) m ON m.k = c{r}.k)""")
    return ", ".join(parts)


def _peak_ctes(k_final: int = K_FINAL) -> str:
    parts = ["prev0 AS (SELECT cluster, density_rank, c, CAST(NULL AS DOUBLE) AS min_dist, "
             "0 AS pick FROM cand WHERE density_rank = 1)"]
    for j in range(1, k_final):
        parts.append(f"""p{j} AS (SELECT cluster, density_rank, c, md AS min_dist, {j} AS pick FROM (
    SELECT cand.cluster, cand.density_rank, cand.c, min({sqd('cand.c', 'pr.c')}) AS md
    FROM cand, prev{j - 1} pr
    WHERE cand.density_rank NOT IN (SELECT density_rank FROM prev{j - 1})
    GROUP BY cand.cluster, cand.density_rank, cand.c)
  ORDER BY md DESC, density_rank LIMIT 1),
prev{j} AS (SELECT * FROM prev{j - 1} UNION ALL SELECT * FROM p{j})""")
    last = k_final - 1
    parts.append(f"peaks AS (SELECT * FROM prev{last})")
    parts.append(f"""pp AS (SELECT p.vec_id, p.label, p.x, k.pick, {sqd('p.x', 'k.c')} AS d
  FROM pts p CROSS JOIN peaks k),
np AS (SELECT vec_id, label, x, pick AS prediction FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, pick) AS rn FROM pp)
  WHERE rn = 1)""")
    return ",\n".join(parts)


PEAK_CTE = BASE_CTE + ",\n" + _peak_ctes()

SILHOUETTE_CTE = PEAK_CTE + f""",
st AS (SELECT prediction AS cluster, count(*) AS n, sum({sqn('x')}) AS psi FROM np GROUP BY prediction),
sy AS (SELECT cluster, list(s ORDER BY i) AS y FROM (
    SELECT prediction AS cluster, i, sum(v) AS s FROM (
      SELECT prediction, unnest(generate_series(0, len(x) - 1)) AS i, unnest(x) AS v FROM np)
    GROUP BY prediction, i)
  GROUP BY cluster),
stats AS (SELECT st.*, sy.y FROM st JOIN sy USING (cluster)),
pf AS (SELECT np.vec_id, np.prediction, s.cluster, s.n,
    {sqn('np.x')} + s.psi / s.n - 2 * {dot('np.x', 's.y')} / s.n AS f
  FROM np CROSS JOIN stats s),
pt AS (SELECT vec_id, prediction,
    max(CASE WHEN cluster = prediction THEN n END) AS n_own,
    max(CASE WHEN cluster = prediction THEN f END) AS f_own,
    min(CASE WHEN cluster <> prediction THEN f END) AS b
  FROM pf GROUP BY vec_id, prediction),
sv AS (SELECT vec_id, prediction, CASE WHEN n_own <= 1 THEN 0.0
    WHEN greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s
  FROM (SELECT *, f_own * n_own / (n_own - 1) AS a FROM pt))"""

CONTINGENCY_CTE = """ct AS (SELECT label AS u, prediction AS v, count(*) AS nuv FROM np GROUP BY 1, 2),
au AS (SELECT u, sum(nuv) AS a FROM ct GROUP BY u),
bv AS (SELECT v, sum(nuv) AS b FROM ct GROUP BY v),
tot AS (SELECT CAST(sum(nuv) AS DOUBLE) AS n FROM ct),
hu AS (SELECT -sum(a / n * ln(a / n)) AS hu, sum(a * (a - 1) / 2) AS sa FROM au, tot),
hv AS (SELECT -sum(b / n * ln(b / n)) AS hv, sum(b * (b - 1) / 2) AS sb FROM bv, tot),
cells AS (SELECT sum(nuv / n * ln(n * nuv / (a * b))) AS mi, sum(nuv * (nuv - 1) / 2) AS suv
  FROM ct JOIN au USING (u) JOIN bv USING (v), tot),
best AS (SELECT sum(m) AS m FROM (SELECT v, max(nuv) AS m FROM ct GROUP BY v)),
agg AS (SELECT cells.*, hu.*, hv.*, best.m, tot.n,
    hu.sa * hv.sb / (tot.n * (tot.n - 1) / 2) AS expected FROM cells, hu, hv, best, tot)"""

ORACLE = {
    "method_record": f"""WITH {SILHOUETTE_CTE}, {CONTINGENCY_CTE},
        sse AS (SELECT sum(d) AS inertia FROM pp JOIN np USING (vec_id)
                WHERE pp.pick = np.prediction),
        wss AS (SELECT sum(psi - {sqn('y')} / n) AS within_ss FROM stats)
        SELECT 'DensityPeaks-fixed' AS method,
               CAST((SELECT count(*) FROM stats) AS INTEGER) AS n_clusters,
               round((SELECT avg(s) FROM sv), 4) AS silhouette,
               round((SELECT inertia FROM sse), 2) AS inertia,
               round((SELECT within_ss FROM wss), 2) AS within_ss,
               (SELECT string_agg(cluster || ':' || n, ',' ORDER BY cluster) FROM stats) AS cluster_sizes,
               round(CASE WHEN hu + hv = 0 THEN 1.0 ELSE mi / ((hu + hv) / 2) END, 4) AS nmi,
               round(CASE WHEN (sa + sb) / 2 - expected = 0 THEN 1.0
                     ELSE (suv - expected) / ((sa + sb) / 2 - expected) END, 4) AS ari,
               round(m / n, 4) AS purity
        FROM agg""",
    "label_centroids": f"WITH {BASE_CTE} SELECT label, CAST(n AS BIGINT) AS n, "
                       f"CAST(i AS INTEGER) AS dim, round(v, 6) AS value FROM cent_long",
    "distance_to_center": f"WITH {BASE_CTE} SELECT vec_id, label, round(d, 6) AS dist "
                          f"FROM pc WHERE cluster = label",
    "nearest_center": f"WITH {BASE_CTE} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, "
                      f"round(d, 6) AS dist FROM near",
    "cluster_sizes": f"WITH {BASE_CTE} SELECT CAST(cluster AS INTEGER) AS cluster, "
                     f"count(*) AS size FROM near GROUP BY cluster",
    "cluster_count": f"WITH {BASE_CTE} SELECT count(DISTINCT cluster) AS n_clusters FROM near",
    "inertia": f"WITH {BASE_CTE} SELECT count(*) AS n_points, round(sum(d), 6) AS inertia FROM near",
    "density_rank": f"WITH {BASE_CTE} SELECT CAST(cluster AS INTEGER) AS cluster, n, "
                    f"round(avg_dist, 6) AS avg_dist, CAST(density_rank AS INTEGER) AS density_rank "
                    f"FROM dens",
    "density_candidates": f"WITH {BASE_CTE} SELECT CAST(cluster AS INTEGER) AS cluster, n, "
                          f"round(avg_dist, 6) AS avg_dist, "
                          f"CAST(density_rank AS INTEGER) AS density_rank FROM cand",
    "farthest_point_peaks": f"WITH {PEAK_CTE} SELECT pick, CAST(cluster AS INTEGER) AS cluster, "
                            f"CAST(density_rank AS INTEGER) AS density_rank, "
                            f"round(min_dist, 6) AS min_dist FROM peaks",
    "nearest_peak": f"WITH {PEAK_CTE} SELECT vec_id, prediction FROM np",
    "lloyd_step": f"""WITH {BASE_CTE},
        nl AS (SELECT cluster, unnest(generate_series(0, len(x) - 1)) AS i, unnest(x) AS v FROM near)
        SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n, CAST(i AS INTEGER) AS dim,
               round(avg(v), 6) AS value FROM nl GROUP BY cluster, i""",
    "lloyd_rounds": f"""WITH {BASE_CTE}, {_lloyd_ctes()}
        SELECT vec_id, CAST(k AS INTEGER) AS prediction FROM a{LLOYD_ROUNDS}""",
    "silhouette": f"WITH {SILHOUETTE_CTE} SELECT round(avg(s), 6) AS silhouette FROM sv",
    "silhouette_by_cluster": f"WITH {SILHOUETTE_CTE} SELECT prediction AS cluster, "
                             f"count(*) AS n, round(avg(s), 6) AS silhouette "
                             f"FROM sv GROUP BY prediction",
    "contingency_metrics": f"""WITH {PEAK_CTE}, {CONTINGENCY_CTE}
        SELECT round(CASE WHEN hu + hv = 0 THEN 1.0 ELSE mi / ((hu + hv) / 2) END, 6) AS nmi,
               round(CASE WHEN (sa + sb) / 2 - expected = 0 THEN 1.0
                     ELSE (suv - expected) / ((sa + sb) / 2 - expected) END, 6) AS ari,
               round(m / n, 6) AS purity FROM agg""",
}
