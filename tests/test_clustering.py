"""Clustering and metrics: properties, equivalence to MLlib, brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.operators import density as dn
from cohortlens.operators import geometry as geo
from cohortlens.operators import metrics as mt
from cohortlens.operators.kmeans import fit_all, fit_input, kmeans, kmeans_sweep, seeded_starts

RNG = np.random.default_rng(7)
CENTRES = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 5]], dtype=float)


def blobs(spark, per=40, extra=()):
    rows = []
    i = 0
    for lab, c in enumerate(CENTRES):
        for _ in range(per):
            rows.append((f"P{i:04d}", [float(v) for v in c + RNG.normal(0, 0.5, 3)], lab))
            i += 1
    for p in extra:
        rows.append((f"P{i:04d}", [float(v) for v in p], 9))
        i += 1
    return spark.createDataFrame(rows, "user string, features array<double>, label int")


def _silhouette_brute(x, lab):
    n = len(x)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(n):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == k].mean() for k in set(lab) if k != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_equals_mllib_and_brute_force(spark):
    df = blobs(spark, per=15)
    df = df.withColumn("prediction", F.when(F.col("label") == 2, 1).otherwise(F.col("label")))
    mine = mt.silhouette(df, "prediction").first()[0]
    ev = ClusteringEvaluator(featuresCol="v", predictionCol="prediction",
                             distanceMeasure="squaredEuclidean")
    theirs = ev.evaluate(df.withColumn("v", array_to_vector("features")))
    rows = df.collect()
    brute = _silhouette_brute(np.array([r["features"] for r in rows]),
                              np.array([r["prediction"] for r in rows]))
    assert abs(mine - theirs) < 1e-9 and abs(mine - brute) < 1e-9
    many = mt.silhouette_many(df, [CENTRES.tolist(), CENTRES[:2].tolist()])
    assert -1 <= many[0] <= 1 and -1 <= many[1] <= 1


def test_single_cluster_sentinel(spark):
    df = blobs(spark, per=5).withColumn("prediction", F.lit(0))
    assert mt.silhouette(df, "prediction").first()[0] == -1.0


def test_external_scores_properties(spark):
    df = blobs(spark, per=10)
    same = mt.external_scores(df.withColumn("p", F.col("label")), "label", "p").first()
    assert same["nmi"] == pytest.approx(1.0) and same["ari"] == pytest.approx(1.0)
    assert same["purity"] == pytest.approx(1.0)
    renamed = mt.external_scores(df.withColumn("p", 7 - F.col("label")), "label", "p").first()
    assert renamed["nmi"] == pytest.approx(1.0) and renamed["ari"] == pytest.approx(1.0)
    mixed = df.withColumn("p", (F.col("label") + F.substring("user", 5, 1).cast("int")) % 2)
    got = mt.external_scores(mixed, "label", "p").first()
    rows = mixed.select("label", "p").collect()
    u = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows])
    # brute-force pair counting for ARI
    pairs = list(itertools.combinations(range(len(u)), 2))
    a = sum(1 for i, j in pairs if u[i] == u[j] and v[i] == v[j])
    same_u = sum(1 for i, j in pairs if u[i] == u[j])
    same_v = sum(1 for i, j in pairs if v[i] == v[j])
    expected = same_u * same_v / len(pairs)
    ari = (a - expected) / ((same_u + same_v) / 2 - expected)
    assert got["ari"] == pytest.approx(ari, abs=1e-12)
    purity = sum(max((v == c)[u == k].sum() for k in set(u)) for c in set(v)) / len(u)
    assert got["purity"] == pytest.approx(
        sum(max(((u == k) & (v == c)).sum() for k in set(u)) for c in set(v)) / len(u))
    assert 0 <= got["nmi"] <= 1 and purity <= 1


def test_kmeans_recovers_blobs_and_sweep_picks_k(spark):
    df = blobs(spark)
    base = fit_input(df, "user", keep=["label"])
    labelled, res = kmeans(base, 3, prepared=base)
    assert len(res.centres) == 3
    ext = mt.external_scores(labelled, "label", "prediction").first()
    assert ext["ari"] == pytest.approx(1.0)
    # every point sits at its nearest centre; inertia equals the sum of own distances
    inertia = geo.sse(labelled, res.centres, "prediction").first()["inertia"]
    assert inertia == pytest.approx(res.cost, rel=1e-6)
    _, sweep = kmeans_sweep(base, range(2, 7), prepared=base)
    assert sweep.best_k == 3
    assert sweep.best_silhouette == max(s for _, s, _ in sweep.scores)
    _, again = kmeans_sweep(base, range(2, 7), prepared=base, fitted={3: res})
    assert again.scores == sweep.scores


def test_fits_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(
        [(f"u{i % 700}" if i else None, [float(v) for v in RNG.normal(i % 4, 1.0, 6)]) for i in range(900)],
        "user string, features array<double>")
    df = df.union(df.limit(50)).union(spark.createDataFrame([("gap", None)], df.schema)).cache()
    fits = []
    for parts in (1, 8, 64):
        base = fit_input(df, "user", partitions=parts)
        starts = seeded_starts(base)
        fits.append((starts.centres, {k: (f.grid_centres, f.cost, f.iterations)
                                      for k, f in fit_all(base, [2, 5, 9], starts, max_iter=5).items()}))
        base.unpersist()
    assert fits[0] == fits[1] == fits[2]


def test_lloyd_passes_equal_numpy(spark):
    df = blobs(spark, per=30)
    starts = seeded_starts(df)
    got = fit_all(df, [3, 6], starts)
    x = np.floor(np.array([r["features"] for r in df.collect()]) * starts.scale + 0.5).astype(np.int64)
    for k in (3, 6):
        centres = np.array(starts.centres[:k])
        for _ in range(50):
            own = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            fresh = np.array([(2 * x[own == c].sum(0) + (own == c).sum()) // (2 * (own == c).sum())
                              if (own == c).any() else centres[c] for c in range(k)])
            if (fresh == centres).all():
                break
            centres = fresh
        assert got[k].grid_centres == centres.tolist()
        cost = ((x - centres[own]) ** 2).sum()
        assert got[k].cost == float(cost) / starts.scale ** 2


def test_one_job_per_iteration_for_all_k(spark):
    base = fit_input(blobs(spark), "user")
    starts = seeded_starts(base)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("all-k", "fits")
    fits = fit_all(base, range(2, 11), starts)
    jobs = len(tracker.getJobIdsForGroup("all-k"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs <= max(f.iterations for f in fits.values()) + 1


@pytest.mark.parametrize("parts", [1, 8])
def test_bounds_change_no_label_and_save_comparisons(spark, parts):
    df = spark.createDataFrame(
        [(f"u{i}", [float(v) for v in RNG.normal((i % 5) * 3.0, 1.0, 4)]) for i in range(600)]
        + [("gap", None)], "user string, features array<double>")
    base = fit_input(df, "user", partitions=parts)
    starts = seeded_starts(base)
    plain, a = dn.density_peaks(base, 4, 25, prepared=base, starts=starts, bounds=False, max_iter=8)
    kept, b = dn.density_peaks(base, 4, 25, prepared=base, starts=starts, max_iter=8)
    assert a["coarse"].grid_centres == b["coarse"].grid_centres and a["peak_clusters"] == b["peak_clusters"]
    assert a["coarse"].cost == b["coarse"].cost and a["coarse"].iterations == b["coarse"].iterations
    assert (sorted(map(str, kept.select(*plain.columns).collect())) == sorted(map(str, plain.collect())))
    compared = b["coarse"].compared
    assert compared[0] == 600 and sum(compared) < 0.7 * 600 * len(compared)


def test_equal_rows_and_few_distinct_ones(spark):
    df = spark.createDataFrame([(f"u{i}", [float(i % 2), 1.0]) for i in range(12)],
                               "user string, features array<double>")
    _, res = kmeans(df, 3)
    assert sorted(res.centres) == [[0.0, 1.0], [1.0, 1.0]] and res.cost == 0.0
    big = spark.createDataFrame([("a", [1e30, 0.0]), ("b", [-1e30, 1.0]), ("c", [0.0, 5.0])],
                                "user string, features array<double>")
    assert kmeans(big, 2)[0].count() == 3
    with pytest.raises(Exception, match="finite"):
        kmeans(spark.createDataFrame([("a", [float("nan")]), ("b", [1.0]), ("c", [2.0])],
                                     "user string, features array<double>"), 2)


def test_k_checks(spark):
    df = blobs(spark, per=2)
    with pytest.raises(ValueError):
        kmeans(df, 1)
    with pytest.raises(ValueError):
        kmeans(df, 7)
    _, sweep = kmeans_sweep(df, range(2, 11))
    assert max(k for k, _, _ in sweep.scores) == 6             # clamped to n


def test_density_peaks_match_numpy(spark):
    """C8 re-done in numpy from the same coarse centres gives the same labels."""
    df = blobs(spark)
    labelled, info = dn.density_peaks(df, 3, 20)
    rows = labelled.orderBy("user").collect()
    x = np.array([r["features"] for r in rows])
    coarse = np.array(info["coarse"].grid_centres, dtype=float)
    x = np.floor(x * info["coarse"].scale + 0.5)
    d_all = ((x[:, None, :] - coarse[None, :, :]) ** 2).sum(-1)
    own = d_all.argmin(1)
    dist = d_all[np.arange(len(x)), own]
    used = sorted(set(own))
    dens = sorted(used, key=lambda c: (dist[own == c].mean(), c))
    cand = dens[:max(3, len(dens) // 2)]
    chosen = [cand[0]]
    while len(chosen) < 3 and len(chosen) < len(cand):
        best, best_d = None, -1.0
        for c in cand:
            if c in chosen:
                continue
            dd = min(((coarse[c] - coarse[j]) ** 2).sum() for j in chosen)
            if dd > best_d:
                best, best_d = c, dd
        chosen.append(best)
    assert info["peak_clusters"] == chosen
    peaks = coarse[chosen]
    expect = ((x[:, None, :] - peaks[None, :, :]) ** 2).sum(-1).argmin(1)
    assert [r["prediction"] for r in rows] == list(expect)
    assert info["n_peaks"] == 3 and info["k_coarse"] == 20


def test_farthest_point_matches_greedy(spark):
    pts = RNG.normal(0, 1, (12, 4))
    avg = RNG.uniform(0, 1, 12)
    cand = spark.createDataFrame(
        [(i, float(avg[i]), [float(v) for v in pts[i]]) for i in range(12)],
        "cluster int, avg_dist double, centre array<double>")
    ranked = cand.withColumn("density_rank",
                             F.row_number().over(__import__("pyspark.sql").sql.Window
                                                 .orderBy("avg_dist", "cluster")))
    got = dn.farthest_point_peaks(ranked, 5).orderBy("pick").collect()
    order = list(np.argsort(avg, kind="stable"))
    chosen = [order[0]]
    while len(chosen) < 5:
        best, best_d = None, -1.0
        for i in order:
            if i in chosen:
                continue
            d = min(((pts[i] - pts[j]) ** 2).sum() for j in chosen)
            if d > best_d:
                best, best_d = i, d
        chosen.append(best)
    assert [r["cluster"] for r in got] == chosen
    dists = [r["min_dist"] for r in got][1:]
    assert all(a >= b for a, b in zip(dists, dists[1:]))      # round distances never rise


def test_candidates_run_out(spark):
    cand = spark.createDataFrame([(0, 0.1, [0.0, 0.0], 1), (1, 0.2, [1.0, 1.0], 2)],
                                 "cluster int, avg_dist double, centre array<double>, "
                                 "density_rank int")
    assert dn.farthest_point_peaks(cand, 4).count() == 2


def test_lloyd_step_does_not_raise_sse(spark):
    df = blobs(spark)
    start = [[1.0, 1.0, 1.0], [8.0, 1.0, 0.0], [1.0, 8.0, 4.0]]
    before = geo.sse(geo.assign_nearest(df, start, "features", "c"), start, "c").first()[1]
    new = geo.lloyd_step(df, start).orderBy("cluster").collect()
    centres = [list(r["centre"]) for r in new]
    after = geo.sse(geo.assign_nearest(df, centres, "features", "c"), centres, "c").first()[1]
    assert after <= before and len(centres) == 3


def test_nearest_ties_go_to_lower_index(spark):
    df = spark.createDataFrame([([0.5, 0.0],)], "features array<double>")
    got = geo.assign_nearest(df, [[0.0, 0.0], [1.0, 0.0]], "features", "p").first()["p"]
    assert got == 0


def test_matrix_literal_bound():
    from cohortlens.functions import vectors
    with pytest.raises(ValueError):
        vectors.matrix_literal([[0.0] * 1000] * (vectors.MAX_LITERAL_DOUBLES // 1000 + 1))
    assert math.isfinite(1.0)


def test_min_cluster_size_drops_lone_outlier(spark):
    pts = spark.createDataFrame(
        [(0, 0.5), (0, 0.7), (1, 0.0), (2, 0.2), (2, 0.4)], "cluster int, dist double")
    plain = {r["cluster"]: r["density_rank"] for r in dn.density_rank(pts).collect()}
    assert plain[1] == 1                                   # the singleton ranks densest
    guarded = {r["cluster"]: r["density_rank"]
               for r in dn.density_rank(pts, min_cluster_size=2).collect()}
    assert 1 not in guarded and guarded[2] == 1


from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4)), min_size=3, max_size=40))
def test_external_scores_match_definitions(spark, pairs):
    df = spark.createDataFrame(pairs, "label int, p int")
    got = mt.external_scores(df, "label", "p").first()
    u = np.array([a for a, _ in pairs])
    v = np.array([b for _, b in pairs])
    n = len(u)
    cont = {}
    for a, b in pairs:
        cont[(a, b)] = cont.get((a, b), 0) + 1
    au = {a: (u == a).sum() for a in set(u)}
    bv = {b: (v == b).sum() for b in set(v)}
    mi = sum(c / n * math.log(n * c / (au[a] * bv[b])) for (a, b), c in cont.items())
    hu = -sum(x / n * math.log(x / n) for x in au.values())
    hv = -sum(x / n * math.log(x / n) for x in bv.values())
    nmi = 1.0 if hu + hv == 0 else mi / ((hu + hv) / 2)
    assert got["nmi"] == pytest.approx(nmi, abs=1e-9)
    c2 = lambda x: x * (x - 1) / 2
    suv, sa, sb = (sum(c2(c) for c in cont.values()), sum(c2(x) for x in au.values()),
                   sum(c2(x) for x in bv.values()))
    exp = sa * sb / c2(n)
    den = (sa + sb) / 2 - exp
    ari = 1.0 if den == 0 else (suv - exp) / den
    assert got["ari"] == pytest.approx(ari, abs=1e-9)
    purity = sum(max(c for (a, b), c in cont.items() if b == bb) for bb in bv) / n
    assert got["purity"] == pytest.approx(purity, abs=1e-12)


def test_jvm_expression_and_kernel_agree(spark):
    """The higher-order-function assignment equals the vectorised kernel."""
    from cohortlens.functions.vectors import matrix_literal, nearest_index
    df = blobs(spark, per=20)
    cents = [[1.0, 1.0, 1.0], [9.0, 0.0, 0.0], [0.0, 9.0, 4.0], [5.0, 5.0, 2.0]]
    jvm = df.select("user", nearest_index("features", matrix_literal(cents), 4).alias("n"))
    a = {r["user"]: (r["n"]["idx"], r["n"]["dist"]) for r in jvm.collect()}
    b = {r["user"]: (r["p"], r["d"])
         for r in geo.assign_nearest(df, cents, "features", "p", "d").collect()}
    assert a.keys() == b.keys()
    for u in a:
        assert a[u][0] == b[u][0] and a[u][1] == pytest.approx(b[u][1], rel=1e-12)


def test_cluster_size_map(spark):
    df = blobs(spark, per=7).withColumn("prediction", F.col("label"))
    row = mt.cluster_size_map(df).first()
    assert row["cluster_sizes"] == {0: 7, 1: 7, 2: 7} and row["n_clusters"] == 3


def test_evaluate_many_equals_single(spark):
    from cohortlens.operators.evaluate import evaluate, evaluate_many
    df = blobs(spark, per=12)
    c2 = [[0.0, 0.0, 0.0], [5.0, 5.0, 2.0]]
    c3 = CENTRES.tolist()
    both = geo.assign_nearest(geo.assign_nearest(df, c2, "features", "p2"), c3, "features", "p3")
    many = evaluate_many(both, [{"name": "two", "pred": "p2", "centres": c2},
                                {"name": "three", "pred": "p3", "centres": c3}], label_col="label")
    for rec, pred, cents in zip(many, ("p2", "p3"), (c2, c3)):
        cost = geo.sse(both, cents, pred).first()["inertia"]
        single = evaluate(both, rec["method"], prediction_col=pred, label_col="label", inertia=cost)
        for k in ("n_clusters", "silhouette", "inertia", "within_ss", "cluster_sizes",
                  "nmi", "ari", "purity"):
            assert rec[k] == pytest.approx(single[k]) if isinstance(rec[k], float) \
                else rec[k] == single[k], k


def test_kernel_matrix_skips_null_rows_and_refuses_short_ones():
    import pyarrow as pa
    from cohortlens.functions.kernels import _matrix
    arr = pa.array([[1.0, 2.0], None, [4.0, 5.0], None, [7.0, 8.0]], type=pa.list_(pa.float64()))
    for a in (arr, arr.slice(1)):
        x, valid = _matrix(a, 2)
        assert x.tolist() == [r for r in a.to_pylist() if r is not None]
        assert valid.tolist() == [r is not None for r in a.to_pylist()]
    with pytest.raises(ValueError, match="length"):
        _matrix(pa.array([[1.0, 2.0], [3.0]], type=pa.list_(pa.float64())), 2)
