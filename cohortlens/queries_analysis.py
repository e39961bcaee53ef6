"""Registered queries for feature preparation and the three clustering methods.

All have SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .defaults import K_BASELINE, K_MAX, K_MIN
from .operators import features as feat
from .operators import prep
from .operators.density import coarse_k, density_peaks
from .operators.kmeans import fit_input, kmeans, kmeans_sweep, seeded_starts
from .plans.analysis import run_analysis, run_pipeline
from .plans.lineage import release, shared_path
from .queries_fits import TRUTH_SQL, fit_oracles
from .sources import tables as tb
from .sources.sinks import read_labelled_users, read_metrics, write_metrics


def rounded(df: DataFrame) -> DataFrame:
    from .queries import rounded as r
    return r(df)


def _features(spark, sf_dir, fill=True):
    from .queries import _features as f
    return f(spark, sf_dir, feat.user_features, fill=fill)


def q_string_cardinality(spark, sf_dir):
    return prep.string_cardinality(tb.table(spark, sf_dir, "events"))


def q_column_types(spark, sf_dir):
    return prep.column_types(tb.table(spark, sf_dir, "customer"), id_col="c_custkey")


def q_impute_mean(spark, sf_dir):
    raw = _features(spark, sf_dir, fill=False)
    nums = [c for c in raw.columns if c not in ("user", "role")]
    model = prep.fit_features(raw, nums, [])
    return rounded(raw.select("user", *[model.imputed(c).alias(f"{c}_imp") for c in nums]))


def _role_model(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f, prep.fit_features(f, [], ["role"])


def q_string_index(spark, sf_dir):
    f, model = _role_model(spark, sf_dir)
    return f.select("user", "role", model.index("role").alias("role_idx"))


def q_one_hot(spark, sf_dir):
    f, model = _role_model(spark, sf_dir)
    size = len(model.labels["role"]) + 1
    idx = model.index("role")
    ohe = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                                   lambda j: F.when(j == idx, "1.0").otherwise("0.0")), ",")
    return f.select("user", ohe.alias("role_ohe"))


def q_feature_matrix(spark, sf_dir):
    out, _ = prep.prepare(_features(spark, sf_dir), "user")
    return rounded(out.select("user", F.posexplode("features").alias("dim", "value")))


def _prepared(spark, sf_dir):
    out, model = prep.prepare(_features(spark, sf_dir), "user")
    return fit_input(out, "user", n=model.n_rows)


def q_kmeans_baseline(spark, sf_dir):
    base = _prepared(spark, sf_dir)
    labelled, _ = kmeans(base, K_BASELINE, id_col="user", prepared=base)
    return labelled.select("user", "prediction")


def q_kmeans_sweep(spark, sf_dir):
    base = _prepared(spark, sf_dir)
    _, res = kmeans_sweep(base, range(K_MIN, K_MAX + 1), id_col="user", prepared=base)
    release(base)  # the result below is the small score table
    return rounded(spark.createDataFrame(
        [(k, s, c, k == res.best_k) for k, s, c in res.scores],
        "k int, silhouette double, inertia double, chosen boolean"))


def q_density_peaks(spark, sf_dir):
    """Density peaks with the number of peaks that the silhouette sweep chooses."""
    base = _prepared(spark, sf_dir)
    starts = seeded_starts(base)
    _, res = kmeans_sweep(base, range(K_MIN, K_MAX + 1), id_col="user", prepared=base, starts=starts)
    labelled, _ = density_peaks(base, res.best_k, coarse_k(res.best_k), id_col="user",
                                prepared=base, starts=starts)
    return labelled.select("user", "prediction")


def q_density_peaks_fixed(spark, sf_dir):
    """Density peaks with a given number of peaks, no sweep before it."""
    base = _prepared(spark, sf_dir)
    labelled, _ = density_peaks(base, K_BASELINE, id_col="user", prepared=base)
    return labelled.select("user", "prediction")


def method_records(spark, sf_dir):
    """The comparison table of the three methods, run times included."""
    _, metrics, _ = run_analysis(_features(spark, sf_dir))
    return metrics


def sizes_as_text(metrics: DataFrame) -> DataFrame:
    """Metric records without run times, the map of sizes as ``cluster:size`` by cluster."""
    pairs = F.transform(F.map_entries("cluster_sizes"), lambda e: F.struct(
        e["key"].cast("int").alias("c"), e["value"].cast("string").alias("n")))
    text = F.array_join(F.transform(F.array_sort(pairs), lambda e: F.concat_ws(
        ":", e["c"].cast("string"), e["n"])), ",")
    return metrics.drop("runtime_s").withColumn("cluster_sizes", text)


def q_compare_methods(spark, sf_dir):
    return sizes_as_text(method_records(spark, sf_dir))


def q_compare_methods_labelled(spark, sf_dir):
    """The comparison against a ground truth, whose column the analysis finds by its name."""
    users = _features(spark, sf_dir).withColumn("insider", F.expr(TRUTH_SQL))
    _, metrics, _ = run_analysis(users)
    return sizes_as_text(metrics)


def q_metrics_sink(spark, sf_dir):
    """The comparison table through the verified JSON-array sink."""
    metrics = method_records(spark, sf_dir)
    path = shared_path(spark, "metrics")
    write_metrics(metrics, path, form="array")
    return sizes_as_text(read_metrics(spark, path, metrics.schema))


def q_whole_run(spark, sf_dir):
    """From CSV sources to the labelled users that the whole run publishes."""
    from .queries import source_folder

    out = shared_path(spark, "run")
    users, _, _ = run_pipeline(spark, source_folder(spark, sf_dir), out)
    return rounded(read_labelled_users(spark, f"{out}/clustered_users", users.schema))


def q_attach_predictions(spark, sf_dir):
    users, _, _ = run_analysis(_features(spark, sf_dir))
    return rounded(users)


QUERIES = {
    "string_cardinality": q_string_cardinality,
    "column_types": q_column_types,
    "impute_mean": q_impute_mean,
    "string_index": q_string_index,
    "one_hot": q_one_hot,
    "feature_matrix": q_feature_matrix,
    "kmeans_baseline": q_kmeans_baseline,
    "kmeans_sweep": q_kmeans_sweep,
    "density_peaks": q_density_peaks,
    "density_peaks_fixed": q_density_peaks_fixed,
    "compare_methods": q_compare_methods,
    "compare_methods_labelled": q_compare_methods_labelled,
    "metrics_sink": q_metrics_sink,
    "whole_run": q_whole_run,
    "attach_predictions": q_attach_predictions,
}


# --- DuckDB side ------------------------------------------------------------------

def _oracle():
    from .queries import FEATURES_CTE, FEATURES_RAW_CTE, _FEATURE_NUMS

    nums = _FEATURE_NUMS
    role_order = """lab AS (SELECT role, count(*) AS cnt FROM features WHERE role IS NOT NULL GROUP BY role),
ord AS (SELECT role, CAST(row_number() OVER (ORDER BY cnt DESC, role) - 1 AS INTEGER) AS slot FROM lab),
nl AS (SELECT CAST(count(*) AS INTEGER) AS nl FROM lab),
enc AS (SELECT f."user", f.role, coalesce(ord.slot, nl.nl) AS slot
  FROM features f LEFT JOIN ord ON f.role = ord.role CROSS JOIN nl)"""
    imp = ", ".join(f"coalesce(CAST({c} AS DOUBLE), avg(CAST({c} AS DOUBLE)) OVER ()) AS {c}"
                    for c in nums)
    nst = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(nums))
    num = " UNION ALL ".join(
        f"SELECT \"user\", {i} AS dim, CASE WHEN coalesce(s{i}, 0) = 0 THEN 0.0 "
        f"ELSE ({c} - m{i}) / s{i} END AS value FROM imp, nst" for i, c in enumerate(nums))
    d0 = len(nums)
    matrix_ctes = f"""{role_order},
            imp AS (SELECT "user", {imp} FROM features),
            nst AS (SELECT {nst} FROM imp),
            num AS ({num}),
            slots AS (SELECT unnest(generate_series(0, nl)) AS j FROM nl),
            oh AS (SELECT enc."user", slots.j, CASE WHEN enc.slot = slots.j THEN 1.0 ELSE 0.0 END AS x
              FROM enc CROSS JOIN slots),
            ohs AS (SELECT j, avg(x) AS m, stddev_samp(x) AS s FROM oh GROUP BY j),
            cat AS (SELECT oh."user", {d0} + oh.j AS dim,
                CASE WHEN coalesce(s, 0) = 0 THEN 0.0 ELSE (x - m) / s END AS value
              FROM oh JOIN ohs USING (j))"""
    matrix = """SELECT "user", CAST(dim AS INTEGER) AS dim, value
              FROM (SELECT * FROM num UNION ALL SELECT * FROM cat)"""
    shown = ", ".join(f'round(f.{c}, 6) AS {c}' if c in ("logon_avg_hour", "logon_hour_std") else f'f."{c}"'
                      for c in ["user", *nums, "role"])
    fits = fit_oracles(f"{FEATURES_CTE}, {matrix_ctes}", matrix, shown)
    return {
        **fits,
        "metrics_sink": fits["compare_methods"],
        "whole_run": fits["attach_predictions"],
        "string_cardinality": """SELECT 'event_type' AS "column",
              count(DISTINCT event_type) + CAST(max(event_type IS NULL) AS BIGINT) AS n_values
            FROM events
            UNION ALL
            SELECT 'props', count(DISTINCT props) + CAST(max(props IS NULL) AS BIGINT) FROM events""",
        "column_types": """SELECT 'c_nationkey' AS "column", 'numerical' AS kind
            UNION ALL SELECT 'c_acctbal', 'numerical'
            UNION ALL SELECT 'c_name', CASE WHEN count(DISTINCT c_name)
                + CAST(max(c_name IS NULL) AS BIGINT) <= 50 THEN 'categorical' ELSE 'dropped' END
              FROM customer
            UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment)
                + CAST(max(c_mktsegment IS NULL) AS BIGINT) <= 50 THEN 'categorical' ELSE 'dropped' END
              FROM customer""",
        "impute_mean": f"WITH {FEATURES_RAW_CTE} SELECT \"user\", " + ", ".join(
            f"round(coalesce(CAST({c} AS DOUBLE), avg(CAST({c} AS DOUBLE)) OVER ()), 6) AS {c}_imp"
            for c in nums) + " FROM features_raw",
        "string_index": f"WITH {FEATURES_CTE}, {role_order} "
                        f"SELECT \"user\", role, slot AS role_idx FROM enc",
        "one_hot": f"""WITH {FEATURES_CTE}, {role_order}
            SELECT "user", array_to_string(list_transform(range(0, nl + 1),
                lambda j: CASE WHEN j = slot THEN '1.0' ELSE '0.0' END), ',') AS role_ohe
            FROM enc CROSS JOIN nl""",
        "feature_matrix": f"""WITH {FEATURES_CTE}, {matrix_ctes}
            SELECT "user", dim, round(value, 6) AS value FROM ({matrix})""",
    }


ORACLE = _oracle()
