"""The whole analysis (X1 from files, X3) as a composition of operators.

``run_analysis`` takes a per-user feature table and returns the users with
all three predictions plus the metric table; ``run_pipeline`` adds reading
the source directory and writing both sinks.  Nothing is collected except
fitted statistics (centres, label order, per-cluster sums) whose size is set
by k and the number of feature columns, not by the row count.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..defaults import COARSE_K_MAX, K_BASELINE, K_MAX, K_MIN, SEED
from ..functions.grid import with_grid_nearest
from ..operators import features as feat
from ..operators.density import coarse_k, density_peaks
from ..operators.evaluate import evaluate_many, metrics_frame
from ..operators.kmeans import (
    Starts,
    SweepResult,
    fit_from_record,
    fit_input,
    fit_record,
    kmeans,
    kmeans_sweep,
    seeded_starts,
)
from ..operators.prep import LABEL_COLUMNS, find_label_column, prepare
from ..sources import files as src
from ..sources.sinks import write_labelled_users, write_metrics
from .lineage import release
from .manifest import NoRun, Run, input_listing


def build_user_features(spark: SparkSession, data_dir: str, *, form: str = "aggregate",
                        exact_distinct: bool = True) -> DataFrame:
    """Per-user feature table from a directory of source files.

    ``form="aggregate"`` reads all logs in one scan, ``form="joined"`` one log
    at a time.  Falls back to the Parquet files of the directory, returned as
    they are, when there is no logon log.  Raises when no source is found.
    """
    found = src.detect_sources(spark, data_dir)
    logs = [r for r in feat.EVENT_SOURCES if r in found]
    if "logon" not in logs and "parquet" in found:
        return src.load_parquet(spark, *found["parquet"])
    if not logs:
        raise FileNotFoundError(f"no recognisable source file in {data_dir}")
    directory = src.load_directory(spark, found["ldap"]) if "ldap" in found else None
    if form == "aggregate":
        return feat.user_features_from_events(src.load_events(spark, found), directory, sources=logs,
                                              exact_distinct=exact_distinct)
    tables = {r: src.load_log(spark, found[r], r) for r in logs}
    return feat.user_features_joined(tables.get("logon"), tables.get("device"), tables.get("http"), directory,
                                     exact_distinct=exact_distinct)


METHOD_COLUMNS = ("prediction_baseline", "prediction_bestk", "prediction_cdpc")


def run_analysis(features: DataFrame, *, id_col: str = "user", k_baseline: int = K_BASELINE,
                 k_min: int = K_MIN, k_max: int = K_MAX, seed: int = SEED,
                 label_col: str | None = None, partitions: int | None = None, run: Run | NoRun | None = None):
    """Prepare, cluster three ways, evaluate.

    Returns ``(users, metrics, details)``: ``users`` is ``features`` with
    ``prediction_baseline``, ``prediction_bestk`` and ``prediction_cdpc``;
    ``metrics`` has one row per method.  ``run`` records every fit, and fits it
    has on record are not done again; a run time is that of the fit's own run.
    """
    run = run or NoRun()
    spark = features.sparkSession
    label = label_col if label_col is not None else find_label_column(features)
    # a column that already has the name of the prepared vector is set aside
    own = "_own_features"
    rows = features.withColumnRenamed("features", own) if "features" in features.columns else features
    # the ground truth is never a feature
    prepared_df, model = prepare(rows, id_col, exclude=(*LABEL_COLUMNS, *([label] if label else [])))
    keep = [label] if label else []
    n = model.n_rows
    base = fit_input(prepared_df, id_col, "features", partitions, keep, n=n)
    held: list[DataFrame] = [base]
    try:
        def begin() -> dict:
            t0 = time.time()
            found = seeded_starts(base, id_col, "features", seed, max(k_max, k_baseline, COARSE_K_MAX))
            return {**vars(found), "runtime": time.time() - t0}

        def baseline() -> dict:
            t0 = time.time()
            _, res = kmeans(base, k_baseline, id_col=id_col, seed=seed, prepared=base, n=n, starts=starts)
            return {"fit": fit_record(res), "runtime": time.time() - t0}

        def best_k() -> dict:
            t0 = time.time()
            _, res = kmeans_sweep(base, range(k_min, k_max + 1), id_col=id_col, seed=seed, prepared=base, n=n,
                                  fitted={k_baseline: bl}, starts=starts)
            return {"best": fit_record(res.best), "silhouette": res.best_silhouette, "scores": res.scores,
                    "runtime": time.time() - t0}

        def peaks() -> dict:
            t0 = time.time()
            _, info = density_peaks(base, best.k, coarse_k(best.k), id_col=id_col, seed=seed, prepared=base,
                                    n=n, starts=starts)
            if info["bounded"] is not None:
                held.append(info["bounded"])
            return {**{c: v for c, v in info.items() if c not in ("coarse", "bounded")},
                    "coarse": fit_record(info["coarse"]), "runtime": time.time() - t0}

        # the start serves all three methods; its time counts for the first
        begun = run.value("starts", begin)
        starts = Starts(**{k: v for k, v in begun.items() if k != "runtime"})
        one = run.value("baseline", baseline)
        bl = fit_from_record(one["fit"])
        two = run.value("best_k", best_k)
        best = fit_from_record(two["best"])
        sweep = SweepResult(best.k, two["silhouette"], best, [tuple(s) for s in two["scores"]])
        three = run.value("peaks", peaks)
        info = {**{k: v for k, v in three.items() if k != "runtime"}, "coarse": fit_from_record(three["coarse"])}

        # all three labels in one projection over the stored fit input: no joins,
        # and every metric of every method from that one DataFrame
        names = list(METHOD_COLUMNS)
        sets = [bl.grid_centres, best.grid_centres, info["grid_peaks"]]
        labelled = with_grid_nearest(base.select(id_col, "features", *keep), sets, starts.scale,
                                     "features", names)
        records = evaluate_many(labelled, [
            {"name": "KMeans-Baseline", "pred": names[0], "runtime": begun["runtime"] + one["runtime"],
             "inertia": bl.cost},
            {"name": f"KMeans-BestK(k={best.k})", "pred": names[1], "runtime": two["runtime"],
             "inertia": best.cost},
            {"name": "CDPC-KNN-Approx", "pred": names[2], "runtime": three["runtime"],
             "centres": info["peak_centres"]},
        ], label_col=label, dim=len(model.mean))
        # one projection over the copy that preparation stored: no join, so every
        # input row comes out once, repeated and null ids included
        users = (with_grid_nearest(prepared_df, sets, starts.scale, "features", names)
                 .drop("features").withColumnRenamed(own, "features"))
        details = {"model": model, "baseline": bl, "sweep": sweep, "cdpc": info,
                   "label_col": label}
        return users, metrics_frame(spark, records), details
    finally:
        for df in held:
            release(df)


def run_pipeline(spark: SparkSession, data_dir: str, output_dir: str, *,
                 k_baseline: int = K_BASELINE, k_min: int = K_MIN, k_max: int = K_MAX,
                 seed: int = SEED, partitions: int | None = None, work_dir: str | None = None):
    """Read the sources, run the analysis, write labelled users and metrics.

    Stages are recorded below ``work_dir`` (default: beside the output): a
    repeated call with the same input and parameters goes on after the last
    stage that finished.  Both outputs are verified before they are published.
    """
    found = src.detect_sources(spark, data_dir)
    if not found:
        raise FileNotFoundError(f"no recognisable source file in {data_dir}")
    parameters = {"k_baseline": k_baseline, "k_min": k_min, "k_max": k_max, "seed": seed}
    run = Run(spark, work_dir or f"{output_dir.rstrip('/')}/_run",
              input_listing(spark, [p for paths in found.values() for p in paths]), parameters)
    features = run.table("features", lambda: build_user_features(spark, data_dir))
    users, metrics, details = run_analysis(features, partitions=partitions, run=run, **parameters)
    run.value("users", lambda: {"rows": write_labelled_users(users, f"{output_dir}/clustered_users")})
    run.value("metrics", lambda: {"rows": write_metrics(metrics, f"{output_dir}/metrics")})
    return users, metrics, details
