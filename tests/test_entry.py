"""Driver contract: entry(), queries() and oracle_sql() agree on sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "user" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _norm(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v)
                 else (round(v, 6) if isinstance(v, float) else v) for v in row)


@pytest.mark.parametrize("name", ["user_features", "directory_latest", "parse_timestamps",
                                  "feature_matrix", "farthest_point_peaks", "silhouette",
                                  "contingency_metrics", "string_index", "column_types", "csv_lines",
                                  "features_from_files", "users_sink", "roles_canonical",
                                  "directory_coverage_canonical", "daily_sketches", "method_record",
                                  "kmeans_baseline", "kmeans_sweep", "density_peaks_fixed",
                                  "compare_methods_labelled", "whole_run"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(sdf.columns)
    order = [cols.index(c) for c in sdf.columns]
    got = sorted((_norm(r) for r in sdf.collect()), key=repr)
    want = sorted((_norm(tuple(r[i] for i in order)) for r in res.fetchall()), key=repr)
    assert got == want
