"""Sources that lose nothing, and the edge cases of preparation and metrics."""

import os

import pytest

from cohortlens.functions.predicates import header_row
from cohortlens.operators import prep
from cohortlens.operators.evaluate import evaluate
from cohortlens.operators.kmeans import fit_input
from cohortlens.operators.metrics import external_scores, silhouette
from cohortlens.plans.analysis import run_analysis
from cohortlens.sources import files, tables as tb

from conftest import SF, SF01


@pytest.mark.parametrize("sf", [SF, SF01])
def test_every_event_is_in_one_log(spark, sf):
    logs = {k: v.count() for k, v in tb.activity_logs(spark, sf).items()}
    total = tb.table(spark, sf, "events").count()
    assert sum(logs.values()) == total == tb.activity_events(spark, sf).count()
    users = {k: {r[0] for r in v.select("user").distinct().collect()}
             for k, v in tb.activity_logs(spark, sf).items()}
    everyone = set().union(*users.values())
    assert users["device"] != everyone and users["http"] != everyone


def test_header_needs_every_cell(spark):
    df = spark.createDataFrame([("id", "date", "user"), (" Date", "USER ", "Id"), ("L1", "d", "ID"),
                                (None, "date", "id")], "id string, date string, user string")
    kept = df.where(~header_row(df.columns, "id")).collect()
    assert [tuple(r) for r in kept] == [("L1", "d", "ID"), (None, "date", "id")]


def test_parquet_keeps_partition_columns_and_leaves_nested_tables(spark, tmpdir_fresh):
    df = spark.createDataFrame([("U1", 1, "a"), ("U2", 2, "b")], "user string, v int, dt string")
    df.write.partitionBy("dt").parquet(os.path.join(tmpdir_fresh, "users.parquet"))
    df.write.parquet(os.path.join(tmpdir_fresh, "deeper", "other.parquet"))
    found = files.detect_sources(spark, tmpdir_fresh)
    back = files.load_parquet(spark, *found["parquet"])
    assert sorted(back.columns) == ["dt", "user", "v"] and back.count() == 2


def test_latest_snapshot_ignores_case():
    paths = ["/d/ldap2009-12.csv", "/d/LDAP2011-05.csv"]
    assert files.latest_snapshot_paths(paths) == ["/d/LDAP2011-05.csv"]


def test_analysis_keeps_rows_and_hides_the_label(spark):
    rows = [(f"u{i % 30}" if i else None, float(i % 7), float(i % 3), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "user string, a double, b double, is_threat int")
    users, _, details = run_analysis(df, label_col="is_threat", k_max=3)
    assert users.count() == 60
    assert users.where("prediction_cdpc is null").count() == 0
    assert "is_threat" not in details["model"].numerical
    assert "Join" not in users._jdf.queryExecution().executedPlan().toString()


def test_fit_layout_depends_on_ids_alone(spark):
    base = spark.range(120_000).selectExpr("cast(id as string) as user",
                                           "array(id * 1.0D, id % 7 * 1.0D) as features")

    def layout(df):
        stored = fit_input(df, "user")
        sizes = stored.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
        stored.unpersist()
        return sizes

    assert layout(base.repartition(3)) == layout(base.repartition(11))
    assert len(layout(base)) > 1


def test_external_scores_of_small_inputs(spark):
    one = spark.createDataFrame([("x", 0)], "l string, p int")
    assert tuple(external_scores(one, "l", "p").first()) == (1.0, 1.0, 1.0)
    same = spark.range(1163).selectExpr("'x' as l", "0 as p")
    assert external_scores(same, "l", "p").first()["nmi"] == 1.0


def test_null_predictions_and_labels(spark):
    df = spark.createDataFrame([([0.0, 0.0], 0, None), ([0.1, 0.0], 0, None), ([5.0, 5.0], 1, None),
                                ([5.1, 5.0], 1, None), ([9.0, 9.0], None, None)],
                               "features array<double>, prediction int, label string")
    assert silhouette(df).first()[0] > 0.9
    rec = evaluate(df, "m", label_col="label")
    assert rec["cluster_sizes"] == {0: 2, 1: 2} and rec["nmi"] is None


def test_wrong_length_and_infinity_are_errors(spark):
    bad = spark.createDataFrame([([0.0, 1.0], 0), ([0.0], 0)], "features array<double>, prediction int")
    from cohortlens.operators.geometry import assign_nearest
    with pytest.raises(Exception, match="expected length"):
        assign_nearest(bad.select("features"), [[0.0, 0.0], [1.0, 1.0]]).collect()
    inf = spark.createDataFrame([("a", float("inf")), ("b", 1.0)], "user string, x double")
    with pytest.raises(ValueError, match="'x'"):
        prep.prepare(inf, "user")


def test_parse_lines_keeps_malformed_lines(spark):
    lines = spark.createDataFrame([("id,date,user,pc,url",), ('1,d,u,p,"http://a,b"',), ("2,d,u,p",),
                                   ("3,d,u,p,x,more",), ("",), (None,), (" ID ,Date,user,PC,Url",)], "line string")
    got = {r["id"]: (r["url"], r["malformed"])
           for r in files.parse_lines(lines, "http").where("id is not null").collect()}
    assert got == {"1": ("http://a,b", False), "2": (None, True), "3": ("x", True)}
    assert files.parse_lines(lines, "http").where("id is null and malformed").count() == 2


def test_lloyd_keeps_a_centre_without_points(spark):
    from cohortlens.operators.geometry import lloyd
    df = spark.createDataFrame([([0.0],), ([2.0],), ([10.0],)], "features array<double>")
    labelled, centres = lloyd(df, [[0.0], [9.0], [500.0]], 3)
    assert centres == [[1.0], [10.0], [500.0]]
    assert sorted((r[0][0], r[1]) for r in labelled.collect()) == [(0.0, 0), (2.0, 0), (10.0, 1)]
