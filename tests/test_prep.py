"""Feature preparation: column roles, imputation, encoding, scaling vs MLlib."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators import prep


def _mllib(df, num, cat):
    dd = df
    for c in num:
        dd = dd.withColumn(c, F.col(c).cast("double"))
    stages = [Imputer(inputCols=num, outputCols=[c + "_imp" for c in num], strategy="mean")]
    for c in cat:
        stages += [StringIndexer(inputCol=c, outputCol=c + "_idx", handleInvalid="keep"),
                   OneHotEncoder(inputCols=[c + "_idx"], outputCols=[c + "_ohe"],
                                 handleInvalid="keep")]
    stages += [VectorAssembler(inputCols=[c + "_imp" for c in num] + [c + "_ohe" for c in cat],
                               outputCol="raw", handleInvalid="keep"),
               StandardScaler(inputCol="raw", outputCol="f", withMean=True, withStd=True)]
    out = Pipeline(stages=stages).fit(dd).transform(dd)
    return {r[0]: np.array(r[1]) for r in out.select("user", vector_to_array("f")).collect()}


def _table(spark):
    rows = []
    for i in range(30):
        rows.append((f"U{i}", i % 7 if i % 5 else None, float(i * i) if i != 3 else None,
                     ["a", "b", "c"][i % 3] if i % 4 else None, 5.0, ["x", "y"][i % 2]))
    return spark.createDataFrame(
        rows, "user string, n int, v double, grp string, const double, tie string")


def test_matches_mllib_pipeline(spark):
    df = _table(spark)
    out, model = prep.prepare(df, "user")
    assert model.numerical == ["n", "v", "const"] and model.categorical == ["grp", "tie"]
    mine = {r[0]: np.array(r[1]) for r in out.select("user", "features").collect()}
    ref = _mllib(df, model.numerical, model.categorical)
    assert len(model.mean) == len(next(iter(ref.values())))
    for u in mine:
        assert np.allclose(mine[u], ref[u], atol=1e-12), u
    const_dim = model.dim_names.index("const_imp")
    assert all(v[const_dim] == 0.0 for v in mine.values())      # constant column -> 0


def test_integer_mean_not_truncated(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4), ("d", None)], "user string, n int")
    model = prep.fit_features(df, ["n"], [])
    assert math.isclose(model.surrogates["n"], 7 / 3)


def test_label_order_and_null_slot(spark):
    df = spark.createDataFrame([("1", "b"), ("2", "a"), ("3", "b"), ("4", "a"), ("5", None),
                                ("6", "c")], "user string, g string")
    model = prep.fit_features(df, [], ["g"])
    assert model.labels["g"] == ["a", "b", "c"]                  # tie -> alphabetical
    idx = {r[0]: r[1] for r in df.select("user", model.index("g")).collect()}
    assert idx == {"1": 1, "2": 0, "3": 1, "4": 0, "5": 3, "6": 2}


def test_cardinality_bound_counts_null(spark):
    rows = [(str(i), f"v{i % 50}", f"w{i % 51}", f"x{i % 49}" if i % 11 else None,
             f"y{i % 50}" if i % 11 else None, i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "user string, a string, b string, c string, d string, "
                                     "label int")
    card = {r[0]: r[1] for r in prep.string_cardinality(df).collect()}
    assert card == {"user": 500, "a": 50, "b": 51, "c": 50, "d": 51}
    num, cat = prep.detect_column_types(df, "user")
    assert cat == ["a", "c"] and num == []                       # label excluded


def test_nan_is_imputed(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", 3.0)], "user string, v double")
    out, model = prep.prepare(df, "user")
    vals = {r[0]: r[1][0] for r in out.select("user", "features").collect()}
    assert vals["b"] == 0.0 and not any(math.isnan(v) for v in vals.values())


def test_no_usable_column(spark):
    df = spark.createDataFrame([(str(i), f"t{i}") for i in range(100)], "user string, text string")
    with pytest.raises(ValueError):
        prep.prepare(df, "user")


def test_category_counts_only_return_columns_within_bound(spark):
    rows = [(f"a{i % 50}", f"b{i % 51}", None if i % 10 == 0 else f"c{i % 49}") for i in range(510)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = prep._category_counts(df, ["a", "b", "c"], 50)
    assert set(got) == {"a", "c"}                 # b has 51 values
    assert len(got["a"]) == 50 and len(got["c"]) == 50   # 49 + null
    with pytest.raises(ValueError, match="more than 50"):
        prep.fit_features(df, [], ["b"])


def test_prepare_keeps_a_copy_the_caller_stored(spark):
    from cohortlens.plans.lineage import materialize, materialize_with

    df = spark.createDataFrame([(f"U{i}", float(i)) for i in range(10)], "user string, x double")
    cached = df.persist()
    assert materialize(cached) is cached
    same, n = materialize_with(cached, lambda d: d.count())
    assert same is cached and n == 10
    out, model = prep.prepare(cached, "user")
    assert out.count() == 10 and model.n_rows == 10
    cached.unpersist()
