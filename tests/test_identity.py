"""Canonical user spellings, sketches and bounded distinct counts."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import identity, prep, sketches


@pytest.mark.parametrize("spelled, want", [
    ("CORP\\ABC01", "abc01"), ("corp/abc01", "abc01"), (" Abc01@Corp.example ", "abc01"), ("abc01", "abc01"),
    ("", None), ("  ", None), (None, None), ("@x", None), ("corp\\", None)])
def test_canonical_user(spark, spelled, want):
    df = spark.createDataFrame([(spelled,)], "u string")
    assert df.select(identity.canonical_user("u")).first()[0] == want


def test_join_canonical(spark):
    users = spark.createDataFrame([("CORP\\a", 1), ("b", 2), ("C@x", 3), ("d", 4), (None, 5), ("b", 6), ("E", 7)],
                                  "user string, n int")
    directory = spark.createDataFrame([("A", "r1"), ("b", "r2"), ("x/b", "r3"), ("c", "r4"), ("y/C", "r5"),
                                       (None, "r6"), ("e", None), ("f/e", "r7"), ("b", "r0")],
                                      "user string, role string")
    joined = identity.join_canonical(users, directory)
    got = {r["n"]: (r["role"], r["role_match"]) for r in joined.collect()}
    assert got == {1: ("r1", "canonical"), 2: ("r0", "exact"), 3: (None, "ambiguous"), 4: (None, "none"),
                   5: (None, "none"), 6: ("r0", "exact"), 7: (None, "ambiguous")}
    row = identity.canonical_coverage(joined).first().asDict()
    assert row == {"users": 7, "exact": 2, "canonical": 1, "ambiguous": 2, "match_rate": 2 / 7,
                   "canonical_match_rate": 3 / 7}
    none = identity.join_canonical(users, directory.limit(0))
    assert {r["role_match"] for r in none.collect()} == {"none"}
    assert identity.canonical_coverage(joined.limit(0)).first()["match_rate"] is None


def test_sketches_of_new_days_merge(spark):
    rows = [(f"u{i % 3}", "http", f"k{i % 700}", f"2010-01-0{1 + i % 4} 09:00:00", None) for i in range(6000)]
    rows += [(None, "http", "k", "2010-01-01 09:00:00", None), ("u0", "http", None, "junk", None)]
    events = spark.createDataFrame(rows, "user string, src string, key string, date string, activity string")
    first = sketches.daily_sketches(events.where("date < '2010-01-03'"))
    later = sketches.daily_sketches(events.where("date >= '2010-01-03'"))
    both = sketches.merged_counts(first.unionByName(later), "user").collect()
    exact = {r["user"]: (r["n"], r["d"]) for r in events.where("user is not null").groupBy("user").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("d")).collect()}
    assert {r["user"]: r["n"] for r in both} == {u: n for u, (n, _) in exact.items()}
    for r in both:
        assert abs(r["distinct_keys"] - exact[r["user"]][1]) <= max(1, sketches.error_bound() * exact[r["user"]][1])
    # a longer sketch has a smaller bound
    assert sketches.error_bound(16) < sketches.error_bound(12)


def test_column_types_of_many_values(spark):
    df = spark.range(200_000).select(
        F.col("id").cast("string").alias("user"), F.col("id").cast("string").alias("unique"),
        F.concat(F.lit("v"), F.col("id") % 50).alias("fifty"), F.concat(F.lit("v"), F.col("id") % 51).alias("many"),
        F.when(F.col("id") % 50 > 0, F.concat(F.lit("v"), F.col("id") % 50)).alias("null_counts"),
        F.when(F.col("id") % 51 > 0, F.concat(F.lit("v"), F.col("id") % 51)).alias("null_is_one_more"),
        F.when(F.col("id") % 2 == 0, "").otherwise("x").alias("blank"), F.lit(None).cast("string").alias("none"),
        (F.col("id") * 1.0).alias("x"), F.current_date().alias("day"))
    types = prep.column_types(df)
    kinds = {r["column"]: r["kind"] for r in types.collect()}
    assert kinds == {"unique": "dropped", "fifty": "categorical", "many": "dropped", "null_counts": "categorical",
                     "null_is_one_more": "dropped", "blank": "categorical", "none": "categorical",
                     "x": "numerical", "day": "dropped"}
    assert prep.detect_column_types(df) == (["x"], ["fifty", "null_counts", "blank", "none"])
    buf = io.StringIO()
    with redirect_stdout(buf):
        types.explain("formatted")
    plan = buf.getvalue()
    # one aggregate of sketches: no row is repeated per column, no value is shuffled
    assert "Expand" not in plan and "hashpartitioning" not in plan
    assert prep.column_types(df.limit(0)).count() == 9
