"""Joining the directory on canonical user spellings (Q25).

Logs and directory may spell a user differently: in either letter case, with a
domain before or after the name, with spaces around it.  The join compares
canonical spellings; a spelling that several directory users with different
roles share is ambiguous, gives no role and is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_user(user: str | Column) -> Column:
    """The spelling without a domain (``DOMAIN\\name``, ``domain/name``, ``name@domain``), in lower
    case and without spaces around it; null stays null, and nothing left is null."""
    col = F.col(user) if isinstance(user, str) else user
    name = F.regexp_replace(F.trim(col), r"^[^\\/]*[\\/]", "")
    name = F.lower(F.trim(F.regexp_replace(name, r"@.*$", "")))
    return F.when(name != "", name)


def canonical_directory(directory: DataFrame, user_col: str = "user", role_col: str = "role") -> DataFrame:
    """``(key, role, ambiguous)``, one row per canonical spelling.

    ``ambiguous`` where users of that spelling have several roles (a missing
    role is one of its own); ``role`` is then null.
    """
    found = F.collect_set(F.coalesce(F.concat(F.lit("="), F.col(role_col)), F.lit("-")))
    per = (directory.select(canonical_user(user_col).alias("key"), F.col(role_col).alias(role_col))
           .where("key is not null").groupBy("key")
           .agg(F.min(role_col).alias("role"), F.size(found).alias("n")))
    return per.select("key", F.when(F.col("n") == 1, F.col("role")).alias("role"),
                      (F.col("n") > 1).alias("ambiguous"))


def join_canonical(features: DataFrame, directory: DataFrame, user_col: str = "user",
                   role_col: str = "role") -> DataFrame:
    """``features`` with ``role`` and ``role_match``: ``exact``, ``canonical``, ``ambiguous`` or ``none``.

    A verbatim match wins over a canonical one.  Every row of ``features``
    comes out once; the directory side has one row per key in both joins.
    """
    exact = directory.where(F.col(user_col).isNotNull()).groupBy(F.col(user_col).alias("_exact")).agg(
        F.min(role_col).alias("_exact_role"))
    near = canonical_directory(directory, user_col, role_col).select(
        F.col("key").alias("_key"), F.col("role").alias("_near_role"), "ambiguous")
    rows = features.drop(role_col).withColumn("_name", canonical_user(user_col))
    rows = rows.join(exact, F.col(user_col) == F.col("_exact"), "left").join(
        near, F.col("_name") == F.col("_key"), "left")
    verbatim = F.col("_exact").isNotNull()
    return rows.select(
        *[F.col(c) for c in features.columns if c != role_col],
        F.when(verbatim, F.col("_exact_role")).otherwise(F.col("_near_role")).alias("role"),
        F.when(verbatim, "exact").when(F.col("ambiguous"), "ambiguous")
        .when(F.col("_key").isNotNull(), "canonical").otherwise("none").alias("role_match"))


def canonical_coverage(joined: DataFrame) -> DataFrame:
    """One row: users, how many match verbatim and by canonical spelling, both match rates, ambiguous keys."""
    n = F.count(F.lit(1))
    exact = F.count_if(F.col("role_match") == "exact")
    near = F.count_if(F.col("role_match") == "canonical")
    return joined.agg(
        n.alias("users"), exact.alias("exact"), near.alias("canonical"),
        F.count_if(F.col("role_match") == "ambiguous").alias("ambiguous"),
        F.try_divide(exact.cast("double"), n).alias("match_rate"),
        F.try_divide((exact + near).cast("double"), n).alias("canonical_match_rate"))
