"""Data-quality counts that the feature build would otherwise hide (Q2, Q6, Q25)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeparse import parse_event_time


def source_quality(logs: dict[str, DataFrame], date_col: str = "date") -> DataFrame:
    """``(source, rows, null_users, unparsed_dates)``, one aggregation per log.

    Null users are dropped by the feature operators and unparsed dates count
    as in-hours; these counts say how often either happened.
    """
    parts = []
    for name, log in logs.items():
        if log is None:
            continue
        parts.append(log.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("user").isNull()).alias("null_users"),
            F.count_if(parse_event_time(date_col).isNull()).alias("unparsed_dates"),
        ).select(F.lit(name).alias("source"), "rows", "null_users", "unparsed_dates"))
    if not parts:
        raise ValueError("no log given")
    return reduce(lambda a, b: a.unionByName(b), parts)


def source_quality_events(events: DataFrame, sources=("logon", "device", "http"),
                          src_col: str = "src", date_col: str = "date") -> DataFrame:
    """:func:`source_quality` over one tagged event stream (one scan, one grouping).

    The grouping by source is partially aggregated in every task, so the
    shuffle carries one row per source per task.  Every name in ``sources``
    gets a row, with zero counts when it has no event.
    """
    counts = events.groupBy(F.col(src_col).alias("source")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("user").isNull()).alias("null_users"),
        F.count_if(parse_event_time(date_col).isNull()).alias("unparsed_dates"),
    )
    names = events.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    return names.join(counts, "source", "left").select(
        "source", *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
                    for c in ("rows", "null_users", "unparsed_dates")])


def directory_coverage(features: DataFrame, role_col: str = "role") -> DataFrame:
    """One row ``(users, with_role, match_rate)``: how many users the directory named."""
    return features.agg(
        F.count(F.lit(1)).alias("users"),
        F.count(role_col).alias("with_role"),
    ).withColumn("match_rate", F.try_divide(F.col("with_role").cast("double"), F.col("users")))
