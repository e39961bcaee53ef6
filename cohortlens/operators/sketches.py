"""Approximate distinct counts that a new day adds to without reading history (A2).

Per user, log and day one sketch of the keys is stored; sketches of any days
merge into the count over those days.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeparse import parse_event_time

#: 2 ** SKETCH_BITS registers a sketch.
SKETCH_BITS = 12


def error_bound(bits: int = SKETCH_BITS, sigmas: float = 4.0) -> float:
    """Relative error that an estimate exceeds with the chance of ``sigmas`` standard errors."""
    return sigmas * 1.04 / math.sqrt(1 << bits)


def daily_sketches(events: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """``(user, src, day, n, keys)``: events and a sketch of their keys per user, log and day.

    Null users are left out; events without a readable date have a null day;
    null keys count as events only.
    """
    hashed = F.xxhash64("key")
    return (events.where(F.col("user").isNotNull())
            .withColumn("day", F.to_date(parse_event_time("date")))
            .groupBy("user", "src", "day")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.hll_sketch_agg(F.when(F.col("key").isNotNull(), hashed), F.lit(bits)).alias("keys")))


def merged_counts(sketches: DataFrame, *by: str) -> DataFrame:
    """``(*by, n, distinct_keys)`` over the days of :func:`daily_sketches`."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("distinct_keys"))


def within_bound(estimate: str | Column, exact: str | Column, bits: int = SKETCH_BITS) -> Column:
    """Whether an estimate is within the bound (at least one) of the exact count."""
    e, x = (F.col(c) if isinstance(c, str) else c for c in (estimate, exact))
    return F.abs(e - x) <= F.greatest(F.lit(1.0), x * F.lit(error_bound(bits)))
