"""Per-user behaviour features.

Two physical forms give the same rows:

* :func:`user_features` (default) tags and unions the logs, aggregates once
  by ``(user, source, key)`` and once by ``user``.  Two hash exchanges, no
  join, no Expand; both levels use partial (map-side) aggregation, so a user
  holding a third of all rows is pre-aggregated in every task before any
  shuffle, and the first exchange spreads that user over its distinct pcs/urls.
* :func:`user_features_joined` aggregates each log on its own and full-outer
  joins the per-user tables, the shape of the original program.

Null users are dropped at the source: they can never match a directory row
or a prediction, and would otherwise form a bogus group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import WORKDAY_END, WORKDAY_START, is_after_hours
from ..functions.timeparse import event_hour

# Activity spellings in the logon log and output column names.
LOGON_ACTIVITY = "Logon"
LOGOFF_ACTIVITY = "Logoff"
LOGON_COLUMNS = ["logon_count", "logon_distinct_pcs", "logon_avg_hour", "logon_hour_std",
                 "afterhours_logons", "logon_events", "logoff_events"]
DEVICE_COLUMNS = ["device_events", "device_distinct_pcs", "afterhours_device"]
HTTP_COLUMNS = ["http_requests", "http_distinct_urls", "afterhours_http"]
NUMERIC_FILL_TYPES = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType)


def _with_hour(log: DataFrame) -> DataFrame:
    return event_hour(log.where(F.col("user").isNotNull()), "date", "hour")


def _distinct(c: str, exact: bool) -> Column:
    return F.count_distinct(c) if exact else F.approx_count_distinct(c)


# --- one log at a time (A6-A8) ----------------------------------------------

def logon_features(logon: DataFrame, *, workday=(WORKDAY_START, WORKDAY_END),
                   exact_distinct: bool = True) -> DataFrame:
    ev = _with_hour(logon)
    return ev.groupBy("user").agg(
        F.count(F.lit(1)).alias("logon_count"),
        _distinct("pc", exact_distinct).alias("logon_distinct_pcs"),
        F.avg("hour").alias("logon_avg_hour"),
        F.stddev_samp("hour").alias("logon_hour_std"),
        F.count_if(is_after_hours("hour", *workday)).alias("afterhours_logons"),
        F.count_if(F.col("activity") == LOGON_ACTIVITY).alias("logon_events"),
        F.count_if(F.col("activity") == LOGOFF_ACTIVITY).alias("logoff_events"),
    )


def device_features(device: DataFrame, *, workday=(WORKDAY_START, WORKDAY_END),
                    exact_distinct: bool = True) -> DataFrame:
    ev = _with_hour(device)
    return ev.groupBy("user").agg(
        F.count(F.lit(1)).alias("device_events"),
        _distinct("pc", exact_distinct).alias("device_distinct_pcs"),
        F.count_if(is_after_hours("hour", *workday)).alias("afterhours_device"),
    )


def http_features(http: DataFrame, *, workday=(WORKDAY_START, WORKDAY_END),
                  exact_distinct: bool = True) -> DataFrame:
    ev = _with_hour(http)
    return ev.groupBy("user").agg(
        F.count(F.lit(1)).alias("http_requests"),
        _distinct("url", exact_distinct).alias("http_distinct_urls"),
        F.count_if(is_after_hours("hour", *workday)).alias("afterhours_http"),
    )


# --- directory (S5, P3, P6) ---------------------------------------------------

def latest_directory(snapshots: DataFrame, snapshot_col: str = "snapshot") -> DataFrame:
    """``(user, role)`` from the latest snapshot, one row per user.

    "Latest" is the greatest snapshot name in lower case (month names sort in time order).
    The maximum is a scalar subquery, so the filter stays lazy and reaches the
    scan.  A user listed twice keeps the smallest role, so reruns agree.
    """
    name = F.lower(F.col(snapshot_col))
    latest = snapshots.agg(F.max(name)).scalar()
    return directory_roles(snapshots.where(name == latest))


def directory_roles(snapshot: DataFrame) -> DataFrame:
    """``(user, role)`` of one snapshot, one row per user: the smallest role."""
    return (snapshot.where(F.col("user_id").isNotNull())
            .groupBy(F.col("user_id").alias("user"))
            .agg(F.min("role").alias("role")))


# --- combining (J1, J2, P4) ---------------------------------------------------

# Measures that are means, not counts: ``fill="counts_only"`` leaves them null
# so that mean imputation (not midnight) fills a user without logons.
MEAN_COLUMNS = ("logon_avg_hour", "logon_hour_std")


def fill_numeric_zero(df: DataFrame, exclude=("user",), fill=True) -> DataFrame:
    """Zero-fill int/bigint/double/float columns.

    ``fill=True`` fills every such column; ``fill="counts_only"`` skips the
    hour mean and deviation; ``fill=False`` returns ``df`` unchanged.
    """
    if fill is False:
        return df
    skip = set(exclude) | (set(MEAN_COLUMNS) if fill == "counts_only" else set())
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_FILL_TYPES) and f.name not in skip]
    return df.na.fill(0, subset=cols) if cols else df


def user_features_joined(logon: DataFrame | None = None, device: DataFrame | None = None,
                         http: DataFrame | None = None, directory: DataFrame | None = None,
                         *, workday=(WORKDAY_START, WORKDAY_END), fill: bool = True,
                         exact_distinct: bool = True) -> DataFrame:
    """Per-log aggregates, full outer joined on ``user``, role left-joined."""
    kw = dict(workday=workday, exact_distinct=exact_distinct)
    tables = [f(t, **kw) for f, t in ((logon_features, logon), (device_features, device),
                                      (http_features, http)) if t is not None]
    if not tables:
        raise ValueError("no activity source: give at least one of logon, device, http")
    combined = reduce(lambda a, b: a.join(b, on="user", how="full"), tables)
    if directory is not None:
        combined = combined.join(directory, on="user", how="left")
    return fill_numeric_zero(combined, fill=fill)


def _tag(log: DataFrame, src: str, key: str, activity: bool) -> DataFrame:
    ev = _with_hour(log)
    return ev.select(
        "user", F.lit(src).alias("src"), F.col(key).alias("key"), "hour",
        (F.col("activity") if activity else F.lit(None).cast("string")).alias("activity"))


def _std_from_moments(n: Column, s: Column, ss: Column) -> Column:
    """Sample standard deviation from count, sum and sum of squares.

    The numerator ``n*ss - s*s`` is formed in exact decimal arithmetic (the
    inputs are integer hours), so it does not cancel; null when n < 2.
    """
    dec = "decimal(38,0)"
    num = (n.cast(dec) * ss.cast(dec) - s.cast(dec) * s.cast(dec)).cast("double")
    # in double: n * (n - 1) overflows bigint beyond ~3e9 events of one user
    var = F.try_divide(num, n.cast("double") * (n - 1).cast("double"))
    return F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0))))


def _single_pass(events: DataFrame, has_logon: bool, has_device: bool, has_http: bool,
                 workday, rsd: float = 0.01) -> DataFrame:
    """One aggregation by user with HyperLogLog distinct counts: a single exchange."""
    h, src, key = F.col("hour"), F.col("src"), F.col("key")
    after = is_after_hours(h, *workday)

    def present(name: str, value: Column) -> Column:
        # null (not 0) for a user without rows in that source, as the outer join gives
        return F.when(F.count_if(src == name) > 0, value)

    aggs = []
    if has_logon:
        lg = src == "logon"
        aggs += [present("logon", F.count_if(lg)).alias("logon_count"),
                 present("logon", F.approx_count_distinct(F.when(lg, key), rsd))
                 .alias("logon_distinct_pcs"),
                 F.avg(F.when(lg, h)).alias("logon_avg_hour"),
                 F.stddev_samp(F.when(lg, h)).alias("logon_hour_std"),
                 present("logon", F.count_if(lg & after)).alias("afterhours_logons"),
                 present("logon", F.count_if(lg & (F.col("activity") == LOGON_ACTIVITY)))
                 .alias("logon_events"),
                 present("logon", F.count_if(lg & (F.col("activity") == LOGOFF_ACTIVITY)))
                 .alias("logoff_events")]
    for name, has, cols in (("device", has_device, DEVICE_COLUMNS),
                            ("http", has_http, HTTP_COLUMNS)):
        if has:
            m = src == name
            aggs += [present(name, F.count_if(m)).alias(cols[0]),
                     present(name, F.approx_count_distinct(F.when(m, key), rsd)).alias(cols[1]),
                     present(name, F.count_if(m & after)).alias(cols[2])]
    return events.groupBy("user").agg(*aggs)


def user_features(logon: DataFrame | None = None, device: DataFrame | None = None,
                  http: DataFrame | None = None, directory: DataFrame | None = None,
                  *, workday=(WORKDAY_START, WORKDAY_END), fill: bool = True,
                  exact_distinct: bool = True) -> DataFrame:
    """One row per user with the logon, device and web measures, plus ``role``.

    Same rows as :func:`user_features_joined`, computed with two aggregations
    and no join: the logs are tagged and unioned, then passed to
    :func:`user_features_from_events`.
    """
    parts, sources = [], []
    for src, log, key, activity in (("logon", logon, "pc", True), ("device", device, "pc", False),
                                     ("http", http, "url", False)):
        if log is not None:
            parts.append(_tag(log, src, key, activity))
            sources.append(src)
    if not parts:
        raise ValueError("no activity source: give at least one of logon, device, http")
    events = reduce(lambda a, b: a.unionByName(b), parts)
    return user_features_from_events(events, directory, sources=sources, workday=workday,
                                     fill=fill, exact_distinct=exact_distinct)


EVENT_SOURCES = ("logon", "device", "http")


def user_features_from_events(events: DataFrame, directory: DataFrame | None = None, *,
                              sources=EVENT_SOURCES, workday=(WORKDAY_START, WORKDAY_END),
                              fill: bool = True, exact_distinct: bool = True) -> DataFrame:
    """:func:`user_features` over one tagged event stream.

    ``events`` holds ``user``, ``src`` (one of ``sources``), ``key`` (the pc
    for logon/device rows, the url for web rows), ``date`` (string in any of
    the known spellings, or a timestamp) and ``activity`` (logon rows), or
    ``hour`` in place of ``date``.  When the three logs live in one table this
    reads it once instead of once per log.  ``exact_distinct=False`` computes
    everything in a single aggregation (one exchange) with HyperLogLog
    distinct counts, for very large url sets.
    """
    if not sources:
        raise ValueError("no activity source: give at least one of logon, device, http")
    if "hour" not in events.columns:
        events = _with_hour(events)
    else:
        events = events.where(F.col("user").isNotNull())
    logon, device, http = (s in sources for s in EVENT_SOURCES)
    if not exact_distinct:
        combined = _single_pass(events, logon, device, http, workday)
        if directory is not None:
            combined = combined.join(directory, on="user", how="left")
        return fill_numeric_zero(combined, fill=fill)

    h = F.col("hour")
    per_key = events.groupBy("user", "src", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(h).alias("nh"),
        F.sum(h).alias("sh"),
        F.sum(h * h).alias("ssh"),
        F.count_if(is_after_hours(h, *workday)).alias("na"),
        F.count_if(F.col("activity") == LOGON_ACTIVITY).alias("non"),
        F.count_if(F.col("activity") == LOGOFF_ACTIVITY).alias("noff"),
    )

    def of(src: str, c: str) -> Column:
        return F.sum(F.when(F.col("src") == src, F.col(c)))

    def keys(src: str) -> Column:
        # null (not 0) for a user without rows in ``src``, as the outer join gives
        return F.when(of(src, "n").isNotNull(),
                      F.count(F.when(F.col("src") == src, F.col("key"))))

    aggs = []
    if logon:
        nh, sh, ssh = of("logon", "nh"), of("logon", "sh"), of("logon", "ssh")
        aggs += [of("logon", "n").alias("logon_count"),
                 keys("logon").alias("logon_distinct_pcs"),
                 F.try_divide(sh.cast("double"), nh).alias("logon_avg_hour"),
                 _std_from_moments(nh, sh, ssh).alias("logon_hour_std"),
                 of("logon", "na").alias("afterhours_logons"),
                 of("logon", "non").alias("logon_events"),
                 of("logon", "noff").alias("logoff_events")]
    if device:
        aggs += [of("device", "n").alias("device_events"),
                 keys("device").alias("device_distinct_pcs"),
                 of("device", "na").alias("afterhours_device")]
    if http:
        aggs += [of("http", "n").alias("http_requests"),
                 keys("http").alias("http_distinct_urls"),
                 of("http", "na").alias("afterhours_http")]
    combined = per_key.groupBy("user").agg(*aggs)
    if directory is not None:
        combined = combined.join(directory, on="user", how="left")
    return fill_numeric_zero(combined, fill=fill)
