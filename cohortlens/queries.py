"""Registered queries and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)``, reads the driver's Parquet tables and
returns a DataFrame; ``oracle_sql()[name]`` computes the same rows in DuckDB
over the same tables.  Doubles are rounded to 6 places on both sides so the
order-insensitive value hash compares like with like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.predicates import header_row
from .functions.timeparse import parse_event_time
from .operators import features as feat
from .plans.lineage import shared_path
from .sources import tables as tb
from .sources.files import parse_lines

ROUND = 6


def rounded(df: DataFrame, places: int = ROUND) -> DataFrame:
    """Round every double column (for engine-independent comparison)."""
    return df.select(*[
        F.round(F.col(f.name), places).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


# --- SQL fragments: the fixture views of sources/tables.py --------------------

_FORMATS_SQL = "['%m/%d/%Y %H:%M:%S', '%Y-%m-%d %H:%M:%S', '%-m/%-d/%Y %-H:%M']"
_K_SQL = "regexp_extract(props, '([0-9]+)', 1)"

_SOURCE_SQL = """CASE WHEN event_type IN ('click', 'view') THEN 'logon'
    WHEN event_type = 'purchase' AND user_id % 10 >= 4 THEN 'device'
    WHEN event_type IN ('signup', 'error') AND user_id % 10 = 9 THEN 'device'
    ELSE 'http' END"""

LOGON_SQL = f"""SELECT CAST(event_id AS VARCHAR) AS id,
    strftime(ts, '%m/%d/%Y %H:%M:%S') AS date,
    CAST(user_id AS VARCHAR) AS "user",
    'PC-' || {_K_SQL} AS pc,
    CASE WHEN event_type = 'click' THEN 'Logon' ELSE 'Logoff' END AS activity
  FROM events WHERE {_SOURCE_SQL} = 'logon'"""

DEVICE_SQL = f"""SELECT CAST(event_id AS VARCHAR) AS id,
    strftime(ts, '%-m/%-d/%Y %-H:%M') AS date,
    CAST(user_id AS VARCHAR) AS "user",
    'PC-' || {_K_SQL} AS pc,
    'Connect' AS activity
  FROM events WHERE {_SOURCE_SQL} = 'device'"""

HTTP_SQL = f"""SELECT CAST(event_id AS VARCHAR) AS id,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS date,
    CAST(user_id AS VARCHAR) AS "user",
    'PC-' || {_K_SQL} AS pc,
    'http://site' || {_K_SQL} || '.example' AS url
  FROM events WHERE {_SOURCE_SQL} = 'http'"""

SNAPSHOTS_SQL = """SELECT employee_name, user_id, email, domain, role,
    'LDAP-2010-' || lpad(CAST(m AS VARCHAR), 2, '0') AS snapshot
  FROM (
    SELECT c_name AS employee_name, CAST(c_custkey AS VARCHAR) AS user_id,
           lower(replace(c_name, '#', '.')) || '@corp.example' AS email,
           'corp.example' AS domain, c_mktsegment AS role,
           unnest(generate_series(1, CASE WHEN c_acctbal < 0
               THEN least(11, 1 + CAST(floor(-c_acctbal / 100) AS INTEGER)) ELSE 12 END)) AS m
    FROM customer
    UNION ALL
    SELECT c_name, CAST(c_custkey AS VARCHAR),
           lower(replace(c_name, '#', '.')) || '@corp.example',
           'corp.example', 'IT Admin', 12
    FROM customer WHERE c_acctbal > 9000)"""

DIRECTORY_SQL = """SELECT user_id AS "user", min(role) AS role
  FROM snapshots
  WHERE snapshot = (SELECT max(snapshot) FROM snapshots) AND user_id IS NOT NULL
  GROUP BY user_id"""


def _hour_sql(src: str) -> str:
    return (f"SELECT *, CAST(hour(try_strptime(date, {_FORMATS_SQL})) AS INTEGER) AS hour "
            f"FROM {src} WHERE \"user\" IS NOT NULL")


_AFTER = "(hour < 8 OR hour >= 18)"

LOGON_AGG_SQL = f"""SELECT "user", count(*) AS logon_count,
    count(DISTINCT pc) AS logon_distinct_pcs,
    avg(hour) AS logon_avg_hour, stddev_samp(hour) AS logon_hour_std,
    count(*) FILTER (WHERE {_AFTER}) AS afterhours_logons,
    count(*) FILTER (WHERE activity = 'Logon') AS logon_events,
    count(*) FILTER (WHERE activity = 'Logoff') AS logoff_events
  FROM logon_h GROUP BY "user\""""

DEVICE_AGG_SQL = f"""SELECT "user", count(*) AS device_events,
    count(DISTINCT pc) AS device_distinct_pcs,
    count(*) FILTER (WHERE {_AFTER}) AS afterhours_device
  FROM device_h GROUP BY "user\""""

HTTP_AGG_SQL = f"""SELECT "user", count(*) AS http_requests,
    count(DISTINCT url) AS http_distinct_urls,
    count(*) FILTER (WHERE {_AFTER}) AS afterhours_http
  FROM http_h GROUP BY "user\""""

LOGS_CTE = f"""logon AS ({LOGON_SQL}),
device AS ({DEVICE_SQL}),
http AS ({HTTP_SQL}),
logon_h AS ({_hour_sql('logon')}),
device_h AS ({_hour_sql('device')}),
http_h AS ({_hour_sql('http')})"""

FEATURES_RAW_CTE = f"""{LOGS_CTE},
lf AS ({LOGON_AGG_SQL}),
df AS ({DEVICE_AGG_SQL}),
hf AS ({HTTP_AGG_SQL}),
snapshots AS ({SNAPSHOTS_SQL}),
directory AS ({DIRECTORY_SQL}),
joined AS (
  SELECT coalesce(lf."user", df."user", hf."user") AS "user",
         lf.* EXCLUDE ("user"), df.* EXCLUDE ("user"), hf.* EXCLUDE ("user")
  FROM lf FULL JOIN df ON lf."user" = df."user"
          FULL JOIN hf ON coalesce(lf."user", df."user") = hf."user"),
features_raw AS (
  SELECT joined.*, directory.role FROM joined LEFT JOIN directory USING ("user"))"""

_FEATURE_NUMS = feat.LOGON_COLUMNS + feat.DEVICE_COLUMNS + feat.HTTP_COLUMNS
_FEATURE_DOUBLES = {"logon_avg_hour", "logon_hour_std"}

FEATURES_CTE = FEATURES_RAW_CTE + """,
features AS (
  SELECT "user", """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _FEATURE_NUMS) + """, role
  FROM features_raw)"""


def _r(c: str) -> str:
    return f"round({c}, {ROUND}) AS {c}"


def _select_rounded(cols, doubles) -> str:
    return ", ".join(_r(c) if c in doubles else (f'"{c}"' if c == "user" else c) for c in cols)


# --- Spark side -----------------------------------------------------------------

def q_logon_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feat.logon_features(tb.logon_log(spark, sf_dir)))


def q_device_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feat.device_features(tb.device_log(spark, sf_dir)))


def q_http_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feat.http_features(tb.http_log(spark, sf_dir)))


def q_directory_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.latest_directory(tb.directory_snapshots(spark, sf_dir))


def _features(spark, sf_dir, form, fill=True):
    directory = feat.latest_directory(tb.directory_snapshots(spark, sf_dir))
    if form is feat.user_features:
        # the three logs come from one table: read it once
        return feat.user_features_from_events(tb.activity_events(spark, sf_dir), directory,
                                              fill=fill)
    logs = tb.activity_logs(spark, sf_dir)
    return form(logs["logon"], logs["device"], logs["http"], directory, fill=fill)


def q_user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir, feat.user_features))


def q_user_features_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir, feat.user_features_joined))


def q_user_features_unfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir, feat.user_features, fill=False))


def _raw_dates(spark, sf_dir):
    ev = tb.table(spark, sf_dir, "events")
    raw = (F.when(F.col("event_type") == "click", F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
           .when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
           .when(F.col("event_type") == "purchase", F.date_format("ts", "M/d/yyyy H:mm"))
           .when(F.col("event_type") == "signup",
                 F.concat(F.lit("n/a "), F.col("event_id").cast("string"))))
    return ev.select("event_id", raw.alias("raw"))


def q_parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = parse_event_time("raw")
    return _raw_dates(spark, sf_dir).select(
        "event_id", "raw",
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        F.hour(ts).alias("hour"))


def q_header_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logon log with one header line per day-file mixed in, then S2's row filter."""
    log = tb.logon_log(spark, sf_dir)
    headers = log.select(F.substring("date", 1, 10).alias("day")).distinct().select(
        F.lit(" Id ").alias("id"), F.lit("Date").alias("date"), F.lit("User").alias("user"),
        F.lit("PC").alias("pc"), F.lit("Activity").alias("activity"))
    mixed = log.unionByName(headers)
    return mixed.where(~header_row(mixed.columns, "id"))


def q_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web log as CSV lines (one header a day, short, long and quoted lines), parsed back."""
    log = tb.http_log(spark, sf_dir)
    last = F.col("id").cast("long") % 10
    start = F.concat_ws(",", "id", "date", "user", "pc")
    line = (F.when(last == 1, start)
            .when(last == 2, F.concat(start, F.lit(","), "url", F.lit(",more")))
            .when(last == 3, F.concat(start, F.lit(',"'), "url", F.lit(',q"')))
            .otherwise(F.concat(start, F.lit(","), "url")))
    headers = log.select(F.substring("date", 1, 10).alias("day")).distinct().select(
        F.lit("id,date,user,pc,url").alias("line"))
    return parse_lines(log.select(line.alias("line")).unionByName(headers), "http")


def q_user_features_counts_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir, feat.user_features, fill="counts_only"))


def q_source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.quality import source_quality_events
    # the three logs come from one table: one scan, one grouping by source
    return source_quality_events(tb.activity_events(spark, sf_dir))


def q_directory_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.quality import directory_coverage
    return rounded(directory_coverage(_features(spark, sf_dir, feat.user_features)))


def q_parquet_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.files import load_parquet
    return load_parquet(spark, f"{sf_dir}/customer.parquet")


def source_folder(spark, sf_dir) -> str:
    """The logs and directory snapshots as CSV sources in the shared folder, headers in some."""
    folder = shared_path(spark, "sources")
    log = tb.logon_log(spark, sf_dir)
    even = F.col("id").cast("long") % 2 == 0
    parts = {"logon_a.csv": (log.where(even), True), "logon_b.csv": (log.where(~even), False),
             "device.csv": (tb.device_log(spark, sf_dir), True), "HTTP-1.csv": (tb.http_log(spark, sf_dir), False)}
    # dealt out: a small table in one file grows by the months of every person
    snapshots = tb.directory_snapshots(spark, sf_dir, spark.sparkContext.defaultParallelism)
    last = F.col("snapshot") == f"LDAP-2010-{tb.LAST_MONTH:02d}"
    parts[f"LDAP-2010-{tb.LAST_MONTH:02d}.csv"] = (snapshots.where(last).drop("snapshot"), True)
    parts["ldap-2010-01.csv"] = (snapshots.where(~last).drop("snapshot"), False)
    for name, (df, header) in parts.items():
        df.write.option("header", header).csv(f"{folder}/{name}")
    return folder


def q_features_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs and snapshots written as CSV sources, discovered and read back in one scan per schema."""
    from .plans.analysis import build_user_features
    return rounded(build_user_features(spark, source_folder(spark, sf_dir)))


def q_users_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user table through the verified CSV sink."""
    from .sources.sinks import read_labelled_users, write_labelled_users
    users = _features(spark, sf_dir, feat.user_features)
    path = shared_path(spark, "users")
    write_labelled_users(users, path)
    return rounded(read_labelled_users(spark, path, users.schema))


def _spelled(key, digit):
    """Users as the logs of several systems may spell them."""
    return (F.when(digit == 1, F.concat(F.lit("CORP\\"), key))
            .when(digit == 2, F.concat(key, F.lit("@Corp.example")))
            .when(digit == 3, F.concat(F.lit("  "), key, F.lit(" "))).otherwise(key))


def _mixed_directory(spark, sf_dir) -> DataFrame:
    """The directory with some names spelled otherwise, and some listed twice under two spellings."""
    directory = feat.latest_directory(tb.directory_snapshots(spark, sf_dir))
    number = F.col("user").cast("long")
    twice = directory.where(number % 7 == 3).select(F.concat(F.lit("corp/"), "user").alias("user"),
                                                    F.lit("Contractor").alias("role"))
    return directory.withColumn("user", F.when(number % 5 == 0, F.concat(F.lit("corp/"), "user"))
                                .otherwise(F.col("user"))).unionByName(twice)


def q_directory_coverage_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rates of the directory join, verbatim and on canonical spellings."""
    from .operators.identity import canonical_coverage, join_canonical
    users = _features(spark, sf_dir, feat.user_features).withColumn(
        "user", _spelled(F.col("user"), F.col("user").cast("long") % 4))
    return rounded(canonical_coverage(join_canonical(users, _mixed_directory(spark, sf_dir))))


def q_roles_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user with its role and how the directory matched it."""
    from .operators.identity import join_canonical
    users = _features(spark, sf_dir, feat.user_features).withColumn(
        "user", _spelled(F.col("user"), F.col("user").cast("long") % 4))
    return join_canonical(users, _mixed_directory(spark, sf_dir)).select("user", "role", "role_match")


def q_daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys per user and log from merged daily sketches, held against the exact counts."""
    from .operators.sketches import daily_sketches, merged_counts, within_bound
    events = tb.activity_events(spark, sf_dir)
    merged = merged_counts(daily_sketches(events), "user", "src")
    exact = (events.where(F.col("user").isNotNull()).groupBy("user", "src")
             .agg(F.count_distinct("key").alias("exact_keys")))
    return merged.join(exact, ["user", "src"]).select(
        "user", "src", "n", "exact_keys", within_bound("distinct_keys", "exact_keys").alias("within_bound"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "logon_features": q_logon_features,
    "device_features": q_device_features,
    "http_features": q_http_features,
    "directory_latest": q_directory_latest,
    "user_features": q_user_features,
    "user_features_joined": q_user_features_joined,
    "user_features_unfilled": q_user_features_unfilled,
    "parse_timestamps": q_parse_timestamps,
    "header_filter": q_header_filter,
    "csv_lines": q_csv_lines,
    "user_features_counts_only": q_user_features_counts_only,
    "source_quality": q_source_quality,
    "directory_coverage": q_directory_coverage,
    "parquet_passthrough": q_parquet_passthrough,
    "features_from_files": q_features_from_files,
    "users_sink": q_users_sink,
    "directory_coverage_canonical": q_directory_coverage_canonical,
    "roles_canonical": q_roles_canonical,
    "daily_sketches": q_daily_sketches,
}


# --- DuckDB side ------------------------------------------------------------------

_LOGON_OUT = ["user"] + feat.LOGON_COLUMNS
_DEVICE_OUT = ["user"] + feat.DEVICE_COLUMNS
_HTTP_OUT = ["user"] + feat.HTTP_COLUMNS

ORACLE: dict[str, str] = {
    "logon_features": f"WITH {LOGS_CTE}, lf AS ({LOGON_AGG_SQL}) "
                      f"SELECT {_select_rounded(_LOGON_OUT, _FEATURE_DOUBLES)} FROM lf",
    "device_features": f"WITH {LOGS_CTE}, df AS ({DEVICE_AGG_SQL}) SELECT * FROM df",
    "http_features": f"WITH {LOGS_CTE}, hf AS ({HTTP_AGG_SQL}) SELECT * FROM hf",
    "directory_latest": f"WITH snapshots AS ({SNAPSHOTS_SQL}) {DIRECTORY_SQL}",
    "user_features": f"WITH {FEATURES_CTE} SELECT "
                     f"{_select_rounded(['user'] + _FEATURE_NUMS + ['role'], _FEATURE_DOUBLES)} "
                     f"FROM features",
    "user_features_unfilled": f"WITH {FEATURES_RAW_CTE} SELECT "
                              f"{_select_rounded(['user'] + _FEATURE_NUMS + ['role'], _FEATURE_DOUBLES)} "
                              f"FROM features_raw",
    "parse_timestamps": f"""WITH r AS (
        SELECT event_id, CASE
            WHEN event_type = 'click' THEN strftime(ts, '%m/%d/%Y %H:%M:%S')
            WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
            WHEN event_type = 'purchase' THEN strftime(ts, '%-m/%-d/%Y %-H:%M')
            WHEN event_type = 'signup' THEN 'n/a ' || CAST(event_id AS VARCHAR)
          END AS raw
        FROM events),
      p AS (SELECT event_id, raw, try_strptime(raw, {_FORMATS_SQL}) AS ts FROM r)
      SELECT event_id, raw, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed,
             CAST(hour(ts) AS INTEGER) AS hour FROM p""",
    "header_filter": f"WITH logon AS ({LOGON_SQL}) SELECT * FROM logon",
    "csv_lines": f"""SELECT id, date, "user", pc,
        CASE CAST(id AS BIGINT) % 10 WHEN 1 THEN NULL WHEN 3 THEN url || ',q' ELSE url END AS url,
        CAST(id AS BIGINT) % 10 IN (1, 2) AS malformed
      FROM ({HTTP_SQL})""",
}
ORACLE["user_features_joined"] = ORACLE["user_features"]
ORACLE["user_features_counts_only"] = (
    f"WITH {FEATURES_RAW_CTE} SELECT \"user\", " + ", ".join(
        (f"round({c}, {ROUND}) AS {c}" if c in _FEATURE_DOUBLES else f"coalesce({c}, 0) AS {c}")
        for c in _FEATURE_NUMS) + ", role FROM features_raw")
ORACLE["source_quality"] = " UNION ALL ".join(
    f"""SELECT '{src}' AS source, count(*) AS rows,
        count(*) FILTER (WHERE "user" IS NULL) AS null_users,
        count(*) FILTER (WHERE try_strptime(date, {_FORMATS_SQL}) IS NULL) AS unparsed_dates
      FROM ({body})""" for src, body in (("logon", LOGON_SQL), ("device", DEVICE_SQL),
                                          ("http", HTTP_SQL)))
ORACLE["directory_coverage"] = (
    f"WITH {FEATURES_CTE} SELECT count(*) AS users, count(role) AS with_role, "
    f"round(CAST(count(role) AS DOUBLE) / count(*), {ROUND}) AS match_rate FROM features")
ORACLE["parquet_passthrough"] = "SELECT * FROM customer"
ORACLE["features_from_files"] = ORACLE["users_sink"] = ORACLE["user_features"]

_CANONICAL_SQL = r"nullif(lower(trim(regexp_replace(regexp_replace(trim({}), '^[^\\/]*[\\/]', ''), '@.*$', ''))), '')"
_ROLES_CTE = f"""{FEATURES_CTE},
spelled AS (SELECT CASE CAST("user" AS BIGINT) % 4 WHEN 1 THEN 'CORP\\' || "user" WHEN 2 THEN "user" || '@Corp.example'
    WHEN 3 THEN '  ' || "user" || ' ' ELSE "user" END AS "user" FROM features),
mixed AS (SELECT CASE WHEN CAST("user" AS BIGINT) % 5 = 0 THEN 'corp/' || "user" ELSE "user" END AS "user", role
    FROM directory
  UNION ALL SELECT 'corp/' || "user", 'Contractor' FROM directory WHERE CAST("user" AS BIGINT) % 7 = 3),
exact AS (SELECT "user", min(role) AS role FROM mixed GROUP BY "user"),
near AS (SELECT {_CANONICAL_SQL.format('"user"')} AS key, min(role) AS role,
    count(DISTINCT coalesce('=' || role, '-')) AS n FROM mixed GROUP BY 1),
roles AS (SELECT s."user",
    CASE WHEN e."user" IS NOT NULL THEN e.role WHEN n.n = 1 THEN n.role END AS role,
    CASE WHEN e."user" IS NOT NULL THEN 'exact' WHEN n.n > 1 THEN 'ambiguous'
      WHEN n.n = 1 THEN 'canonical' ELSE 'none' END AS role_match
  FROM spelled s LEFT JOIN exact e ON e."user" = s."user"
    LEFT JOIN near n ON n.key = {_CANONICAL_SQL.format('s."user"')})"""
ORACLE["roles_canonical"] = f"WITH {_ROLES_CTE} SELECT * FROM roles"
ORACLE["directory_coverage_canonical"] = f"""WITH {_ROLES_CTE}
  SELECT count(*) AS users, count(*) FILTER (role_match = 'exact') AS exact,
    count(*) FILTER (role_match = 'canonical') AS canonical, count(*) FILTER (role_match = 'ambiguous') AS ambiguous,
    round(CAST(count(*) FILTER (role_match = 'exact') AS DOUBLE) / count(*), {ROUND}) AS match_rate,
    round(CAST(count(*) FILTER (role_match IN ('exact', 'canonical')) AS DOUBLE) / count(*), {ROUND})
      AS canonical_match_rate FROM roles"""
ORACLE["daily_sketches"] = f"""WITH {LOGS_CTE},
  keyed AS (SELECT "user", 'logon' AS src, pc AS key FROM logon UNION ALL SELECT "user", 'device', pc FROM device
    UNION ALL SELECT "user", 'http', url FROM http)
  SELECT "user", src, count(*) AS n, count(DISTINCT key) AS exact_keys, true AS within_bound
  FROM keyed WHERE "user" IS NOT NULL GROUP BY "user", src"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_analysis as qa
    from . import queries_vectors as qv
    return {**QUERIES, **qv.QUERIES, **qa.QUERIES}


def oracle_sql() -> dict[str, str]:
    from . import queries_analysis as qa
    from . import queries_vectors as qv
    return {**ORACLE, **qv.ORACLE, **qa.ORACLE}
