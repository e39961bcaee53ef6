"""Activity logs, directory snapshots and vectors derived from the driver's tables.

The driver ships Parquet tables, not the original CSV logs.  These views give
them the shape of the sources (string dates in the three spellings, string
user ids, activity values), so every feature operator runs on them unchanged
and its work grows with the tables.  The same views exist as SQL text in
``cohortlens.queries`` for the DuckDB oracle.

Role of each table:

* logon log   = events of type click (Logon) or view (Logoff)
* device log  = purchase events (a USB connect), and the signup / error events
  of users whose id ends in 9
* web log     = every other event (a page visit): signup / error events, and
  the purchases of users whose id ends in 0 to 3

Every event is in exactly one log.  The routing by user leaves some users
without device events and others without web events, so the outer join of the
logs meets missing sides.
* directory   = customers, one snapshot per month they were active; a negative
  balance means the person left before the last month; balances above 9000
  are also listed a second time as ``IT Admin`` in the last month
* vectors     = embeddings (64-d) with their ``label`` as ground truth
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Last digits of the users whose purchases go to the web log (below the first)
# and whose signup / error events go to the device log (the second).
FIRST_BUYER_DIGIT = 4
NO_WEB_DIGIT = 9
LAST_MONTH = 12
ADMIN_BALANCE = 9000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k(props: str = "props"):
    return F.regexp_extract(F.col(props), r"([0-9]+)", 1)


def event_source():
    """The log an event belongs to: ``logon``, ``device`` or ``http``; never null."""
    et, digit = F.col("event_type"), F.col("user_id") % 10
    return (F.when(et.isin("click", "view"), "logon")
            .when((et == "purchase") & (digit >= FIRST_BUYER_DIGIT), "device")
            .when(et.isin("signup", "error") & (digit == NO_WEB_DIGIT), "device")
            .otherwise("http"))


def logon_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the plain predicates beside the routing reach the scan
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return ev.where(event_source() == "logon").select(
        F.col("event_id").cast("string").alias("id"),
        F.date_format("ts", "MM/dd/yyyy HH:mm:ss").alias("date"),
        F.col("user_id").cast("string").alias("user"),
        F.concat(F.lit("PC-"), _k()).alias("pc"),
        F.when(F.col("event_type") == "click", "Logon").otherwise("Logoff").alias("activity"),
    )


def device_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup", "error"))
    return ev.where(event_source() == "device").select(
        F.col("event_id").cast("string").alias("id"),
        F.date_format("ts", "M/d/yyyy H:mm").alias("date"),
        F.col("user_id").cast("string").alias("user"),
        F.concat(F.lit("PC-"), _k()).alias("pc"),
        F.lit("Connect").alias("activity"),
    )


def http_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    et = F.col("event_type")
    ev = table(spark, sf_dir, "events").where(et.isNull() | ~et.isin("click", "view"))
    return ev.where(event_source() == "http").select(
        F.col("event_id").cast("string").alias("id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.col("user_id").cast("string").alias("user"),
        F.concat(F.lit("PC-"), _k()).alias("pc"),
        F.concat(F.lit("http://site"), _k(), F.lit(".example")).alias("url"),
    )


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three logs as one tagged stream ``(user, src, key, date, activity)``, one scan.

    Same rows as tagging and unioning :func:`logon_log`, :func:`device_log`
    and :func:`http_log`, but the events table is read once instead of three
    times.  Each row keeps the date spelling of its log.
    """
    ev = table(spark, sf_dir, "events")
    tagged = ev.select("ts", "user_id", "event_type", "props", event_source().alias("src"))
    s = F.col("src")
    return tagged.select(
        F.col("user_id").cast("string").alias("user"),
        s,
        F.when(s == "http", F.concat(F.lit("http://site"), _k(), F.lit(".example")))
        .otherwise(F.concat(F.lit("PC-"), _k())).alias("key"),
        F.when(s == "logon", F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
        .when(s == "device", F.date_format("ts", "M/d/yyyy H:mm"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("date"),
        F.when(F.col("event_type") == "click", "Logon")
        .when(F.col("event_type") == "view", "Logoff").alias("activity"),
    )


def activity_logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "logon": logon_log(spark, sf_dir),
        "device": device_log(spark, sf_dir),
        "http": http_log(spark, sf_dir),
    }


def directory_snapshots(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Monthly snapshots ``(employee_name, user_id, email, domain, role, snapshot)``.

    With ``partitions`` the people are dealt out before their months are listed.
    """
    c = table(spark, sf_dir, "customer")
    if partitions:
        c = c.select("c_name", "c_custkey", "c_acctbal", "c_mktsegment").repartition(partitions)
    last = F.when(
        F.col("c_acctbal") < 0,
        F.least(F.lit(LAST_MONTH - 1),
                F.lit(1) + F.floor(-F.col("c_acctbal") / 100).cast("int")),
    ).otherwise(F.lit(LAST_MONTH))
    person = [
        F.col("c_name").alias("employee_name"),
        F.col("c_custkey").cast("string").alias("user_id"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")),
                 F.lit("@corp.example")).alias("email"),
        F.lit("corp.example").alias("domain"),
    ]
    # one scan: each customer explodes into (role, month) entries, the admin
    # listing of the last month included
    entry = "struct<role:string,month:int>"
    monthly = F.transform(F.sequence(F.lit(1), last),
                          lambda m: F.struct(F.col("c_mktsegment").alias("role"),
                                             m.alias("month")).cast(entry))
    admin = F.when(F.col("c_acctbal") > ADMIN_BALANCE,
                   F.array(F.struct(F.lit("IT Admin").alias("role"),
                                    F.lit(LAST_MONTH).alias("month")).cast(entry))
                   ).otherwise(F.array().cast(f"array<{entry}>"))
    return (c.select(*person, F.explode(F.concat(monthly, admin)).alias("e"))
            .select("employee_name", "user_id", "email", "domain", "e.role",
                    F.concat(F.lit("LDAP-2010-"), F.lpad(F.col("e.month").cast("string"), 2, "0")).alias("snapshot")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, features array<double>, label)`` from the embeddings table."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id",
                    F.col("embedding").cast("array<double>").alias("features"),
                    "label")
