"""Sinks for the labelled users (S8) and the metrics report.

A result is written to a staging path beside its place, read back and compared
with what was written by row count and checksum, and only then moved to its
place.  A reader never sees a half-written or damaged result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: CSV options of the labelled users, for writing and for reading back.
CSV_OPTIONS = {"header": "true", "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}


class SinkMismatch(RuntimeError):
    """What was read back is not what was written; the staging path is kept."""


def _seal(schema: T.StructType, blank_is_null: bool) -> list[Column]:
    """Row count and a checksum that does not depend on the order of rows."""
    hashed = F.xxhash64(*[
        F.nullif(F.col(f.name), F.lit("")) if blank_is_null and isinstance(f.dataType, T.StringType)
        else F.col(f.name) for f in schema.fields])
    return [F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum")]


def _publish(spark: SparkSession, staging: str, path: str) -> None:
    """Move ``staging`` to ``path``; what was there goes when the new result stands."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(staging), hadoop.Path(path)
    old = hadoop.Path(f"{path}.old-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    replaced = fs.exists(target) and fs.rename(target, old)
    if not fs.rename(source, target):
        if replaced:
            fs.rename(old, target)
        raise OSError(f"cannot move {staging} to {path}")
    if replaced:
        fs.delete(old, True)


def write_verified(df: DataFrame, path: str, write: Callable[[DataFrame, str], None],
                   read: Callable[[str], DataFrame], blank_is_null: bool = False) -> int:
    """Write ``df`` to ``path`` and return its row count; raises :class:`SinkMismatch` on a difference.

    The seal of what is written is observed in the write itself, so ``df`` is
    computed once; the read-back is one pass over the written files.
    ``blank_is_null`` is for forms that read an empty string back as null.
    """
    spark = df.sparkSession
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    seen = Observation()
    seal = _seal(df.schema, blank_is_null)
    write(df.observe(seen, *seal), staging)
    written = seen.get
    back = read(staging).agg(*seal).first().asDict()
    if back != written:
        raise SinkMismatch(f"{staging}: wrote {written}, read {back}")
    _publish(spark, staging, path)
    return written["rows"]


def write_labelled_users(df: DataFrame, path: str, fmt: str = "csv") -> int:
    """Write one row per user with its predictions, verified; returns the row count.

    The partition count is left to the plan (AQE coalesces small outputs), so
    every task writes its own part file; no single writer sees all users.
    CSV does not tell an empty string from a missing one: both come back null.
    """
    def write(rows: DataFrame, to: str) -> None:
        options = CSV_OPTIONS if fmt == "csv" else {}
        rows.write.format(fmt).options(**options).save(to)

    return write_verified(df, path, write, lambda at: read_labelled_users(df.sparkSession, at, df.schema, fmt),
                          blank_is_null=fmt == "csv")


def read_labelled_users(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """The labelled users of :func:`write_labelled_users`."""
    options = CSV_OPTIONS if fmt == "csv" else {}
    return spark.read.schema(schema).format(fmt).options(**options).load(path)


def _string_keys(metrics: DataFrame) -> DataFrame:
    out = metrics
    for f in metrics.schema.fields:
        if isinstance(f.dataType, T.MapType):
            out = out.withColumn(f.name, F.transform_keys(f.name, lambda k, v: k.cast("string")))
    return out


def write_metrics(metrics: DataFrame, path: str, form: str = "lines") -> int:
    """Metrics report (one row per method), verified; map keys become strings.

    ``form="lines"`` writes one JSON object a line, ``form="array"`` one JSON
    array in one line, methods in the order of the rows.  Missing values are
    left out of the objects.
    """
    if form not in ("lines", "array"):
        raise ValueError(f"unknown form {form!r}")
    # one row per method: a single small file
    rows = _string_keys(metrics).coalesce(1)
    record = F.struct(*[F.col(c) for c in rows.columns])
    if form == "lines":
        text = rows.select(F.to_json(record).alias("value"))
    else:
        text = rows.agg(F.to_json(F.collect_list(record)).alias("value"))
    return write_verified(text, path, lambda df, to: df.write.text(to),
                          lambda at: metrics.sparkSession.read.text(at))


def read_metrics(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of either form of :func:`write_metrics`; map keys stay strings."""
    fields = [T.StructField(f.name, T.MapType(T.StringType(), f.dataType.valueType)
                            if isinstance(f.dataType, T.MapType) else f.dataType, True) for f in schema.fields]
    return spark.read.schema(T.StructType(fields)).json(path)
