"""A restartable run: finished stages are recorded in shared storage.

A run is named by its parameters and by the listing of its input (path, size
and time of every file), so changed input or parameters start a new run.  Each
stage leaves a record, tables beside it as Parquet.  A record is written after
its table, so a stage is either finished or done again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def input_listing(spark: SparkSession, paths: list[str]) -> str:
    """A digest of path, size and time of every file, taken by Spark; contents are not read."""
    files = spark.read.format("binaryFile").load(paths).select(
        F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s")).first()
    return f"{row['n']}:{row['s']}"


class Run:
    """The stages of one run below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, listing: str, parameters: dict):
        name = json.dumps([listing, parameters], sort_keys=True)
        self.spark = spark
        self.path = f"{folder.rstrip('/')}/run-{hashlib.sha256(name.encode()).hexdigest()[:16]}"

    def record(self, stage: str) -> dict | None:
        """What a finished stage left, None if it did not finish."""
        try:
            row = self.spark.read.schema("value string").parquet(f"{self.path}/{stage}").first()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return None if row is None else json.loads(row["value"])

    def finish(self, stage: str, value: dict) -> dict:
        body = json.dumps(value)
        (self.spark.createDataFrame([(body,)], "value string").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/{stage}"))
        return json.loads(body)

    def value(self, stage: str, compute: Callable[[], dict]) -> dict:
        """The record of a stage, computed if there is none."""
        found = self.record(stage)
        return self.finish(stage, compute()) if found is None else found

    def table(self, stage: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The table of a stage, computed and stored if the stage is not finished."""
        at = f"{self.path}/{stage}-table"
        if self.record(stage) is None:
            df = compute()
            df.write.mode("overwrite").parquet(at)
            self.finish(stage, {"schema": df.schema.json()})
        return self.spark.read.parquet(at)


class NoRun:
    """Stages without records: everything is computed."""

    def value(self, stage: str, compute: Callable[[], dict]) -> dict:
        return compute()
