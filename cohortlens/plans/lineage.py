"""Cutting lineage between expensive stages.

A reliable checkpoint goes to the shared folder the cluster names in
``spark.checkpoint.dir``; it survives lost executors and stops iterative
plans from growing.  Without that setting the DataFrame is persisted to
memory and disk instead (lost blocks are then recomputed from lineage).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def checkpoint_dir(spark) -> str | None:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    return None


def shared_path(spark, name: str) -> str:
    """A new path in the checkpoint folder; in an own folder only on a local master without one."""
    folder = checkpoint_dir(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cohortlens-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _already_stored(df: DataFrame) -> bool:
    """The caller persisted ``df`` already: keep that copy instead of a second one."""
    return df.storageLevel != StorageLevel.NONE


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and return a DataFrame that reads the stored result."""
    if _already_stored(df):
        return df
    if checkpoint_dir(df.sparkSession):
        return df.checkpoint(eager=True)
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def materialize_with(df: DataFrame, action):
    """:func:`materialize`, with ``action(stored)`` as the job that stores it.

    Returns ``(stored, action(stored))``.  Without a checkpoint folder the
    persisted copy is filled by ``action`` itself (it must read every
    partition, e.g. a global aggregate), which saves the separate count job.
    """
    if _already_stored(df):
        return df, action(df)
    if checkpoint_dir(df.sparkSession):
        stored = df.checkpoint(eager=True)
        return stored, action(stored)
    stored = df.persist(StorageLevel.MEMORY_AND_DISK)
    return stored, action(stored)


def release(df: DataFrame) -> None:
    """Drop a persisted copy (no-op for checkpointed data)."""
    if df.storageLevel != StorageLevel.NONE:
        df.unpersist()
