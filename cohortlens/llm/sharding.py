"""Sharding by jump consistent hashing.

A stable 64-bit key is mapped to one of ``n`` shards by the jump walk: no ring
table, O(log n) steps, and going from ``n`` to ``n + 1`` shards moves only the
rows that the new shard takes (about one in ``n + 1``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Constants of the published jump walk (fixed values).
JUMP_MULTIPLIER = 2862933555777941757
JUMP_SPAN = float(1 << 31)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every key, for all keys of a batch at once."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    bucket = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = jump[live]
        key[live] = key[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        draw = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[live] = ((bucket[live] + 1) * (JUMP_SPAN / draw)).astype(np.int64)
        live = live[jump[live] < shards]
    return bucket.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard number of a non-null 64-bit key column."""
    @F.pandas_udf("int")
    def walk(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards))

    return walk(key)


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id",
                    text_col: str = "text", rows_per_group: int = 50_000) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per input row.

    ``size`` is the UTF-8 length of the text plus 8, ``slot`` numbers the rows
    of a shard from 0 without gaps, ``grown_shard`` is the shard with one more
    shard.  Only ``(id, size, crc)`` travels.

    A shard is numbered in groups of about ``rows_per_group`` rows: the group
    sizes (a small table) give each group its first slot, and one task sorts
    one group, so no task holds a shard.

    Null ids share the shard of the null key; a null text has size 8 and
    checksum 0; an empty table gives an empty result; repeated rows get the
    same shard and slots of their own, and are spread over the groups.  Other
    columns are ignored.
    """
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    key = F.xxhash64(F.col(id_col))
    rows = stored(
        docs.select(F.col(id_col).alias("doc_id"),
                    (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
                    F.crc32(body).alias("text_crc32"),
                    key.alias("key"), F.monotonically_increasing_id().alias("row"))
        .withColumn("shard", shard_of(F.col("key"), shards))
        .withColumn("grown_shard", shard_of(F.col("key"), shards + 1)), "shards")
    groups = max(1, math.ceil(rows.count() / (shards * rows_per_group)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "row"), F.lit(groups)).cast("int"))
    sizes = rows.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    first = sizes.select("shard", "part",
                         F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    place = Window.partitionBy("shard", "part").orderBy("doc_id", "row")
    return (rows.join(first, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("first") + F.row_number().over(place) - 1).alias("slot"),
                    "grown_shard"))
