"""Helpers the operators share: the shared folder, stored tables, word rules."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A word is a run without the six ASCII white-space characters (fixed rule).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

TASKS_A_CORE = 4

#: First bytes of the characters beyond ASCII that may be white space (fixed values, UTF-8).
_LEADS = np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; an own one only on a local master without it."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    # Python file systems want the authority slashes that Hadoop leaves out
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read that copy.

    Cuts the lineage: a lost executor costs no earlier work, because the copy
    lives outside the executors.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_tasks(df: DataFrame) -> DataFrame:
    """``df`` in at most ``TASKS_A_CORE`` tasks a core, each with whole partitions one after the other.

    Nothing is shuffled and each partition keeps its rows and their order, so
    what was grouped or sorted in partitions still is.  A task with almost no
    rows costs as much as its Python worker, its file and its blocks for every
    later task, which many small partitions would each pay.
    """
    return df.coalesce(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of stages whose result is stored.

    They go when the driver collects its garbage, which a driver with little
    to do puts off for long.
    """
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_bytes(batch: pa.RecordBatch, text_at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``most`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    group = np.append(0, ends)[:-1] // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    return (batch.slice(a, b - a) for a, b in zip(edges[:-1], edges[1:]) if b > a)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Places of single spaces between a word's end and a word's start, in UTF-8 bytes.

    No piece of a byte-level pattern reaches across them, so the stretches
    between them can be encoded on their own.  Characters that may be white
    space beyond ASCII are left uncut.
    """
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    before, after = data[at - 1], data[at + 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    odd = (before >= 0x7F) & ((before == 0x7F) | np.isin(two, _LEADS) | np.isin(three, _LEADS))
    good = (before > 0x20) & ~odd & (after > 0x20) & (after != 0x7F) & ~np.isin(after, _LEADS)
    return at[good]


class Stretches:
    """The texts of a column cut at :func:`cut_points`, and their distinct stretches.

    ``words`` holds the distinct stretches one after the other, with their
    ``edges``; :meth:`spread` turns what was made of them into what belongs to
    the texts.
    """

    def __init__(self, texts: pa.Array):
        rows = pc.fill_null(texts, "").cast(pa.large_binary())
        ends = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset:rows.offset + len(rows) + 1]
        lo, hi = int(ends[0]), int(ends[-1])
        self._ends = ends - lo
        data = np.frombuffer(rows.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.empty(0, np.uint8)
        edge = np.zeros(len(data) + 1, bool)
        edge[cut_points(data)] = True
        edge[self._ends] = True
        self._edges = np.flatnonzero(edge).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(
            pa.binary(), max(0, len(self._edges) - 1),
            [None, pa.py_buffer(self._edges), pa.py_buffer(data)]).dictionary_encode()
        self.words, self._code = coded.dictionary, coded.indices.to_numpy()
        if len(self.words):
            self.edges = np.frombuffer(self.words.buffers()[1], np.int32)[:len(self.words) + 1].astype(np.int64)
            self.data = np.frombuffer(self.words.buffers()[2], np.uint8)[:self.edges[-1]]
        else:
            self.edges, self.data = np.zeros(1, np.int64), data

    def spread(self, flat: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all texts one after the other, and where each text's values end;
        ``stops`` tells where the values of each distinct stretch end in ``flat``."""
        begins = np.concatenate([[0], stops[:-1]]).astype(np.int64)
        counts = (stops - begins)[self._code]
        done = np.concatenate([[0], np.cumsum(counts)])
        take = np.repeat(begins[self._code] - done[:-1], counts)
        take += np.arange(len(take))
        return flat[take], done[np.searchsorted(self._edges, self._ends[1:])]
