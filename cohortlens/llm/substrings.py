"""Exact substring deduplication with prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of a document.  Two equal windows
choose the same anchor: the smallest of the hashed word runs they hold.  So
only suffixes around anchors that occur twice can repeat, and the word run at
the anchor is the prefix that routes them to a memory-sized group.  The prefix
has variable length: where it is too frequent for one group, the suffixes are
first reduced in salted groups, and what is left is routed by the whole window.

A group's suffixes are sorted by their words; runs of neighbours with a common
prefix of at least a window are the deep internal nodes of its suffix tree,
and every suffix in such a node but the earliest starts a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, stored

WINDOW = 20
#: Words of an anchor run.
RUN = 5
#: Occurrences of a prefix up to which one group holds all of them.
GROUP_LIMIT = 4096
#: Suffixes sorted together (several small groups at a time).
BATCH_SUFFIXES = 100_000
_LAST = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space; ``bytes.split`` cuts at exactly those six characters."""
    return (text or "").encode().split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word run, and the anchor run of every window start."""
    runs = hashes[:len(hashes) - RUN + 1].copy()
    for i in range(1, RUN):
        runs = runs * _ODD + hashes[i:len(hashes) - RUN + 1 + i]
    runs ^= runs >> np.uint64(29)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    runs ^= runs >> np.uint64(32)
    per_window = np.lib.stride_tricks.sliding_window_view(runs, WINDOW - RUN + 1)
    return runs, per_window.argmin(axis=1) + np.arange(len(per_window))


def _profile(docs: DataFrame) -> DataFrame:
    """Word count, digest of all words and the anchors of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, keys, places = [], [], [], []
            for value in batch.column(2):
                words = words_of(value.as_py())
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) < WINDOW:
                    keys.append(np.empty(0, np.int64))
                    places.append(np.empty(0, np.int32))
                    continue
                runs, chosen = _anchors(_hashes(words))
                place = chosen[np.flatnonzero(np.diff(chosen, prepend=-1))]
                keys.append(runs[place].view(np.int64))
                places.append(place.astype(np.int32))
            ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
                 pa.array(shas, pa.string()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(places)))],
                names=["doc_id", "digest", "n_words", "all_sha256", "keys", "places"])

    return docs.select("doc_id", "digest", "text").mapInArrow(
        run, "doc_id long, digest binary, n_words long, all_sha256 string, "
             "keys array<long>, places array<int>")


def _segments(hit_docs: DataFrame, group_limit: int) -> DataFrame:
    """The word hashes around every repeated anchor, with the window starts that chose it.

    In: ``doc, first, text, hits array<struct<place, n>>``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("route", "salt", "hot", "doc", "first", "lo", "count", "words")}
            docs = batch.column(0).to_pylist()
            firsts = batch.column(1).to_pylist()
            for doc, first, text, hits in zip(docs, firsts, batch.column(2), batch.column(3)):
                hashes = _hashes(words_of(text.as_py()))
                runs, chosen = _anchors(hashes)
                hits = hits.as_py()
                place = np.array([h["place"] for h in hits])
                low = np.searchsorted(chosen, place, "left")
                high = np.searchsorted(chosen, place, "right")
                for h, p, lo, hi in zip(hits, place.tolist(), low.tolist(), high.tolist()):
                    salts = -(-h["n"] // group_limit)
                    out["route"].append(int(runs[p].view(np.int64)))
                    out["salt"].append(doc % salts)
                    out["hot"].append(salts > 1)
                    out["doc"].append(doc)
                    out["first"].append(first)
                    out["lo"].append(lo)
                    out["count"].append(hi - lo)
                    out["words"].append(hashes[lo:hi + WINDOW - 1].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=_SEGMENT_ARROW)

    return hit_docs.select("doc", "first", "text", "hits").mapInArrow(run, _SEGMENT_SCHEMA)


_SEGMENT_SCHEMA = ("route long, salt long, hot boolean, doc long, first long, lo int, "
                   "count int, words binary")
_SEGMENT_ARROW = pa.schema([("route", pa.int64()), ("salt", pa.int64()), ("hot", pa.bool_()),
                            ("doc", pa.int64()), ("first", pa.int64()), ("lo", pa.int32()),
                            ("count", pa.int32()), ("words", pa.binary())])


def _subtree(seg: dict[str, np.ndarray], words: list[bytes]):
    """Deep nodes of the suffix tree over all window starts of the segments.

    Returns per window start: segment, place, whether an earlier equal window
    exists, and whether it is the earliest of its node; then the words.
    """
    count = seg["count"]
    flat = np.frombuffer(b"".join(words), np.uint64)
    length = count + WINDOW - 1
    begin = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(count)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = seg["lo"][owner] + offset
    suffix = flat[(begin[owner] + offset)[:, None] + np.arange(WINDOW)]
    order = np.lexsort((place, seg["first"][owner],
                        *(suffix[:, i] for i in range(WINDOW - 1, -1, -1))))
    ranked, who, at = suffix[order], owner[order], place[order]
    # a neighbour pair with a common prefix of a whole window lies in one deep node
    deep = np.concatenate(([False], (ranked[1:] == ranked[:-1]).all(axis=1)))
    head = np.maximum.accumulate(np.where(deep, 0, np.arange(len(deep))))
    first = seg["first"][who]
    repeat = deep & ((first != first[head]) | (at != at[head]))
    return who, at, repeat, ~deep, ranked


def _find_repeats(segments: DataFrame, keep_hot: bool) -> DataFrame:
    """Intervals ``[lo, hi]`` of window starts with an earlier equal window.

    With ``keep_hot`` the earliest windows of salted groups come along
    (``words`` not null) for a second round.
    """
    columns = ["route", "salt", "hot", "doc", "first", "lo", "count", "words"]

    def solve(rows: pa.Table) -> pa.RecordBatch:
        seg = {k: rows[k].to_numpy() for k in ("doc", "first", "lo", "count", "hot")}
        who, at, repeat, head, ranked = _subtree(seg, rows["words"].to_pylist())
        back = np.lexsort((at[repeat], who[repeat]))
        w, p = who[repeat][back], at[repeat][back]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(w) != 0) | (np.diff(p) != 1)))
                             if len(w) else [])
        last = np.append(new[1:], len(w)) - 1 if len(new) else new
        doc, first = [seg["doc"][w[new]]], [seg["first"][w[new]]]
        lo, hi, body = [p[new]], [p[last]], [None] * len(new)
        if keep_hot:
            left = np.flatnonzero(head & seg["hot"][who])
            doc.append(seg["doc"][who[left]])
            first.append(seg["first"][who[left]])
            lo.append(at[left])
            hi.append(at[left])
            body += [ranked[i].tobytes() for i in left]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(doc)), pa.array(np.concatenate(first)),
             pa.array(np.concatenate(lo).astype(np.int32)),
             pa.array(np.concatenate(hi).astype(np.int32)), pa.array(body, pa.binary())],
            names=["doc", "first", "lo", "hi", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, suffixes = [], 0
        for batch in batches:
            waiting.append(batch)
            suffixes += pa.compute.sum(batch["count"]).as_py() or 0
            if suffixes < BATCH_SUFFIXES:
                continue
            rows = pa.Table.from_batches(waiting)
            # the last group may go on in the next batch
            route, salt = rows["route"].to_numpy(), rows["salt"].to_numpy()
            change = np.flatnonzero((route[1:] != route[:-1]) | (salt[1:] != salt[:-1]))
            if len(change) == 0:
                continue
            cut = int(change[-1]) + 1
            yield solve(rows.slice(0, cut))
            waiting = rows.slice(cut).to_batches()
            suffixes = int(rows["count"].slice(cut).to_numpy().sum())
        if waiting:
            rows = pa.Table.from_batches(waiting)
            if len(rows):
                yield solve(rows)

    return (segments.select(*columns).repartition("route", "salt")
            .sortWithinPartitions("route", "salt")
            .mapInArrow(run, "doc long, first long, lo int, hi int, words binary"))


def _cut(hit_docs: DataFrame) -> DataFrame:
    """``(digest, n_removed, kept_sha256)`` from ``(digest, text, repeats)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for text, repeats in zip(batch.column(1), batch.column(2)):
                words = words_of(text.as_py())
                step = np.zeros(len(words) + 1, np.int64)
                for r in repeats.as_py():
                    step[r["lo"]] += 1
                    step[r["hi"] + WINDOW] -= 1
                cover = np.cumsum(step[:-1]) > 0
                removed.append(int(cover.sum()))
                kept = b" ".join(w for w, c in zip(words, cover.tolist()) if not c)
                shas.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
                names=["digest", "n_removed", "kept_sha256"])

    return hit_docs.select("digest", "text", "repeats").mapInArrow(
        run, "digest binary, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``, one row per input row.

    Removed is every word covered by a window that also starts earlier (in a
    document of smaller id, or earlier in the same one).  Equal texts are one
    class: its smallest id takes part in the search, every other copy of at
    least a window repeats it entirely.

    A null text has no words and texts shorter than a window lose none.  A
    null id comes after every other.  Rows that repeat an id with its text are
    one document listed twice and get the same result; with equal id and
    another text, neither is earlier at the same start.  Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("first"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("digest"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    profile = stored(_profile(rows), "profiles")
    profile = profile.withColumn("first", F.coalesce("doc_id", F.lit(_LAST)))
    classes = stored(profile.groupBy("digest").agg(F.min("first").alias("holder"),
                                                   F.count(F.lit(1)).alias("copies")), "classes")
    several = classes.where("copies > 1").select("digest", "holder")
    holders = (profile.where(F.size("keys") > 0).join(several, "digest", "left")
               .where("holder is null or holder = first")
               .select(F.xxhash64("digest").alias("doc"), "first",
                       F.explode(F.arrays_zip("keys", "places")).alias("a"))
               .select("doc", "first", F.col("a.keys").alias("key"), F.col("a.places").alias("place")))
    anchors = stored(holders, "anchors")
    free_shuffles(docs.sparkSession)
    frequent = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = (anchors.join(frequent, "key")
            .groupBy("doc", "first").agg(F.collect_list(F.struct("place", "n")).alias("hits")))
    hits = stored(hits, "hits")
    free_shuffles(docs.sparkSession)
    keyed = rows.withColumn("doc", F.xxhash64("digest"))
    segments = stored(_segments(keyed.join(hits, ["doc", "first"]), group_limit), "segments")
    free_shuffles(docs.sparkSession)
    found = stored(_find_repeats(segments, keep_hot=True), "repeats")
    # what is left of the frequent prefixes: the prefix grows to the whole window
    again = found.where("words is not null").select(
        F.xxhash64("words").alias("route"), F.lit(0).cast("long").alias("salt"),
        F.lit(False).alias("hot"), "doc", "first", "lo", F.lit(1).alias("count"), "words")
    repeats = (found.where("words is null").select("doc", "first", "lo", "hi")
               .unionByName(_find_repeats(again, keep_hot=False).select("doc", "first", "lo", "hi"))
               .groupBy("doc", "first").agg(F.collect_list(F.struct("lo", "hi")).alias("repeats")))
    cut = stored(_cut(keyed.join(stored(repeats, "intervals"), ["doc", "first"])), "cut")
    free_shuffles(docs.sparkSession)
    per_class = classes.join(cut.dropDuplicates(["digest"]), "digest", "left")
    empty = hashlib.sha256(b"").hexdigest()
    copy = (F.col("first") != F.col("holder")) & (F.col("n_words") >= WINDOW)
    held = F.col("first") == F.col("holder")
    return (profile.select("doc_id", "first", "digest", "n_words", "all_sha256")
            .join(per_class, "digest", "left")
            .select("doc_id", "n_words",
                    F.when(copy, F.col("n_words"))
                    .otherwise(F.when(held, F.coalesce("n_removed", F.lit(0))).otherwise(0))
                    .alias("n_removed"),
                    F.when(copy, F.lit(empty))
                    .otherwise(F.when(held, F.coalesce("kept_sha256", "all_sha256"))
                               .otherwise(F.col("all_sha256"))).alias("kept_sha256")))
