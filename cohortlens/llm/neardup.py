"""Near-duplicate groups by b-bit MinHash.

Of each of ``HASHES`` minima only the low ``BITS`` bits are kept, packed into
long integers.  Bands over the full minima give candidates; the packed
signatures estimate their similarity by bit counts, corrected for the low bits
that agree by chance, and only likely pairs are confirmed on the full shingle
sets.  Documents with one set are one class from the start.

Candidates never are all pairs of a bucket.  First every class is paired with
one head of its buckets, and linked.  Then only buckets whose members still lie
in several components are looked at, in blocks: first every class tries its
likeliest partner in another component, a share of the buckets at a time so that
each share meets the components the shares before it have put together, and in
the end all pairs that still lie across components and that the estimate lets
through come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, free_shuffles, stored
from .components import components

SHINGLE_WORDS = 5
PERCENT = 75
#: 48 bands of 5 minima miss a pair at 0.75 with probability 2e-6.
BANDS, BAND_ROWS = 48, 5
HASHES = BANDS * BAND_ROWS
BITS = 2
PER_LONG = 64 // BITS
LONGS = -(-HASHES // PER_LONG)
#: The estimate's standard error at 0.75 is 0.034; five of them, beyond which a pair is with 3e-7.
SLACK = 0.17
#: Estimate from which a pair is tried before all that may link are looked at: two errors below.
LIKELY = 0.68
#: Below this many shingles the same few win many minima, whose low bits agree all
#: or never, and the estimate can be off by any amount: such pairs are confirmed always.
SMALL = 64
#: Turns in which every class tries its likeliest partner in another component; each has
#: its share of the buckets.
NEAREST_TURNS = 3
BLOCK = 512
#: Text bytes whose sets are held together, and likeliest partners before they are reduced.
SLICE_BYTES = 4 << 20
PARTNERS = 100_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PAIR_BITS = 0x5555555555555555

_rng = np.random.default_rng(20240501)
_MULTIPLIERS = (_rng.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_OFFSETS = _rng.integers(0, 1 << 32, HASHES, np.uint32)[:, None]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (its whole sequence, if shorter)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE_WORDS, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(31))) * _GOLD + hashes[i:i + count]
    out ^= out >> np.uint64(32)
    return np.unique(out * _GOLD)


def minima(sets: np.ndarray) -> np.ndarray:
    """Least value of every hash function over a set."""
    low = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        out = np.minimum(out, (_MULTIPLIERS * low[i:i + 1024] + _OFFSETS).min(axis=1))
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
    for column in least.reshape(BANDS, BAND_ROWS).astype(np.uint64).T:
        keys = (keys ^ (keys >> np.uint64(29)) ^ column) * _GOLD
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    bits = np.zeros(LONGS * PER_LONG, np.uint64)
    bits[:HASHES] = least & np.uint32((1 << BITS) - 1)
    shifts = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(bits.reshape(LONGS, PER_LONG) << shifts, axis=1).view(np.int64)


def _profile(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, SLICE_BYTES):
                counts, names, signatures, bands = [], [], [], []
                for value in part.column(1):
                    sets = shingles(value.as_py())
                    counts.append(len(sets))
                    if not len(sets):
                        names.append((None, None))
                        signatures.append(None)
                        bands.append(None)
                        continue
                    least = minima(sets)
                    names.append(set_name(sets))
                    signatures.append(packed(least))
                    bands.append(band_keys(least))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(counts, pa.int64()),
                     *[pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)],
                     pa.array(signatures, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n", *NAME, "sig", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        run, f"doc_id {kind}, text_key long, n long, name_high long, name_low long, sig array<long>, "
             "bands array<long>")


#: Columns of a set's 128-bit name; among 10^10 sets two share one with 1e-19.
NAME = ["name_high", "name_low"]


def set_name(sets: np.ndarray) -> tuple[int, int]:
    """128-bit name of a shingle set, as two signed halves."""
    body = xxhash.xxh3_128_digest(sets.tobytes())
    return tuple(int.from_bytes(body[i:i + 8], "big", signed=True) for i in (0, 8))


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 0, SLICE_BYTES):
                found = [shingles(v.as_py()) for v in part.column(0)]
                names = [set_name(s) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)],
                     pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                    names=[*NAME, "set"])

    return docs.select("text").mapInArrow(run, "name_high long, name_low long, set array<long>")


def _shared_bands(classes: DataFrame) -> DataFrame:
    """``(class, band)`` of the buckets that hold more than one class; stored.

    The only shuffle of all band rows; every later step reads what is left.
    """
    rows = classes.select("class", F.explode("bands").alias("band"))
    several = rows.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("band")
    return stored(rows.join(several, "band").select("class", "band"), "bands")


def _needed_sets(classes: DataFrame, shared: DataFrame, texts: DataFrame) -> DataFrame:
    """``(class, set)`` of the classes that share a bucket with another class."""
    needed = stored(classes.select("class", *NAME, "doc_id").join(shared.select("class").distinct(), "class"),
                    "needed")
    # ids alone: a small table that can be sent to the texts for longer
    holders = stored(needed.select("doc_id").distinct(), "holders")
    return (_sets(texts.join(holders, F.col("id").eqNullSafe(F.col("doc_id"))))
            .join(needed.select("class", *NAME), NAME).dropDuplicates(NAME).select("class", "set"))


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity of two packed signatures, by bit counts."""
    differ = F.lit(0)
    for i in range(LONGS):
        x = a[i].bitwiseXOR(b[i])
        for s in range(1, BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(a[i].bitwiseXOR(b[i]), s))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(_PAIR_BITS)))
    chance = 1.0 / (1 << BITS)
    return (1 - differ / HASHES - chance) / (1 - chance)


def _could_link(a: Column, b: Column) -> Column:
    """Set sizes that allow the similarity."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT)


def _star_pairs(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """One likely pair per class: with the likeliest of the classes that head its buckets."""
    heads = shared.groupBy("band").agg(F.min("class").alias("a"))
    pairs = (shared.join(heads, "band").where("class != a")
             .select("a", F.col("class").alias("b")).distinct())
    return (_estimated(pairs, classes).groupBy("b")
            .agg(F.max(F.struct("est", "a", "na", "nb")).alias("m"))
            .select("m.a", "b", "m.na", "m.nb", "m.est"))


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    left = classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    return (pairs.join(left, "a").join(right, "b").where(_could_link(F.col("na"), F.col("nb")))
            .select("a", "b", "na", "nb", estimate(F.col("sa"), F.col("sb")).alias("est"))
            .where(F.col("est") >= LIKELY))


def _dealt(classes: DataFrame, shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, dealt out by pairs of blocks.

    The members of a bucket's largest component are compared with the others only, so
    they are in blocks of their own (numbered -1, -2, ...) that never meet each other:
    while the others fill one block, rows grow with the members and not their square.
    """
    rows = (shared.join(roots.withColumnRenamed("node", "class"), "class", "left")
            .select("class", "band", F.coalesce("root", "class").alias("root")))
    mixed = (rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("m"))
             .groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m"),
                                  F.max(F.struct("m", "root")).alias("most")).where("parts > 1")
             .select("band", F.col("most.root").alias("largest"),
                     F.ceil(F.col("most.m") / BLOCK).cast("int").alias("nl"),
                     F.ceil((F.col("m") - F.col("most.m")) / BLOCK).cast("int").alias("nb")))
    large = F.col("root") == F.col("largest")
    own = (F.when(large, -1 - F.pmod(F.xxhash64("class"), F.col("nl")))
           .otherwise(F.pmod(F.xxhash64("class"), F.col("nb"))).cast("int"))
    return (rows.join(mixed, "band").withColumn("own", own)
            .join(classes.select("class", "n", "sig"), "class")
            .withColumn("other", F.explode(F.sequence(F.when(large, 0).otherwise(-F.col("nl")), F.col("nb") - 1)))
            .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    "own", "class", "n", "root", "sig"))


_PAIR = "who long, a long, b long, na long, nb long, est double"


def _best_partners(found: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """The likeliest partner of every class among those found so far."""
    rows = pa.concat_tables([pa.Table.from_batches([b]) for b in found])
    order = np.lexsort((-rows["est"].to_numpy(), rows["who"].to_numpy()))
    _, first = np.unique(rows["who"].to_numpy()[order], return_index=True)
    return rows.take(pa.array(order[first])).combine_chunks().to_batches()


def _in_blocks(dealt: DataFrame, exact: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if exact:
            yield from blocks(batches)
            return
        found, size = [], 0
        for pairs in blocks(batches):
            found.append(pairs)
            size += len(pairs)
            if size > PARTNERS:
                found = _best_partners(found)
                size = sum(map(len, found)) // 2
        if found:
            yield from _best_partners(found)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rows = t if rest is None else pa.concat_tables([rest, t])
            key = [rows[c].to_numpy() for c in ("band", "i", "j")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            edges = [0, *cuts.tolist()]
            for s, e in zip(edges[:-1], edges[1:]):
                yield from _block_pairs(rows.slice(s, e - s), exact)
            rest = rows.slice(edges[-1])
        if rest is not None and len(rest):
            yield from _block_pairs(rest, exact)

    return (dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
            .mapInArrow(run, _PAIR))


def _nearest_pairs(classes: DataFrame, shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Every class's likeliest partner in another component of its mixed buckets."""
    return (_in_blocks(_dealt(classes, shared, roots), exact=False)
            .groupBy("who").agg(F.max(F.struct("est", "a", "b", "na", "nb")).alias("m"))
            .select("m.*").dropDuplicates(["a", "b"]))


def _crossing_pairs(classes: DataFrame, shared: DataFrame, roots: DataFrame,
                    sets: DataFrame) -> DataFrame:
    """All pairs across components of mixed buckets that reach the similarity on 32-bit shingles.

    The sets travel with the members, so that no refuted pair leaves its block.
    Shorter hashes add to what two sets share, but fall together inside a set: the
    test allows for as many as the set that has fewer of these lost, so no link is
    lost, and the full sets confirm what comes out.
    """
    short = sets.select("class", F.transform("set", lambda x: F.shiftright(x, 32).cast("int")).alias("set"))
    return _in_blocks(_dealt(classes, shared, roots).join(short, "class"), exact=True).dropDuplicates(["a", "b"])


def _block_pairs(rows: pa.Table, exact: bool) -> Iterator[pa.RecordBatch]:
    """Likely pairs across components among one block, or between two blocks of a bucket."""
    if len(rows) < 2:
        return
    cls, n, root, own = (rows[c].to_numpy() for c in ("class", "n", "root", "own"))
    if (root == root[0]).all():
        return
    sig = rows["sig"].combine_chunks().flatten().to_numpy().reshape(len(rows), LONGS).view(np.uint64)
    two_blocks = rows["i"][0].as_py() != rows["j"][0].as_py()
    sets: dict[int, np.ndarray | frozenset] = {}

    def members(k: int):
        if k not in sets:
            values = rows["set"][k].values.to_numpy()
            sets[k] = frozenset(values.tolist()) if n[k] <= 1000 else np.unique(values)
        return sets[k]

    def shared(x: int, y: int) -> int:
        a, b = members(x), members(y)
        if isinstance(a, frozenset) and isinstance(b, frozenset):
            return len(a & b)
        a, b = (np.array(list(v), np.int32) if isinstance(v, frozenset) else v for v in (a, b))
        return len(np.intersect1d(a, b, assume_unique=True))

    for s in range(0, len(rows), 256):
        x = sig[s:s + 256, None, :] ^ sig[None, :, :]
        x = (x | (x >> np.uint64(1))) & np.uint64(_PAIR_BITS)
        differ = np.bitwise_count(x).sum(axis=2)
        est = (1 - differ / HASHES - 0.25) / 0.75
        small = np.minimum(n[s:s + 256, None], n[None, :])
        large = np.maximum(n[s:s + 256, None], n[None, :])
        likely = (est >= PERCENT / 100 - SLACK) | (small < SMALL) if exact else est >= LIKELY
        good = likely & (small * 100 >= large * PERCENT) & (root[s:s + 256, None] != root[None, :])
        if two_blocks:
            good &= own[s:s + 256, None] != own[None, :]
        if exact:
            good &= cls[s:s + 256, None] < cls[None, :]
            i, j = np.nonzero(good)
            both = np.array([shared(s + p, q) for p, q in zip(i.tolist(), j.tolist())], np.int64)
            # shared shingles that fall together do so in either set
            lost = np.array([min(n[s + p] - len(members(s + p)), n[q] - len(members(q)))
                             for p, q in zip(i.tolist(), j.tolist())], np.int64)
            hit = (both + lost) * 100 >= (n[s + i] + n[j] - both - lost) * PERCENT
            i, j = i[hit], j[hit]
        else:
            j = np.where(good, est, -1).argmax(axis=1)
            i = np.flatnonzero(good[np.arange(len(good)), j])
            j = j[i]
        if len(i):
            turn = cls[s + i] > cls[j]
            first, second = np.where(turn, j, s + i), np.where(turn, s + i, j)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[s + i]), pa.array(cls[first]), pa.array(cls[second]),
                 pa.array(n[first]), pa.array(n[second]), pa.array(est[i, j])],
                names=["who", "a", "b", "na", "nb", "est"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    left = sets.select(F.col("class").alias("a"), F.col("set").alias("xa"))
    right = sets.select(F.col("class").alias("b"), F.col("set").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    return (pairs.select("a", "b", "na", "nb").join(left, "a").join(right, "b")
            .where(both * 100 >= (F.col("na") + F.col("nb") - both) * PERCENT).select("a", "b"))


def _linked(pairs: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Roots after confirming the candidate pairs that lie across components."""
    links = stored(_confirmed(_across(pairs, roots), sets), "links")
    return roots if links.isEmpty() else _merged(roots, links)


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    out = pairs
    for c in ("a", "b"):
        out = (out.join(roots.select(F.col("node").alias(c), F.col("root").alias("root_" + c)), c, "left")
               .withColumn("root_" + c, F.coalesce("root_" + c, c)))
    return out


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    return _rooted(pairs, roots).where("root_a != root_b")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after adding links: components of the contracted graph, applied to all nodes."""
    linked = _rooted(links, roots).select(F.col("root_a").alias("u"), F.col("root_b").alias("v"))
    moved = components(linked).select(F.col("node").alias("root"), F.col("root").alias("new"))
    old = roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = moved.select(F.col("root").alias("node"), F.col("new").alias("root"))
    return stored(old.unionByName(fresh).where("node != root").distinct(), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, text_key, component)``, one row per input row.

    A link at 0.75 is missed with probability 2e-6 (no band in common), plus
    3e-7 where the estimate is off by more than five errors.

    Documents are linked at a Jaccard similarity of their 5-word shingle sets
    of 0.75 or more; ``component_id`` is the least id reachable.

    A null, empty or blank text has an empty set and is linked with nothing.
    A null id comes after every other one, and alone it is its own component.
    Rows that repeat an id and its text share a class, so each of them is kept
    if the id is the least.  Other columns are ignored; an empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    profile = stored(_profile(rows), "profiles")
    # the number is fixed by the copy that is written
    classes = stored(profile.where("name_high is not null").groupBy(*NAME).agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"),
        F.first("bands").alias("bands")).withColumn("class", F.monotonically_increasing_id()), "classes")
    texts = rows.withColumnRenamed("doc_id", "id").select("id", "text")
    none = classes.select(F.col("class").alias("node"), F.col("class").alias("root")).where("false")
    shared = _shared_bands(classes)
    free_shuffles(docs.sparkSession)
    sets = stored(_needed_sets(classes, shared, texts), "sets")
    free_shuffles(docs.sparkSession)
    roots = _linked(stored(_star_pairs(classes, shared), "pairs"), none, sets)
    for turn in range(NEAREST_TURNS):
        share = shared.where(F.pmod(F.xxhash64("band"), F.lit(NEAREST_TURNS)) == turn)
        near = stored(_nearest_pairs(classes, share, roots), "pairs")
        if not near.isEmpty():
            roots = _linked(near, roots, sets)
        free_shuffles(docs.sparkSession)
    roots = _linked(stored(_crossing_pairs(classes, shared, roots, sets), "pairs"), roots, sets)
    named = (classes.select("class", *NAME, "doc_id")
             .join(roots.withColumnRenamed("node", "class"), "class", "left")
             .withColumn("root", F.coalesce("root", "class")))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select(*NAME, "component_id", F.col("root").alias("component"))
    own = F.when(F.col("name_high").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (profile.select("doc_id", "text_key", "n", *NAME).join(named, NAME, "left")
            .select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                    F.col("doc_id").eqNullSafe(own).alias("kept"), "text_key", "component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, all columns unchanged.

    Of a group the row with the least id stays; among rows that repeat this id
    with several texts, the one whose text has the least hash.  Null, empty and
    blank texts stay; rows that repeat id and text stay once, null ids
    included.  The columns may have any names; an empty table gives an empty
    result.
    """
    kept = near_duplicates(docs, id_col, text_col).where("kept")
    best = (kept.where("component is not null").groupBy("component")
            .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("m"))
            .select("m.doc_id", "m.text_key"))
    stay = best.unionByName(kept.where("component is null").select("doc_id", "text_key").distinct())
    key, stay_id, stay_key = _unused(docs.columns, "text_key", "stay_id", "stay_key")
    stay = stay.select(F.col("doc_id").alias(stay_id), F.col("text_key").alias(stay_key))
    return (docs.withColumn(key, F.xxhash64(text_col))
            .join(stay, (F.col(key) == F.col(stay_key)) & F.col(id_col).eqNullSafe(F.col(stay_id)))
            .dropDuplicates([key, id_col]).select(*docs.columns))


def _unused(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has them (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out
