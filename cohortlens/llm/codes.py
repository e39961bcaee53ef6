"""Vector code compression by integer Walsh-Hadamard transforms.

Vectors become integers and are cut into parts; every part is coded by the
nearest entry of its position's codebook.  Parts and entries are padded with
zeros to a power of two and transformed; the transform keeps squared distances
up to a known factor, so squared differences that are added up in the order of
sequency are lower bounds, and entries beyond the best distance leave early.
All arithmetic is on integers: 64-bit where a batch allows it, unbounded
otherwise.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Pairs of a row and an entry that are held at once.
PAIRS = 1 << 19
#: Labels whose sums are sent to every task at most; beyond, the join is salted.
BROADCAST_LABELS = 100_000
SALTS = 64


def hadamard(width: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows in the order of sequency (sign changes)."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < width:
        rows = np.block([[rows, rows], [rows, -rows]])
    changes = (rows[:, 1:] != rows[:, :-1]).sum(axis=1)
    return rows[np.argsort(changes)]


def padded_width(width: int) -> int:
    return 1 << max(0, (width - 1).bit_length())


def transform(parts: np.ndarray) -> np.ndarray:
    """Coefficients of every row of ``parts``, padded with zeros, in the order of sequency."""
    width = padded_width(parts.shape[1])
    room = np.zeros((len(parts), width), parts.dtype)
    room[:, :parts.shape[1]] = parts
    return room @ hadamard(width).astype(parts.dtype).T


def _narrow(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as 64-bit integers if no scaled squared distance can overflow, else as Python's."""
    width = padded_width(max(a.shape[1] for a in arrays))
    most = max((max(-int(a.min()), int(a.max())) for a in arrays if a.size), default=0)
    kind = np.int64 if 4 * width ** 3 * most ** 2 < 1 << 62 else object
    return [a.astype(kind) for a in arrays]


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every part (ties to the lower one) and the squared distance.

    The entry that is best by the first coefficient gives a bound; after every
    further coefficient the entries whose sum so far is beyond it leave.
    """
    parts, entries = _narrow(parts, entries)
    if not parts.shape[1]:
        return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    width = padded_width(parts.shape[1])
    coded, book = transform(parts), transform(entries)
    index = np.zeros(len(parts), np.int64)
    error = np.zeros(len(parts), parts.dtype)
    step = max(1, PAIRS // len(book))
    for low in range(0, len(parts), step):
        mine = coded[low:low + step]
        first = (mine[:, :1] - book[None, :, 0]) ** 2
        guess = first.argmin(axis=1)
        bound = ((mine - book[guess]) ** 2).sum(axis=1)
        row, entry = np.nonzero(first <= bound[:, None])
        total = first[row, entry]
        for k in range(1, width):
            total = total + (mine[row, k] - book[entry, k]) ** 2
            stays = (total <= bound[row]).astype(bool)
            row, entry, total = row[stays], entry[stays], total[stays]
        # rows come in order, and every row still has its guess
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(total, starts)
        hits = np.flatnonzero(total == np.repeat(least, np.diff(np.append(starts, len(row)))))
        _, where = np.unique(row[hits], return_index=True)
        index[low:low + step] = entry[hits[where]]
        error[low:low + step] = least // width
    return index, error


def integer_vectors(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(kept, values, lengths)`` of a list column: which rows take part, and their scaled components
    rounded down, one row after the other."""
    flat = column.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    # null lists have no values in the flattened column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    stops = np.cumsum(lengths)
    kept = column.is_valid().to_numpy(zero_copy_only=False) & (bad[stops] == bad[stops - lengths])
    mine = values[np.repeat(kept, lengths)]
    if not len(mine) or np.abs(mine).max() < 2.0 ** 44:
        return kept, np.floor(mine * scale).astype(np.int64), lengths[kept]
    # Python's floats have exact ratios, whatever their size
    exact = [(p * scale) // q for p, q in map(float.as_integer_ratio, mine.tolist())]
    return kept, np.array(exact, object), lengths[kept]


def _matrix(values: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Rows of equal width, shorter vectors followed by zeros."""
    if len(lengths) * width == len(values):
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def kept_width(vectors: DataFrame, parts: int = PARTS) -> int | None:
    """Common width of the vectors that take part, a multiple of ``parts``; None without any."""
    most = vectors.where(_takes_part()).agg(F.max(F.size("vector"))).first()[0]
    return None if most is None else parts * -(-most // parts)


def _takes_part():
    return F.col("vector").isNotNull() & F.coalesce(F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def first_codebooks(vectors: DataFrame, width: int, parts: int = PARTS,
                    entries: int = ENTRIES) -> list[np.ndarray]:
    """The codebook of every part position: the parts of the smallest ids, ascending.

    Equal ids are ordered by their vectors, null ids come last.
    """
    rows = (vectors.where(_takes_part()).orderBy(F.asc_nulls_last("id"), "vector")
            .limit(entries).select("vector").collect())
    column = pa.array([r[0] for r in rows], pa.list_(pa.float64()))
    _, values, lengths = integer_vectors(column)
    return np.split(_matrix(values, lengths, width), parts, axis=1)


def _assigned(batch: pa.RecordBatch, books: list[np.ndarray], width: int):
    """``(kept, per part: (parts, index, error))`` of a batch."""
    kept, values, lengths = integer_vectors(batch.column("vector"))
    cut = np.split(_matrix(values, lengths, width), len(books), axis=1)
    return kept, [(p, *nearest_entries(p, book)) for p, book in zip(cut, books)]


def next_codebooks(vectors: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, entries move to the floor of the mean.

    Tasks send one row per used entry with its integer sums (as text, since
    they may be of any size); those rows are dealt out by entry and added up.
    Entries without parts stay.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            _, cut = _assigned(batch, books, width)
            for part, (values, index, _) in enumerate(cut):
                order = np.argsort(index, kind="stable")
                used, starts, counts = np.unique(index[order], return_index=True, return_counts=True)
                if len(used):
                    totals = np.add.reduceat(values[order], starts, axis=0) if values.shape[1] else values[starts]
                    for e, n, t in zip(used.tolist(), counts.tolist(), totals.tolist()):
                        old = found.setdefault((part, e), [0, [0] * len(t)])
                        old[0] += n
                        old[1] = [a + b for a, b in zip(old[1], t)]
        yield _sum_rows(found)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                old = found.setdefault((r["part"], r["entry"]), [0, [0] * len(r["sums"])])
                old[0] += r["n"]
                old[1] = [a + int(b) for a, b in zip(old[1], r["sums"])]
        yield _sum_rows(found)

    schema = "part int, entry int, n long, sums array<string>"
    rows = (vectors.select("vector").mapInArrow(sums, schema).repartition("part", "entry")
            .mapInArrow(folded, schema).collect())
    moved = [book.astype(object) for book in books]
    for r in rows:
        moved[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return moved


def _sum_rows(found: dict[tuple[int, int], list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()),
         pa.array([v[0] for v in found.values()], pa.int64()),
         pa.array([list(map(str, v[1])) for v in found.values()], pa.list_(pa.string()))],
        names=["part", "entry", "n", "sums"])


def codebooks_digest(books: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for entry in book.tolist()
                                   for x in entry).encode()).hexdigest()


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (),
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``(id, *keep, code binary, error)`` of every vector that takes part, and the codebooks.

    ``code`` has one byte a part.  ``error`` is the squared distance of the
    integer vector to what the code stands for; null if beyond 64 bits.

    Vectors that are null or hold null or non-finite components take no part.
    Equal ids are rows of their own; a null id is kept.  Vectors shorter than
    the longest, and widths that the parts do not divide, are followed by
    zeros; with fewer rows than entries the codebooks are smaller; components
    of any finite size are exact.  Other columns are ignored; an empty table
    gives an empty result and empty codebooks.

    Each round is one pass over the vectors; the driver holds the codebooks
    only (``entries`` times the width).
    """
    if entries > 256:
        raise ValueError("an index must fit one byte")
    clash = {c: f"kept_{i}" for i, c in enumerate(keep)}
    vectors = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"),
                           *[F.col(c).alias(name) for c, name in clash.items()])
    width = kept_width(vectors, parts)
    books = [] if width is None else first_codebooks(vectors, width, parts, entries)
    for _ in range(rounds if books else 0):
        books = next_codebooks(vectors, books, width)
    names = ["id", *clash.values()]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, cut = _assigned(batch, books, width)
            codes = np.stack([index for _, index, _ in cut], axis=1).astype(np.uint8)
            error = sum(e.astype(object) if e.dtype == object else e for _, _, e in cut)
            if error.dtype == object:
                error = [e if e < 1 << 63 else None for e in error.tolist()]
            mask = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).filter(mask) for c in names],
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.int64())],
                names=[*names, "code", "error"])

    kinds = [f"{c} {vectors.schema[c].dataType.simpleString()}" for c in names]
    source = vectors if books else vectors.where(F.lit(False))
    out = source.mapInArrow(coded, ", ".join([*kinds, "code binary", "error long"]))
    return out.select("id", *[F.col(name).alias(c) for c, name in clash.items()], "code", "error"), books


def decompress(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The integer vectors that rows of part indexes stand for."""
    return np.concatenate([book[codes[:, p]] for p, book in enumerate(books)], axis=1)


def label_errors(coded: DataFrame, label: str) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over equal labels (nulls together).

    The sums are added up before the shuffle.  Few labels are broadcast; for
    more, the sums are repeated per salt, so the rows of one label are dealt
    out to many tasks.  A sum beyond 64 bits is null.
    """
    total = F.try_sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy(F.col(label).alias("sum_label")).agg(
        F.when(F.count(F.lit(1)) == F.count("error"), total).try_cast("long").alias("label_error"))
    same = F.col(label).eqNullSafe(F.col("sum_label"))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), same).drop("sum_label")
    salted = sums.withColumn("sum_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return (rows.join(salted, same & (F.col("salt") == F.col("sum_salt")))
            .drop("sum_label", "salt", "sum_salt"))
