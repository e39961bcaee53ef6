"""Fill-in-the-middle transformation with a learned rank index.

A text is cut at token boundaries.  All boundary offsets of a text are fitted
by straight segments whose error is bounded; the residual of every boundary is
kept in one byte.  A cut is then a segment search, a prediction and the
residual, which makes it exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers of prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
PLAIN_PERCENT = 50
SPM_PERCENT = 80
#: Largest distance of a boundary from its segment; with rounding a residual fits a byte.
ERROR = 126


@dataclass(frozen=True)
class RankIndex:
    """Segments over ``rank -> offset`` and the residual of every rank."""

    first_rank: np.ndarray
    first_offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, rank: int) -> int:
        k = int(np.searchsorted(self.first_rank, rank, side="right")) - 1
        return int(self.first_offset[k]) + round(float(self.slope[k]) * (rank - int(self.first_rank[k])))

    def offset(self, rank: int) -> int:
        """The exact offset of a boundary: what the segment predicts plus the residual."""
        return self.predict(rank) + int(self.residual[rank])


def fit_index(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """Fit ``offsets[rank]`` (not empty, growing) by segments that miss no offset by more than ``error``.

    A segment starts at an offset and narrows the cone of slopes that pass all
    later ones; it ends where the cone is empty.  The cone is narrowed for a
    stretch of ranks at a time.
    """
    total = len(offsets)
    ranks, slopes = [], []
    start = 0
    while start < total:
        low, high = -np.inf, np.inf
        end, width = start + 1, 256
        while end < total:
            stop = min(end + width, total)
            run = np.arange(end - start, stop - start)
            rise = offsets[end:stop] - offsets[start]
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            empty = lows > highs
            if empty.any():
                k = int(empty.argmax())
                if k:
                    low, high = lows[k - 1], highs[k - 1]
                end += k
                break
            low, high = lows[-1], highs[-1]
            end, width = stop, width * 2
        ranks.append(start)
        slopes.append((low + high) / 2 if np.isfinite(low) else 0.0)
        start = end
    first = np.array(ranks, np.int64)
    slope = np.array(slopes, np.float64)
    lengths = np.diff(np.append(first, total))
    along = np.arange(total) - np.repeat(first, lengths)
    predicted = np.repeat(offsets[first], lengths) + np.rint(np.repeat(slope, lengths) * along).astype(np.int64)
    residual = offsets - predicted
    small = np.int8 if error <= ERROR else np.int64
    return RankIndex(first, offsets[first], slope, residual.astype(small))


def boundaries(text: str) -> np.ndarray:
    """Code point offsets of all token boundaries, 0 and the end included.

    A token is white space and the word after it; white space at the end is a
    token of its own.
    """
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    last = ~space
    last[:-1] &= space[1:]
    ends = np.flatnonzero(last) + 1
    tail = [len(points)] if len(points) and space[-1] else []
    return np.concatenate([[0], ends, tail]).astype(np.int64)


def cut(text: str, draws: tuple[int, int]) -> tuple[int, int, int]:
    """``(tokens, end of the prefix, end of the middle)`` in code points for two random draws."""
    index = fit_index(boundaries(text))
    n = len(index.residual) - 1
    first, second = sorted(x % (n + 1) for x in draws)
    return n, index.offset(first), index.offset(second)


def _draw(digest: str, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row per input row.

    The draws are the first four 8-digit groups of sha256 of ``seed:doc_id``,
    so a row is cut alike in every run.  ``form`` is ``plain`` (the text as it
    is), ``psm`` or ``spm`` by the order of the parts in ``output``.

    A null text counts as empty; an empty text, and one that holds a marker,
    stays plain.  A null id draws like an empty one.  Rows that repeat an id
    and a text are cut alike; other columns are ignored; an empty table gives
    an empty result.  No shuffle; a text costs four bytes a character and one
    a token while it is cut.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist())
            cuts = [cut(text.as_py(), pair) for text, pair in zip(batch.column("body"), draws)]
            found = np.array(cuts, np.int64).reshape(len(cuts), 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("body"), batch.column("form"),
                 *map(pa.array, np.ascontiguousarray(found.T))],
                names=["doc_id", "body", "form", "n", "first", "second"])

    body = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"), digest.alias("digest"))
    plain = F.col("body") == ""
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("body", F.lit(marker))
    form = (F.when(plain | (_draw("digest", 2) % 100 >= plain_percent), "plain")
            .when(_draw("digest", 3) % 100 < spm_percent, "spm").otherwise("psm"))
    rows = rows.select("doc_id", "body", form.alias("form"), _draw("digest", 0).alias("h1"),
                       _draw("digest", 1).alias("h2"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"doc_id {kind}, body string, form string, n long, first long, second long")
    text = F.col("body")
    prefix = F.substr(text, F.lit(1), F.col("first").cast("int"))
    middle = F.substr(text, (F.col("first") + 1).cast("int"), (F.col("second") - F.col("first")).cast("int"))
    suffix = F.substr(text, (F.col("second") + 1).cast("int"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = (F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text))
    moved = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(moved, F.col("first")).alias("prefix_chars"),
                       F.when(moved, F.col("second") - F.col("first")).alias("middle_chars"),
                       output.alias("output"))


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output of :func:`fill_in_middle` was made from.

    A transformed text holds each marker once, so the parts lie between them.
    """
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def between(left: str, right: str) -> Column:
        rest = F.split_part(out, F.lit(left), F.lit(2))
        return F.split_part(rest, F.lit(right), F.lit(1))

    middle = F.split_part(out, F.lit(MIDDLE), F.lit(2))
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
            .otherwise(out))
