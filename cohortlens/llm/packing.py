"""Sum-of-squares online packing of tokenised documents into windows.

A level array counts the partially filled windows of every fill level.  Each
document goes to the level that keeps the sum of the squared counts least:
levels that fit together with what usually comes stay few, so gaps find their
match.  Documents of a window or more fill whole windows first.

Every partition packs its own rows in one pass and emits a window when it is
full, so nothing is shuffled; what is open in the end is put together by free
cuts.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stretches, by_bytes, cut_points

WINDOW = 1024
#: Id after every document.
END = 0
#: Open windows of a task at most (4 KB of ids each); beyond, they are put together by cuts.
OPEN_WINDOWS = 4096
#: Text bytes whose distinct words are tokenised together, and of words in one call.
SLICE_BYTES = 8 << 20
TEXT_BYTES = 1 << 15
#: Windows of one task come before those of the next.
TASK_SHIFT = 33


class Encoder:
    """A tokenizer file, for many texts at once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        vocabulary = self._tokenizer.get_vocab()
        # a byte-level token has one character a byte
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self._bytes[list(vocabulary.values())] = list(map(len, vocabulary))

    def _together(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches that lie one after the other, and where each stretch's ids end.

        Neighbours that no piece can join are encoded as one text.
        """
        joined = np.zeros(len(data) + 1, bool)
        joined[cut_points(data)] = True
        starts = edges[:-1]
        block = starts // TEXT_BYTES
        apart = ~joined[starts]
        apart[1:] |= block[1:] != block[:-1]
        apart[0] = True
        stops = np.append(starts[apart], edges[-1]).tolist()
        body = data.tobytes()
        texts = [body[a:b].decode() for a, b in zip(stops[:-1], stops[1:])]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(
            texts, add_special_tokens=False)])
        return ids, np.searchsorted(np.cumsum(self._bytes[ids]), edges[1:]) + 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids end.

        Every distinct stretch between cut points is encoded once.
        """
        found = Stretches(texts)
        if not len(found.words):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        return found.spread(*self._together(found.data, found.edges))


@functools.lru_cache(maxsize=1)
def load_encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Windows being filled; a piece is ``(doc, doc_tokens, start, ids)``.

    ``levels[h]`` counts the open windows that hold ``h`` ids.
    """

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window = window
        self.open_windows = open_windows
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.waiting = 0

    def level_for(self, size: int) -> int:
        """The fill level whose window takes ``size`` ids with the least sum of squared counts.

        Level 0 is a new window.  Ties go to the fullest window.
        """
        top = self.window - size
        counts = self.levels[:top + 1]
        # one window fewer at h, one more at h + size; full windows count nothing
        change = 2 * (self.levels[size:] - counts) + 2
        change[top] = 1 - 2 * counts[top]
        change[0] = 2 * self.levels[size] + 1
        usable = counts > 0
        usable[0] = True
        places = np.flatnonzero(usable)
        best = change[places]
        return int(places[len(best) - 1 - int(best[::-1].argmin())])

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        """Place one document; the windows that it fills."""
        total, start = len(ids), 0
        while total - start >= self.window:
            yield [(doc, total, start, ids[start:start + self.window])]
            start += self.window
        if start < total:
            yield from self._place((doc, total, start, ids[start:].copy()))

    def _place(self, piece) -> Iterator[list]:
        size = len(piece[3])
        level = self.level_for(size)
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.waiting -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            yield pieces
            return
        self._open(level + size, pieces)
        if self.waiting > self.open_windows:
            *full, last = self._together()
            yield from full
            if sum(len(p[3]) for p in last) == self.window:
                yield last
            else:
                self._open(sum(len(p[3]) for p in last), last)

    def _open(self, level: int, pieces: list) -> None:
        self.open[level].append(pieces)
        self.levels[level] += 1
        self.waiting += 1

    def _together(self) -> list[list]:
        """All open windows as full ones, and one last that may not be full: the emptiest are
        poured into the gaps of the fullest, cutting pieces where a gap ends."""
        queue = [pieces for level in self.open for pieces in level]  # emptiest first
        for level in self.open:
            level.clear()
        self.levels[:] = 0
        self.waiting = 0
        out, poured = [], []
        low, high = 0, len(queue)
        while low < high or poured:
            if high > low:
                high -= 1
                target = queue[high]
            else:
                target = []
            room = self.window - sum(len(p[3]) for p in target)
            while room:
                if not poured:
                    if low >= high:
                        break
                    poured = queue[low][::-1]
                    low += 1
                doc, total, start, ids = poured.pop()
                target.append((doc, total, start, ids[:room]))
                if len(ids) > room:
                    poured.append((doc, total, start + room, ids[room:]))
                room -= min(room, len(ids))
            out.append(target)
        return out

    def close(self) -> Iterator[list]:
        """What is still open: full windows, and the last one cut at powers of two, which need no padding."""
        if not self.waiting:
            return
        *full, last = self._together()
        yield from full
        rest, poured = sum(len(p[3]) for p in last), last[::-1]
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            target = []
            while room:
                doc, total, start, ids = poured.pop()
                target.append((doc, total, start, ids[:room]))
                if len(ids) > room:
                    poured.append((doc, total, start + room, ids[room:]))
                room -= min(room, len(ids))
            yield target


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, end_id: int = END) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``, one row per piece.

    ``ids`` are the little-endian 32-bit ids of the piece, ``start`` the ids of
    its document before it, ``offset`` those of its sequence.  ``path`` names a
    tokenizer file that the tasks can read; every document ends with
    ``end_id``.  Sequences hold ``window`` ids, but for the last few of a
    partition, whose lengths are powers of two.  Most documents stay whole.

    A null or empty text is the end id alone.  A null id is kept; rows that
    repeat an id are documents of their own; other columns are ignored; an
    empty table gives an empty result.  ``docs`` should be a stored table: a
    repeated task then meets the same rows and gives the same windows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << TASK_SHIFT
        encoder = load_encoder(path)
        packer = Packer(window)

        def emitted(windows: list[list]) -> pa.RecordBatch:
            nonlocal number
            pieces, sequences, offsets = [], [], []
            for w in windows:
                at = 0
                for p in w:
                    pieces.append(p)
                    sequences.append(number)
                    offsets.append(at)
                    at += len(p[3])
                number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pieces], kind), pa.array([p[2] for p in pieces], pa.int64()),
                 pa.array([len(p[3]) for p in pieces], pa.int64()),
                 pa.array([p[3].astype("<u4").tobytes() for p in pieces], pa.binary()),
                 pa.array([p[1] for p in pieces], pa.int64()), pa.array(sequences, pa.int64()),
                 pa.array(offsets, pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in by_bytes(batch, 1, SLICE_BYTES):
                ids, ends = encoder.encode(part.column(1))
                ready, begin = [], 0
                for name, end in zip(part.column(0).to_pylist(), ends.tolist()):
                    ready.extend(packer.add(name, np.append(ids[begin:end], np.uint32(end_id))))
                    begin = end
                    if len(ready) >= 512:
                        yield emitted(ready)
                        ready = []
                if ready:
                    yield emitted(ready)
        rest = list(packer.close())
        if rest:
            yield emitted(rest)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    name = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {name}, start long, length long, ids binary, doc_tokens long, "
                                "sequence_id long, offset long")
