"""Byte-level BPE encoding and decoding with a segment tree.

A text is cut by the vocabulary's pattern; inside a piece, a segment tree over
the byte positions keeps the leftmost smallest pair rank.  A merge is a root
read and logarithmic point updates of the merged pair, its dead right half and
its left neighbour.  The vocabulary is read from a path and never copied.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stretches, by_bytes

#: White space of the pattern as Unicode defines it (fixed values), written
#: out because the standard library counts four control characters more.
_SPACE = "\\t-\\r \x85\xa0  -     　"
_CHUNKS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Text bytes whose distinct words are encoded together.
SLICE_BYTES = 8 << 20
#: Children of a tree node, and the key of a pair that cannot merge.
FAN = 32
NONE = 1 << 62


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one piece, merging the leftmost pair of least rank until none is left.

    The tree has ``FAN`` children a node: a point update takes the least of
    ``FAN`` keys on each of the log(n) levels above the leaf.
    """
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    if n < 2:
        raise KeyError(f"the vocabulary has no byte {piece!r}")
    shift = n.bit_length()
    mask = (1 << shift) - 1
    get = ranks.get
    # leaf i: rank of the pair that starts at i, then i, so that ties go left
    leaves = [NONE if (r := get(piece[i:i + 2])) is None else r << shift | i
              for i in range(n - 1)]
    leaves.append(NONE)
    levels = [leaves]
    while len(levels[-1]) > FAN:
        row = levels[-1]
        levels.append([min(row[i:i + FAN]) for i in range(0, len(row), FAN)])
    upper, top = levels[1:], levels[-1]

    def put(i: int, key: int) -> None:
        leaves[i] = key
        below = leaves
        for row in upper:
            i //= FAN
            key = min(below[i * FAN:i * FAN + FAN])
            if row[i] == key:
                return
            row[i] = key
            below = row

    after = list(range(1, n + 2))
    before = list(range(-1, n + 1))
    while (least := min(top)) != NONE:
        i = least & mask
        dead = after[i]
        end = after[dead]
        after[i] = end
        before[end] = i
        key = NONE
        if end < n and (r := get(piece[i:after[end]])) is not None:
            key = r << shift | i
        left = before[i]
        if upper:
            put(dead, NONE)
            put(i, key)
            if left >= 0:
                r = get(piece[left:end])
                put(left, NONE if r is None else r << shift | left)
        else:
            leaves[dead] = NONE
            leaves[i] = key
            if left >= 0:
                r = get(piece[left:end])
                leaves[left] = NONE if r is None else r << shift | left
    out, i = [], 0
    while i < n:
        end = after[i]
        out.append(ranks[piece[i:end]])
        i = end
    return tuple(out)


class Encoder:
    """Ranks and pattern of one Python process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.names = {v: str(v) for v in self.tokens}
        self._split = regex.compile(pattern)

    def _ids(self, text: str, pieces: dict[str, tuple[int, ...]]) -> Iterator[int]:
        for chunk in _CHUNKS.findall(text):
            for m in self._split.finditer(chunk):
                piece = m.group()
                ids = pieces.get(piece)
                if ids is None:
                    ids = pieces[piece] = merge_bytes(piece.encode(), self.ranks)
                yield from ids

    def encode(self, text: str) -> list[int]:
        """Token ids.  The text is first cut where no piece of the pattern can cross:
        before the one space in front of a word, and around other white space."""
        return list(self._ids(text, {}))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids end.

        Every distinct stretch between words is encoded once; nothing is kept
        between calls.
        """
        found = Stretches(texts)
        pieces: dict[str, tuple[int, ...]] = {}
        flat, stops = array("i"), []
        for word in found.words.to_pylist():
            flat.extend(self._ids(word.decode(), pieces))
            stops.append(len(flat))
        return found.spread(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32),
                            np.array(stops, np.int64))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load_encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file; read once per Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank)
                 for token, rank in (line.split() for line in f if line.strip())}
    return Encoder(ranks, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)``, one row per input row; a null text has no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, pattern)
        for batch in batches:
            for part in by_bytes(batch, 1, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _lists(*encoder.encode_all(part.column(1)))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, body binary)`` from ``(doc_id, ids)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, pattern)
        for batch in batches:
            bodies = [encoder.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())],
                                             names=["doc_id", "body"])

    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, body binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode, decode, digest; ``ids`` on demand.

    One row per input row, whole texts, no shuffle.  A null text counts as
    empty; very long texts and long runs without a space cost n log n; other
    columns are ignored; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, pattern)
        name = encoder.names.__getitem__
        for batch in batches:
            for part in by_bytes(batch, 1, SLICE_BYTES):
                flat, ends = encoder.encode_all(part.column(1))
                counts, id_hashes, body_hashes, begin = [], [], [], 0
                for end in ends.tolist():
                    ids = flat[begin:end].tolist()
                    begin = end
                    counts.append(len(ids))
                    id_hashes.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                    body_hashes.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()),
                     pa.array(body_hashes, pa.string()), *([_lists(flat, ends)] if with_ids else [])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:4 + with_ids])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, "
                                "decoded_sha256 string" + ", ids array<int>" * with_ids)


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
