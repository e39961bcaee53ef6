"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  Its evidence are shape measures of the line and of
its two neighbours; a transition matrix ties neighbouring lines.  Marginals by
forward-backward, weighted with the line lengths, add up to the score of the
document.  The field is trained here by maximum likelihood in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

#: Text bytes that are measured together.
SLICE_BYTES = 2 << 20
#: Bound of the labelled documents the field is trained on.
FIT_DOCUMENTS = 2000
THRESHOLD = 0.7

_UPPER, _LOWER, _DIGIT, _SPACE, _POINT, _SHOUT, _SYMBOL, _HIGH = range(8)
_CLASSES = 8
_CLASS_OF = np.full(256, _SYMBOL, np.int64)
_CLASS_OF[ord("A"):ord("Z") + 1] = _UPPER
_CLASS_OF[ord("a"):ord("z") + 1] = _LOWER
_CLASS_OF[ord("0"):ord("9") + 1] = _DIGIT
_CLASS_OF[[9, 11, 12, 13, 32]] = _SPACE
_CLASS_OF[[ord(c) for c in ".,;:'\"()-?"]] = _POINT
_CLASS_OF[ord("!")] = _SHOUT
_CLASS_OF[128:] = _HIGH
_OWN = _CLASSES + 7


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """``(features, weights)`` of the lines that are not blank; one blank line if there is none."""
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()] or [""]
    raw = [x.encode() for x in lines]
    size = np.array([len(x) for x in raw])
    codes = _CLASS_OF[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw)), size)
    counts = np.bincount(owner * _CLASSES + codes,
                         minlength=len(raw) * _CLASSES).reshape(-1, _CLASSES)
    words = [x.split() for x in raw]
    n_words = np.array([len(w) for w in words])
    distinct = np.array([len(set(w)) for w in words])
    times = Counter(lines)
    repeats = np.array([times[x] for x in lines])
    length = np.maximum(size, 1)
    letters = np.maximum(counts[:, [_UPPER, _LOWER, _HIGH]].sum(axis=1), 1)
    many = np.maximum(n_words, 1)
    own = np.column_stack([
        counts / length[:, None],
        counts[:, _UPPER] / letters,
        np.log1p(size),
        np.log1p(n_words),
        (size - counts[:, _SPACE]) / many / 10,
        distinct / many,
        counts[:, _SYMBOL] / many,
        np.log(repeats)])
    own[size == 0] = 0
    zero = np.zeros((1, _OWN))
    return (np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero])]).astype(np.float32),
            np.maximum(size, 1).astype(np.float64))


@dataclass
class LineField:
    """Parameters: feature scaling, weights per state and transition scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    transition: np.ndarray

    def potentials(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights + self.bias


def _chains(lengths: np.ndarray):
    """Starts of the chains and, longest chain first, how many reach each step."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    reach = np.searchsorted(-lengths[order], -np.arange(lengths.max()), "left")
    return starts[order], reach


def forward_backward(potentials: np.ndarray, lengths: np.ndarray, transition: np.ndarray):
    """State marginals per line, and the expected transition counts; all chains step together."""
    starts, reach = _chains(lengths)
    local = np.exp(potentials - potentials.max(axis=1, keepdims=True))
    move = np.exp(transition)
    alpha = local / local.sum(axis=1, keepdims=True)
    for t in range(1, len(reach)):
        at = starts[:reach[t]] + t
        a = (alpha[at - 1] @ move) * local[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones_like(alpha)
    for t in range(len(reach) - 1, 0, -1):
        at = starts[:reach[t]] + t
        b = (beta[at] * local[at]) @ move.T
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    marginals = alpha * beta
    marginals /= marginals.sum(axis=1, keepdims=True)
    last = np.zeros(len(alpha), bool)
    last[np.cumsum(lengths) - 1] = True
    here = np.flatnonzero(~last)
    pairs = alpha[here][:, :, None] * move * (local[here + 1] * beta[here + 1])[:, None, :]
    pairs /= np.maximum(pairs.sum(axis=(1, 2), keepdims=True), 1e-300)
    return marginals, pairs.sum(axis=0)


def fit_field(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = 120,
              rate: float = 0.1, decay: float = 1e-3) -> LineField:
    """Maximum likelihood by Adam; each line of a document bears the document's label."""
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale < 1e-6] = 1.0
    x = (features - mean) / scale
    state = np.repeat(labels, lengths)
    truth = np.eye(2)[state]
    last = np.zeros(len(state), bool)
    last[np.cumsum(lengths) - 1] = True
    here = np.flatnonzero(~last)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[here], state[here + 1]), 1)
    params = [np.zeros((x.shape[1], 2)), np.zeros(2), np.zeros((2, 2))]
    first, second = [0 * p for p in params], [0 * p for p in params]
    for t in range(1, steps + 1):
        marginals, expected = forward_backward(x @ params[0] + params[1], lengths, params[2])
        error = (truth - marginals) / len(x)
        grads = [x.T @ error - decay * params[0], error.sum(axis=0),
                 (seen - expected) / len(x) - 10 * decay * params[2]]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] + rate * (first[i] / (1 - 0.9 ** t)) / (
                np.sqrt(second[i] / (1 - 0.99 ** t)) + 1e-8)
    return LineField(mean, scale, *params)


def document_scores(field: LineField, texts) -> np.ndarray:
    """Length-weighted mean of the good-marginals of each text's lines."""
    parts = [line_features(t) for t in texts]
    if not parts:
        return np.empty(0)
    lengths = np.array([len(w) for _, w in parts])
    weights = np.concatenate([w for _, w in parts])
    good = forward_backward(field.potentials(np.vstack([f for f, _ in parts])), lengths,
                            field.transition)[0][:, 1]
    starts = np.cumsum(lengths) - lengths
    return np.add.reduceat(good * weights, starts) / np.add.reduceat(weights, starts)


def held_out(id_col):
    """Documents whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2,
                      F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", bound: int = FIT_DOCUMENTS) -> LineField:
    """Fit on at most ``bound`` labelled documents that are not held out (least id hashes first).

    The driver gets the line features of these documents only.  Without both
    labels the field is neutral: every line scores one half.
    """
    usable = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()
                           & ~held_out(F.col(id_col)))
              .groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(usable), "doc_id").select("doc_id", "text", "label"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, 1, SLICE_BYTES):
                parts = [line_features(v.as_py())[0] for v in some.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(2).cast(pa.int32()),
                     pa.array([len(p) for p in parts], pa.int32()),
                     pa.array([p.tobytes() for p in parts], pa.binary())],
                    names=["doc_id", "label", "lines", "body"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(measure, f"doc_id {kind}, label int, lines int, body binary").collect()
    got.sort(key=lambda r: (str(r["doc_id"]), bytes(r["body"])))
    y = np.array([r["label"] for r in got], np.int64)
    width = 3 * _OWN
    if len(set(y.tolist())) < 2:
        return LineField(np.zeros(width), np.ones(width), np.zeros((width, 2)), np.zeros(2),
                         np.zeros((2, 2)))
    features = np.vstack([np.frombuffer(r["body"], np.float32).reshape(-1, width) for r in got])
    return fit_field(features.astype(np.float64), np.array([r["lines"] for r in got]), y)


def score_documents(docs: DataFrame, field: LineField, id_col: str = "doc_id",
                    text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row, no shuffle.

    Null, empty and blank texts count as one blank line.  A null id is not
    held out.  Repeated rows get the same score each; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scorer = _scorer(field, threshold, 2)
    return rows.mapInArrow(scorer, f"doc_id {kind}, held_out boolean, score double, predicted int")


def _scorer(field: LineField, threshold: float, text_at: int, keep: bool = False):
    """Arrow function that adds score and prediction; with ``keep`` it passes all columns of
    documents that reach the threshold instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text_at, SLICE_BYTES):
                scores = document_scores(field, part.column(text_at).to_pylist())
                if keep:
                    yield part.filter(pa.array(scores >= threshold, pa.bool_()))
                    continue
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(scores, pa.float64()),
                     pa.array((scores >= threshold).astype(np.int32), pa.int32())],
                    names=["doc_id", "held_out", "score", "predicted"])

    return run


def keep_good(docs: DataFrame, field: LineField, text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns unchanged.

    Null, empty and blank texts are scored as one blank line; rows that repeat
    stay or go together; columns may have any names; an empty table gives an
    empty result.
    """
    return docs.mapInArrow(_scorer(field, threshold, docs.columns.index(text_col), keep=True),
                           docs.schema)
