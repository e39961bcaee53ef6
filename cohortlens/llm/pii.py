"""Personal data: fixed formats, and a character-level BiLSTM-CRF that adds spans.

The formats (e-mail, IP address, card, phone) are found by linear scans.  The
tagger reads every character of every text with a bidirectional LSTM and
decodes tags with a conditional random field; it is trained in numpy from
labelled spans.  A text is cut into overlapping windows; each character takes
its tag from the window in which it lies farthest from an edge, and the tags
of the whole text then give the spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + len(KINDS)
#: Bounds of the training set: documents, and windows cut from them.
FIT_DOCUMENTS = 1500
FIT_WINDOWS = 1200
FIT_LENGTH = 96
HIDDEN = 8
WINDOW, MARGIN = 512, 32
#: Windows that run together, which bounds the tagger's memory.
BATCH_WINDOWS = 2048
# -- fixed formats ------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind index, start, end)`` by kind, then start, in code points."""
    out = []
    if "@" in text:
        out += [(0, s, e) for s, e in _emails(text)]
    if _HAS_DIGIT.search(text):
        out += [(1, s, e) for s, e in _addresses(text)]
        out += [(2, s, e) for s, e in _cards(text)]
        out += [(3, s, e) for s, e in _phones(text)]
    return out


_HAS_DIGIT = re.compile("[0-9]")

# -- characters ---------------------------------------------------------------

_VOCABULARY = 130  # ASCII, other letters, the rest


def encode_chars(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(codes < 128, codes, np.where(codes < 0x2000, 128, 129)).astype(np.uint8)


# -- the tagger ---------------------------------------------------------------


@dataclass
class Tagger:
    """Two LSTMs (index 0 forward, 1 backward) over characters, and a tag CRF."""

    table: np.ndarray       # 2 x vocabulary x 4h: character part of the gates
    recurrent: np.ndarray   # 2 x h x 4h
    out: np.ndarray         # 2 x h x tags
    bias: np.ndarray        # tags
    transition: np.ndarray  # tags x tags

    def arrays(self) -> list[np.ndarray]:
        return [self.table, self.recurrent, self.out, self.bias, self.transition]


def new_tagger(seed: int = 7) -> Tagger:
    rng = np.random.default_rng(seed)
    h = HIDDEN
    table = rng.normal(0, 0.3, (2, _VOCABULARY, 4 * h))
    table[:, :, h:2 * h] += 1.0  # forget gates start open
    bias = np.zeros(TAGS)
    bias[0] = 2.0
    return Tagger(table, rng.normal(0, 0.3, (2, h, 4 * h)), rng.normal(0, 0.3, (2, h, TAGS)),
                  bias, np.eye(TAGS) * 1.0)


def _squash(x):
    """The cells' activation: like tanh, but without an exponential per character and gate."""
    return x / (1 + np.abs(x))


def _run_lstm(table, recurrent, codes):
    """Hidden states of one direction, and what the backward pass needs; codes are time first."""
    steps, n = codes.shape
    h = recurrent.shape[0]
    hidden, cell = np.zeros((n, h)), np.zeros((n, h))
    kept = []
    for t in range(steps):
        z = _squash(table[codes[t]] + hidden @ recurrent)
        gates, new = 0.5 * z[:, :3 * h] + 0.5, z[:, 3 * h:]
        before, cell = cell, gates[:, h:2 * h] * cell + gates[:, :h] * new
        squashed = _squash(cell)
        kept.append((hidden, z, gates, before, squashed))
        hidden = gates[:, 2 * h:] * squashed
        kept[-1] += (hidden,)
    return kept


def _back_lstm(table, recurrent, codes, kept, up):
    """Gradients of the table and the recurrent weights, given those of the hidden states."""
    h = recurrent.shape[0]
    d_table, d_rec = np.zeros_like(table), np.zeros_like(recurrent)
    d_hidden = d_cell = 0.0
    for t in range(len(kept) - 1, -1, -1):
        previous, z, gates, before, squashed, _ = kept[t]
        dh = up[t] + d_hidden
        dc = dh * gates[:, 2 * h:] * (1 - np.abs(squashed)) ** 2 + d_cell
        dz = np.hstack([0.5 * dc * z[:, 3 * h:], 0.5 * dc * before, 0.5 * dh * squashed,
                        dc * gates[:, :h]]) * (1 - np.abs(z)) ** 2
        d_cell = dc * gates[:, h:2 * h]
        d_hidden = dz @ recurrent.T
        d_rec += previous.T @ dz
        np.add.at(d_table, codes[t], dz)
    return d_table, d_rec


def _crf_gradient(scores, tags, transition):
    """Gradients of the tag log-likelihood for emission scores (time, n, tags)."""
    steps, n, _ = scores.shape
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)

    def log_sum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = log_sum(alpha[t - 1][:, :, None] + transition, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = log_sum(transition + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    whole = log_sum(alpha[-1], 1)
    marginals = np.exp(alpha + beta - whole[:, None])
    d_scores = np.eye(TAGS)[tags] - marginals
    d_move = np.zeros_like(transition)
    for t in range(1, steps):
        joint = (alpha[t - 1][:, :, None] + transition
                 + (scores[t] + beta[t])[:, None, :] - whole[:, None, None])
        d_move -= np.exp(joint).sum(axis=0)
    np.add.at(d_move, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    return d_scores, d_move


def fit_tagger(codes: np.ndarray, tags: np.ndarray, steps: int = 300, batch: int = 48,
               rate: float = 0.03, seed: int = 7) -> Tagger:
    """Maximum likelihood by Adam over windows ``codes, tags (windows, time)``."""
    tagger, rng = new_tagger(seed), np.random.default_rng(seed)
    params = tagger.arrays()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(codes), batch)
        ways = [codes[pick].T, codes[pick][:, ::-1].T]
        truth = tags[pick].T
        kept = [_run_lstm(tagger.table[d], tagger.recurrent[d], ways[d]) for d in (0, 1)]
        hidden = [np.stack([k[5] for k in kept[0]]), np.stack([k[5] for k in kept[1]])[::-1]]
        scores = hidden[0] @ tagger.out[0] + hidden[1] @ tagger.out[1] + tagger.bias
        d_scores, d_move = _crf_gradient(scores, truth, tagger.transition)
        grads = [np.zeros_like(p) for p in params]
        for d in (0, 1):
            up = d_scores @ tagger.out[d].T
            grads[0][d], grads[1][d] = _back_lstm(tagger.table[d], tagger.recurrent[d], ways[d],
                                                  kept[d], up if d == 0 else up[::-1])
            grads[2][d] = np.einsum("tnh,tnk->hk", hidden[d], d_scores)
        grads[3], grads[4] = d_scores.sum(axis=(0, 1)), d_move
        pace = rate * min(1.0, 2.0 * (1 - (step - 1) / steps))
        for p, g, a, b in zip(params, grads, first, second):
            g = np.clip(g / batch, -5, 5)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += pace * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)
    return tagger


class FastTagger:
    """The tagger in single precision for many windows at once."""

    def __init__(self, tagger: Tagger):
        self.table, self.recurrent, self.out, self.bias, self.transition = (
            x.astype(np.float32) for x in tagger.arrays())
        #: no tag but the first can pay where its lead is below minus this
        self.entry = float((self.transition - self.transition[0, 0]).max())

    def _direction(self, d: int, codes: np.ndarray, scores: np.ndarray, times) -> None:
        """Adds one direction's share to the scores (time, tags, n); gates lie in rows."""
        h, n = HIDDEN, codes.shape[1]
        table, recurrent, out = self.table[d], self.recurrent[d], self.out[d].T
        hidden, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
        drive, part = np.empty((n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32)
        z, size = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32)
        mixed, small = np.empty_like(cell), np.empty_like(cell)
        for t in times:
            np.take(table, codes[t], axis=0, out=drive, mode="clip")
            np.matmul(hidden.T, recurrent, out=part)
            drive += part
            np.copyto(z, drive.T)
            np.abs(z, out=size)
            size += 1
            z /= size
            gates = z[:3 * h]
            gates *= 0.5
            gates += 0.5
            cell *= z[h:2 * h]
            np.multiply(z[:h], z[3 * h:], out=mixed)
            cell += mixed
            np.abs(cell, out=small)
            small += 1
            np.divide(cell, small, out=small)
            np.multiply(z[2 * h:3 * h], small, out=hidden)
            scores[t] += out @ hidden

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags for windows ``(n, time)``.

        Where no tag can outweigh leaving the first one at any place of a
        window, the best path stays there, and Viterbi is not run.
        """
        timed = np.ascontiguousarray(codes.T)
        steps, n = timed.shape
        scores = np.empty((steps, TAGS, n), np.float32)
        scores[:] = self.bias[:, None]
        self._direction(0, timed, scores, range(steps))
        self._direction(1, timed, scores, range(steps - 1, -1, -1))
        lead = (scores[:, 1:].max(axis=1) - scores[:, 0]).max(axis=0)
        tags = np.zeros((n, steps), np.uint8)
        busy = np.flatnonzero(lead + self.entry > 0)
        if len(busy):
            tags[busy] = self._viterbi(scores[:, :, busy].transpose(0, 2, 1))
        return tags

    def _viterbi(self, scores: np.ndarray) -> np.ndarray:
        steps, n, _ = scores.shape
        best, back = scores[0], np.empty((steps, n, TAGS), np.uint8)
        for t in range(1, steps):
            paths = best[:, :, None] + self.transition
            back[t] = paths.argmax(axis=1)
            best = np.take_along_axis(paths, back[t][:, None, :].astype(np.intp), 1)[:, 0] + scores[t]
        tags = np.empty((steps, n), np.uint8)
        tags[-1] = best.argmax(axis=1)
        here = np.arange(n)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t, here, tags[t]]
        return tags.T


def tag_texts(fast: FastTagger, codes: list[np.ndarray]) -> list[np.ndarray]:
    """Tags of every character of every text: overlapping windows, decoded and reconciled."""
    tags = [np.zeros(len(c), np.uint8) for c in codes]
    jobs = []
    for i, c in enumerate(codes):
        start = 0
        while start < len(c):
            jobs.append((min(WINDOW, len(c) - start), i, start))
            if len(c) - start <= WINDOW:
                break
            start += WINDOW - 2 * MARGIN
    jobs.sort()  # windows of like length run together
    for s in range(0, len(jobs), BATCH_WINDOWS):
        part = jobs[s:s + BATCH_WINDOWS]
        block = np.full((len(part), part[-1][0]), ord("\n"), np.uint8)
        for row, (width, i, start) in enumerate(part):
            block[row, :width] = codes[i][start:start + width]
        found = fast.decode(block)
        for row in np.flatnonzero(found.any(axis=1)):
            width, i, start = part[row]
            # inside the margins the neighbouring window sees more
            a = start + (MARGIN if start else 0)
            b = len(codes[i]) if start + width == len(codes[i]) else start + width - MARGIN
            tags[i][a:b] = found[row, a - start:b - start]
    return tags


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """``(kind index, start, end)`` of the runs of one tag."""
    if not tags.any():
        return []
    cuts = np.flatnonzero(np.diff(tags.astype(np.int16))) + 1
    edges = [0, *cuts.tolist(), len(tags)]
    return [(int(tags[a]) - 1, a, b) for a, b in zip(edges[:-1], edges[1:]) if tags[a]]


def added_spans(text: str, base: list, tagged: list) -> list[tuple[int, int, int]]:
    """All spans inside a tagged run that read like its kind and touch no base span."""
    if not tagged:
        return []
    out = []
    for kind, start, end in tagged:
        while m := _SHAPE[kind].search(text, start, end):
            touched = [e for _, s, e in base if s < m.end() and m.start() < e]
            if not touched:
                out.append((kind, *m.span()))
            start = min(touched, default=m.end())
    return out


#: What an added span must look like inside the tagged stretch: written with
#: other separators, without the plus sign, or spelled out.
_SHAPE = (
    re.compile(r"\b[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+\b"),
    re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?: ?\[?\.\]? ?)[0-9]{1,3}){3}(?![\w.])"),
    re.compile(r"(?<!\w)[0-9]{4}(?:[ ./_-]?[0-9]{4}){3}(?!\w)"),
    re.compile(r"(?<!\w)(?:00[0-9]{1,3} ?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w)"),
)


def find_spans(fast: FastTagger, texts: list[str]) -> list[tuple[list, list]]:
    """Base spans and added spans of every text."""
    out = []
    tags = tag_texts(fast, [encode_chars(t) for t in texts])
    for text, tag in zip(texts, tags):
        base = base_spans(text)
        out.append((base, added_spans(text, base, tag_spans(tag))))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


# -- Spark --------------------------------------------------------------------


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          spans_col: str | None = None, bound: int = FIT_DOCUMENTS) -> Tagger:
    """Fit the tagger on labelled spans of at most ``bound`` documents (least id hashes first).

    ``spans_col`` holds labels as ``kind:start:end`` joined by commas; without
    it the fixed formats are the labels.  The driver gets windows of
    ``FIT_LENGTH`` characters around labels, as many without any, and never a
    text.
    """
    label = F.col(spans_col) if spans_col else F.lit(None).cast("string")
    ids = (docs.select(F.col(id_col).alias("doc_id")).distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), label.alias("spans"))
            .join(F.broadcast(ids), "doc_id").select("text", "spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                found = base_spans(text) if spans is None else [
                    (KINDS.index(k), int(a), int(b))
                    for k, a, b in (x.split(":") for x in spans.split(",") if x)]
                tags = np.zeros(len(text), np.uint8)
                for kind, a, b in found:
                    tags[a:b] = kind + 1
                codes = encode_chars(text)
                centres = [(a + b) // 2 + (17 * i) % 41 - 20 for i, (_, a, b) in enumerate(found)]
                for centre in [*centres[:20], len(text) // 3]:
                    a = max(0, min(centre - FIT_LENGTH // 2, len(text) - FIT_LENGTH))
                    code, tag = np.full(FIT_LENGTH, ord("\n"), np.uint8), np.zeros(FIT_LENGTH, np.uint8)
                    got = codes[a:a + FIT_LENGTH]
                    code[:len(got)], tag[:len(got)] = got, tags[a:a + FIT_LENGTH]
                    windows.append((code.tobytes(), tag.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([w[0] for w in windows], pa.binary()),
                 pa.array([w[1] for w in windows], pa.binary())], names=["codes", "tags"])

    got = (rows.mapInArrow(cut, "codes binary, tags binary").distinct()
           .orderBy(F.xxhash64("codes", "tags")).limit(FIT_WINDOWS).collect())
    if not got:
        return new_tagger()
    got.sort(key=lambda r: (bytes(r["codes"]), bytes(r["tags"])))
    codes = np.array([np.frombuffer(r["codes"], np.uint8) for r in got])
    return fit_tagger(codes, np.array([np.frombuffer(r["tags"], np.uint8) for r in got]))


def scan_documents(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)``, one row per input row.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind, then
    start.  A null or empty text has none; repeated rows are scanned each by
    itself; other columns are ignored; an empty table gives an empty result.
    No shuffle; memory is bounded by the windows that run together.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = FastTagger(tagger)
        for batch in batches:
            for part in _slices(batch, 1):
                found = find_spans(fast, [t or "" for t in part.column(1).to_pylist()])
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64())
                          for k in range(len(KINDS))]
                digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array(digests, pa.string()),
                     pa.array([joined(b + a) for b, a in found], pa.string()),
                     pa.array([len(a) for _, a in found], pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, "
                                "n_phone long, base_sha256 string, spans string, n_added long")


def _slices(batch: pa.RecordBatch, text_at: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``most`` bytes of text each."""
    sizes = [len(v.as_py() or "") for v in batch.column(text_at)]
    start, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def redact(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in angle brackets.

    Where spans overlap the union is replaced under the kind of the first.
    All other columns, of any names, and all rows stay, repeated ones too; a
    null or empty text stays as it is; an empty table gives an empty result.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = FastTagger(tagger)
        for batch in batches:
            for part in _slices(batch, at):
                texts = part.column(at).to_pylist()
                found = find_spans(fast, [t or "" for t in texts])
                new = [t if t is None else redacted(t, b + a) for t, (b, a) in zip(texts, found)]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def redacted(text: str, spans) -> str:
    out, done = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind]}>"]
        done = max(done, end)
    return "".join([*out, text[done:]]) if spans else text
