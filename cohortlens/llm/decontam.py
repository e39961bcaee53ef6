"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages, weighted by TF-IDF over hashed words
and projected on a latent basis from a distributed randomised factorisation of
all of them.  Passages whose cosine with a benchmark item is high are
candidates, and so is every other passage that holds enough of the item's rare
words for a leak; the longest common subsequence of words and a check of the
item's answer decide, so that edited passages are found too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Top bits of the word hash.
BUCKETS = 1 << 15
RANK, EXTRA = 96, 8
#: A passage is two blocks of words; neighbours share one.
BLOCK = 32
#: Rows that are gathered at once.
GATHERED = 2048
#: Characters of texts that are hashed at once.
TOGETHER = 1 << 15
#: Benchmark items that are searched for together.
ITEMS_TOGETHER = 5000
CANDIDATE = 0.55
#: Passages times pieces that are compared at once.
COMPARED = 1 << 22
#: Rare words of an item that a passage must hold where the cosine is lower, and the
#: bits of the word hash they are looked up by.
RARE, CODE_BITS = 3, 22
#: Share of an item's words found in order: alone enough, or with its answer.
LEAK, LEAK_WITH_ANSWER, ANSWER = 0.75, 0.6, 0.9

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
#: Bytes that belong to words once other characters than letters and digits are blanks.
_WORD_BYTE = bytes(b > 127 or chr(b).isalnum() for b in range(256))
#: Odd factor of the polynomial word hash and its inverse modulo 2^64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_POWERS, _INVERSES = _powers(_FACTOR, 1 << 17), _powers(_INVERSE, 1 << 17)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Words:
    """The words of a text as spans of bytes, with the hash bucket of each."""

    body: bytes
    starts: np.ndarray
    ends: np.ndarray
    buckets: np.ndarray
    codes: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def part(self, first: int, stop: int) -> list[str]:
        stop = min(stop, len(self))
        return _WORD.findall(self.body[self.starts[first]:self.ends[stop - 1]].decode())


def hashed_words(text: str | None) -> Words:
    """The words that ``words_of`` finds, hashed all at once instead of one by one."""
    return _hashed([(text or "").lower()])[0]


def hashed_together(texts: Iterable[str | None]) -> Iterator[list[Words]]:
    """``hashed_words`` of each text, for about ``TOGETHER`` characters of texts at once."""
    held, size = [], 0
    for text in texts:
        low = (text or "").lower()
        if held and size + len(low) > TOGETHER:
            yield _hashed(held)
            held, size = [], 0
        held.append(low)
        size += len(low)
    if held:
        yield _hashed(held)


def _hashed(lows: list[str]) -> list[Words]:
    whole = "".join(lows)
    if not whole.isascii():
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        odd = [c for c in map(chr, np.unique(points[points > 127]).tolist()) if not c.isalnum()]
        for i, low in enumerate(lows):
            if not low.isascii():
                for c in odd:
                    low = low.replace(c, " ")
                lows[i] = low
    bodies = [low.encode() for low in lows]
    body = b" ".join(bodies)
    data = np.frombuffer(body, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = np.frombuffer(body.translate(_WORD_BYTE), bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(data) <= len(_POWERS):
        powers, inverses = _POWERS, _INVERSES
    else:
        powers, inverses = _powers(_FACTOR, len(data)), _powers(_INVERSE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * powers[:len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverses[starts]
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    buckets = (hashes >> np.uint64(49)).astype(np.int64)
    codes = (hashes >> np.uint64(64 - CODE_BITS)).astype(np.int64)
    stops = np.searchsorted(starts, np.cumsum([len(b) + 1 for b in bodies])).tolist()
    return [Words(body, starts[a:b], ends[a:b], buckets[a:b], codes[a:b]) for a, b in zip([0, *stops], stops)]


def bucket_ids(words: list[str]) -> np.ndarray:
    return hashed_words(" ".join(words)).buckets


def cut_passages(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(ids, fresh)`` for every passage of every text, buckets as 16-bit numbers.

    The words whose bucket occurs for the first time in their text come first;
    ``fresh`` counts them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids, fresh = [], []
            for words in (x.buckets for many in hashed_together(batch.column(0).to_pylist()) for x in many):
                places = np.arange(len(words))
                last[words[::-1]] = places[::-1]
                new = last[words] == places  # one place of each bucket
                # of each passage, the new words first
                order = np.argsort(places // (2 * BLOCK) * 2 + ~new, kind="stable")
                body = words.astype(np.uint16)[order].tobytes()
                ids += [body[s:s + 4 * BLOCK] for s in range(0, len(body), 4 * BLOCK)]
                if len(words):
                    fresh.append(np.add.reduceat(new, np.arange(0, len(words), 2 * BLOCK), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(np.concatenate([np.empty(0, np.int32), *fresh]))],
                names=["ids", "fresh"])

    return texts.select(text_col).mapInArrow(run, "ids binary, fresh int")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all passages of a batch one after the other, and their edges."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if not len(column) or ends[-1] == ends[0]:
        return np.empty(0, np.uint16), np.zeros(len(column) + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(np.uint16)
    return flat, (ends - ends[0]).astype(np.int64) // 2


def document_frequency(passages: DataFrame) -> np.ndarray:
    """In how many texts each bucket occurs, from the passages of all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            flat, edges = _flat(batch.column(0))
            inside = np.arange(len(flat)) - np.repeat(edges[:-1], np.diff(edges))
            counts += np.bincount(flat[inside < np.repeat(batch.column(1).to_numpy(), np.diff(edges))],
                                  minlength=BUCKETS)
        here = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(counts[here])], names=["bucket", "n"])

    # one row per bucket, so at most BUCKETS rows reach the driver
    rows = (passages.select("ids", "fresh").mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def _added(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The sum of a table's rows at each row of places."""
    out = np.empty((len(places), 1, table.shape[1]), table.dtype)
    step = max(1, GATHERED // places.shape[1])
    one = np.ones((1, places.shape[1]), table.dtype)
    taken = np.empty((min(step, len(places)), *places.shape[1:], table.shape[1]), table.dtype)
    for s in range(0, len(places), step):
        here = places[s:s + step]
        np.take(table, here, axis=0, out=taken[:len(here)], mode="clip")
        # a product with ones adds faster than reduceat or sum
        np.matmul(one, taken[:len(here)], out=out[s:s + step])
    return out[:, 0]


def _normal_product(passages: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``A'(A right)`` for the TF-IDF matrix ``A`` of the passages, summed over partitions."""
    stripe = 2048
    width = right.shape[1]
    # a row of A is its words' idf times one factor, so words are only gathered and added
    right = np.vstack([right * idf[:, None], np.zeros((1, width))]).astype(np.float32)
    squares = idf ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, width), np.float32)
        for batch in batches:
            flat, edges = _flat(batch.column(0))
            if not len(flat):
                continue
            sizes = np.diff(edges)
            factor = batch.column(1).to_numpy() / np.maximum(
                np.sqrt(np.add.reduceat(squares[flat], edges[:-1])), 1e-9)
            words = np.full((len(sizes), 2 * BLOCK), BUCKETS, np.int64)
            words[np.arange(2 * BLOCK) < sizes[:, None]] = flat
            rows = np.zeros((len(sizes) + 1, width), np.float32)
            rows[:-1] = _added(right, words) * (factor ** 2).astype(np.float32)[:, None]
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(sizes)), sizes)[order]
            first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            count = np.diff(np.append(first, len(flat)))
            # the passages of a bucket by eights, the last ones filled with a row of zeros
            eights = -(-count // 8)
            begin = np.cumsum(eights) - eights
            holders = np.full(8 * int(eights.sum()), len(sizes), np.int64)
            holders[np.arange(len(flat)) + np.repeat(8 * begin - first, count)] = owner
            total[flat[first]] += np.add.reduceat(_added(rows, holders.reshape(-1, 8)), begin)
        total *= idf[:, None].astype(np.float32)
        parts = list(range(0, BUCKETS, stripe))
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int64()),
             pa.array([total[i:i + stripe].tobytes() for i in parts], pa.binary())],
            names=["stripe", "body"])

    def add(key, frame: pd.DataFrame) -> pd.DataFrame:
        body = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in frame["body"]).astype(np.float32)
        return pd.DataFrame({"stripe": [key[0]], "body": [body.tobytes()]})

    rows = (passages.select("ids", "weight").mapInArrow(run, "stripe long, body binary")
            .groupBy("stripe").applyInPandas(add, "stripe long, body binary").collect())
    out = np.zeros((BUCKETS, width), np.float32)
    for r in rows:
        out[r["stripe"]:r["stripe"] + stripe] = np.frombuffer(r["body"], np.float32).reshape(-1, width)
    return out


def latent_basis(passages: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (buckets x rank) by a randomised Nystroem approximation of ``A'A``.

    One pass over all passages.  Directions that the passages do not have are columns of zeros.
    """
    guess = np.random.default_rng(11).normal(size=(BUCKETS, rank + EXTRA)).astype(np.float32)
    seen = _normal_product(passages, idf, guess)
    values, turn = np.linalg.eigh((guess.T @ seen + seen.T @ guess).astype(np.float64) / 2)
    found = values > 1e-5 * max(values[-1], 1e-30)
    root = seen @ (turn[:, found] / np.sqrt(values[found])).astype(np.float32)
    values, turn = np.linalg.eigh((root.T @ root).astype(np.float64))
    best = np.argsort(-values)[:rank]
    best = best[values[best] > 1e-6 * max(values[-1:], default=0)]
    out = np.zeros((BUCKETS, rank), np.float32)
    out[:, :len(best)] = root @ (turn[:, best] / np.sqrt(values[best])).astype(np.float32)
    return out


@dataclass
class Item:
    item_id: object
    words: list[str]
    answer: list[str]


def make_item(item_id, text: str | None, answer: str | None = None) -> Item:
    """An item's words and its answer: the given one, else the last sentence (or third)."""
    words = words_of(text)
    if answer is None:
        sentences = [s for s in (words_of(x) for x in _SENTENCE.split(text or "")) if s]
        last = sentences[-1] if len(sentences) > 1 else words[-(len(words) // 3):]
        return Item(item_id, words, last if words else [])
    return Item(item_id, words, words_of(answer))


def common_words(first: list[str], second: list[str]) -> int:
    """Length of the longest common subsequence, with the first list as the bits of an integer."""
    places: dict[str, int] = {}
    for i, w in enumerate(first):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(first)) - 1
    row = full
    for w in second:
        hit = places.get(w)
        if hit:
            kept = row & hit
            row = ((row + kept) | (row - kept)) & full
    return len(first) - row.bit_count()


@dataclass
class RareWords:
    """The rare words of items: a passage without enough of them holds no leak.

    A leak has at least ``need`` of an item's ``m`` words in order, so at most
    ``m - need`` are missing, and of any ``m - need + RARE`` words at least
    ``RARE`` stand in the passage.  The rarest are taken.  No leak is lost,
    whatever the word statistics; hashes that fall together only add candidates.
    """

    known: np.ndarray    # by code
    codes: np.ndarray    # sorted
    offsets: np.ndarray  # of each code's items
    holders: np.ndarray
    least: np.ndarray    # words wanted of each item
    sizes: np.ndarray    # words of each item

    def stretches(self, texts: list[Words], passages: np.ndarray) -> list[list[list[int]]]:
        """For each text ``[item, first, last]`` passages around which enough rare words of an item stand."""
        out: list[list[list[int]]] = [[] for _ in texts]
        codes = np.concatenate([words.codes for words in texts])
        hits = np.flatnonzero(self.known[codes])
        if not len(hits):
            return out
        place = np.searchsorted(self.codes, codes[hits])
        count = self.offsets[place + 1] - self.offsets[place]
        ends = np.cumsum(count)
        item = self.holders[np.repeat(self.offsets[place] - (ends - count), count) + np.arange(ends[-1])]
        at = np.repeat(hits, count)
        stops = np.cumsum([len(words) for words in texts])
        text = np.searchsorted(stops, at, side="right")
        at = at - (stops - [len(words) for words in texts])[text]
        key = text * len(self.sizes) + item
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        item = key % len(self.sizes)
        last = np.arange(len(key)) + self.least[item] - 1
        inside = last < len(key)
        last = np.minimum(last, len(key) - 1)
        good = np.flatnonzero(inside & (key[last] == key))
        key, item, text = key[good], item[good], text[order][good]
        m = self.sizes[item]
        low = np.maximum((at[last[good]] - BLOCK - m) // BLOCK, 0)
        high = np.minimum((at[good] + m) // BLOCK, passages[text] - 1)
        good = low <= high
        for t, i, a, b in zip(*(x[good].tolist() for x in (text, item, low, high))):
            mine = out[t]
            if mine and mine[-1][0] == i and a <= mine[-1][2] + 1:
                mine[-1][2] = max(b, mine[-1][2])
            else:
                mine.append([i, a, b])
        return out


def rare_words(items: list[Item], idf: np.ndarray) -> RareWords:
    codes, holders, least = [], [], []
    for k, item in enumerate(items):
        words = hashed_words(" ".join(item.words))
        m = len(words)
        need = next(n for n in range(m + 1) if n >= LEAK_WITH_ANSWER * m)
        least.append(min(RARE, need))
        rarest = np.argsort(-idf[words.buckets], kind="stable")[:m - need + least[-1]]
        codes.append(np.unique(words.codes[rarest]))
        holders.append(np.full(len(codes[-1]), k))
    code = np.concatenate([np.empty(0, np.int64), *codes])
    holder = np.concatenate([np.empty(0, np.int64), *holders])
    order = np.argsort(code, kind="stable")
    found, first = np.unique(code[order], return_index=True)
    known = np.zeros(1 << CODE_BITS, bool)
    known[found] = True
    return RareWords(known, found, np.append(first, len(code)), holder[order], np.array(least, np.int64),
                     np.array([len(x.words) for x in items], np.int64))


@dataclass
class Searcher:
    """Projection of words, and the latent vectors and rare words of the items."""

    items: list[Item]
    projection: np.ndarray  # buckets x rank, idf included, and a last row of zeros
    pieces: np.ndarray      # pieces x rank, unit length
    owner: np.ndarray       # item of each piece
    buckets: list[np.ndarray]  # of each item's words
    rare: RareWords

    def leaks(self, text: str | None) -> list[tuple[int, int, bool]]:
        """``(item, common words, answer found)`` for every item found in the text.

        Of several passages that hold an item, the one with the most words in common counts.
        """
        return next(self.leaks_of([text]))

    def leaks_of(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int, int, bool]]]:
        """``leaks`` of each text."""
        for together in hashed_together(texts):
            yield from self.held(together)

    def held(self, texts: list[Words]) -> list[list[tuple[int, int, bool]]]:
        """``leaks`` of texts whose words are hashed."""
        if not len(self.pieces):
            return [[] for _ in texts]
        count = np.array([-(-len(words) // BLOCK) for words in texts])
        begin = np.cumsum(count) - count
        # every text's last block is filled with rows of zeros
        places = np.full(int(count.sum()) * BLOCK, BUCKETS, np.int64)
        for words, at in zip(texts, (begin * BLOCK).tolist()):
            places[at:at + len(words)] = words.buckets
        blocks = _added(self.projection, places.reshape(-1, BLOCK))
        # a passage is a block and the next one, or a text's only block
        many = np.where(count > 1, count - 1, count)
        first = np.arange(len(blocks))
        if len(blocks):
            first = first[np.repeat(count == 1, count) | (first != np.repeat(begin + count - 1, count))]
        passages = blocks[first]
        two = np.repeat(count > 1, many)
        passages[two] += blocks[first[two] + 1]
        size = np.maximum(np.sqrt(np.einsum("ij,ij->i", passages, passages)), 1e-9)[:, None]
        near: list[set] = [set() for _ in texts]
        stops = np.cumsum(many)
        # by stretches, so a long text against many pieces needs no more memory
        step = max(1, COMPARED // len(self.pieces))
        for s in range(0, len(passages), step):
            high = (passages[s:s + step] / size[s:s + step]) @ self.pieces.T >= CANDIDATE
            at, piece = np.divmod(np.flatnonzero(high), len(self.pieces))
            text = np.searchsorted(stops, at + s, side="right")
            for t, a, i in zip(text.tolist(), (at + s - (stops - many)[text]).tolist(), self.owner[piece].tolist()):
                near[t].add((i, a))
        rare = self.rare.stretches(texts, many)
        return [self._judged(*x) if x[1] or x[2] else [] for x in zip(texts, near, rare)]

    def _judged(self, words: Words, places: set[tuple[int, int]], stretches: list[list[int]]):
        """The items that the candidate passages of a text hold."""
        here = np.zeros(BUCKETS, bool)

        def possible(i: int, first: int, stop: int) -> bool:
            # no subsequence is longer than the item's words that occur at all, nor
            # are these more than those whose buckets occur
            around = words.buckets[max(0, first):stop]
            here[around] = True
            found = np.count_nonzero(here[self.buckets[i]])
            here[around] = False
            return found >= LEAK_WITH_ANSWER * len(self.items[i].words)

        for i, low, high in stretches:
            m = len(self.items[i].words)
            if possible(i, low * BLOCK - m, (high + 2) * BLOCK + m):
                places.update((i, at) for at in range(low, high + 1))
        best: dict[int, tuple[int, bool]] = {}
        for i, at in sorted(places):
            item = self.items[i]
            m = len(item.words)
            first, stop = max(0, at * BLOCK - m), (at + 2) * BLOCK + m
            if not possible(i, first, stop):
                continue
            region = words.part(first, stop)
            if sum(map(set(region).__contains__, item.words)) < LEAK_WITH_ANSWER * m:
                continue
            common = common_words(item.words, region)
            if common < LEAK_WITH_ANSWER * m:
                continue
            # an answer alone is no leak: as much of what stands before it must be there
            found = common_words(item.answer, region)
            answer = (bool(item.answer) and found >= ANSWER * len(item.answer)
                      and common - len(item.answer) >= LEAK_WITH_ANSWER * (m - len(item.answer)))
            if common >= LEAK * m or answer:
                best[i] = max(best.get(i, (0, False)), (common, answer))
        return [(i, common, answer) for i, (common, answer) in best.items()]


def fit_searchers(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  answer_col: str | None = None) -> list[Searcher]:
    """One searcher per ``ITEMS_TOGETHER`` items; the ids of documents take no part.

    Word statistics cover all documents; the basis is fitted on all passages of
    all documents and of all items, the latter weighted to count as much
    together as the documents.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"),
                             (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer"))
    rounds = -(-items.count() // ITEMS_TOGETHER)
    if not rounds:
        return []
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds))
    passages = stored(cut_passages(docs, text_col).withColumn("weight", F.lit(1.0))
                      .unionByName(cut_passages(items).withColumn("weight", F.lit(0.0))), "passages")
    frequency = document_frequency(passages.where("weight = 1"))
    # squared, because hashed rare words share buckets and would weigh too little
    idf = (np.log((docs.count() + 1) / (frequency + 1)) + 0.05) ** 2
    n = {r["weight"]: r["count"] for r in passages.groupBy("weight").count().collect()}
    even = (max(n.get(1.0, 0), 1) / max(n.get(0.0, 0), 1)) ** 0.5
    passages = passages.withColumn("weight", F.when(F.col("weight") == 0, F.lit(even)).otherwise(1.0))
    projection = np.pad(latent_basis(passages, idf) * idf[:, None].astype(np.float32), ((0, 1), (0, 0)))
    out = []
    for i in range(rounds):
        block = [make_item(r["item_id"], r["text"], r["answer"]) for r in items.where(part == i).collect()]
        block = sorted((x for x in block if x.words), key=lambda x: (str(x.item_id), x.words))
        pieces, owner, buckets = [], [], []
        for k, item in enumerate(block):
            buckets.append(bucket_ids(item.words))
            count = -(-len(item.words) // (BLOCK + BLOCK // 2))
            for piece in np.array_split(buckets[-1], count):
                vector = projection[piece].sum(axis=0)
                pieces.append(vector / max(np.linalg.norm(vector), 1e-9))
                owner.append(k)
        out.append(Searcher(block, projection, np.array(pieces, np.float32), np.array(owner),
                            buckets, rare_words(block, idf)))
    return out


def find_leaks(docs: DataFrame, searchers: list[Searcher], id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, common_words, item_words, share, answer_found)`` per leak.

    Every passage of every text is compared with every item.  Null and empty
    texts and items match nothing; repeated rows and repeated items are
    reported each; a null id is reported as such; other columns are ignored;
    an empty table or benchmark gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(searchers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, found = [], []
            by_row = (x for many in hashed_together(batch.column(1).to_pylist())
                      for x in zip(*(searcher.held(many) for searcher in sent.value)))
            for row, leaks in enumerate(by_row):
                for searcher, held in zip(sent.value, leaks):
                    for i, common, answer in held:
                        item = searcher.items[i]
                        place.append(row)
                        found.append((str(item.item_id), common, len(item.words), answer))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(place, pa.int64())),
                 pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                 pa.array([f[1] / f[2] for f in found], pa.float64()),
                 pa.array([f[3] for f in found], pa.bool_())],
                names=["doc_id", "item_id", "common_words", "item_words", "share", "answer_found"])

    return rows.mapInArrow(run, f"doc_id {kind}, item_id string, common_words long, "
                                "item_words long, share double, answer_found boolean")


def keep_clean(docs: DataFrame, searchers: list[Searcher], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns unchanged.

    Null, empty and blank texts hold no item and stay; rows that repeat stay or
    go together; columns may have any names; an empty table gives an empty
    result, and without items every row stays.
    """
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(searchers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for searcher in sent.value:
                keep &= [not held for held in searcher.leaks_of(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
