"""Vector codes, fill-in-the-middle and packing against plain versions."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import codes, fim, packing

SF = "/root/testdata/sf0.001"


# --- vector codes ------------------------------------------------------------------

def _plain_codes(rows, parts, entries, rounds):
    """``rows``: (id, integer vector) in the order of the codebook's choice."""
    width = max((len(v) for _, v in rows), default=0)
    width = parts * -(-width // parts)
    rows = [(i, list(v) + [0] * (width - len(v))) for i, v in rows]
    w = width // parts
    cut = [[v[p * w:(p + 1) * w] for _, v in rows] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def assign(p):
        out = []
        for x in cut[p]:
            d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        for p in range(parts):
            got = assign(p)
            for e in range(len(books[p])):
                mine = [x for x, (k, _) in zip(cut[p], got) if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [assign(p) for p in range(parts)]
    return [(i, bytes(last[p][r][0] for p in range(parts)), sum(last[p][r][1] for p in range(parts)))
            for r, (i, _) in enumerate(rows)], books


def test_hadamard_keeps_distances_and_orders_by_sequency():
    for width in (1, 2, 4, 8, 16):
        h = codes.hadamard(width)
        assert (h @ h.T == width * np.eye(width, dtype=np.int64)).all()
        assert [(r[1:] != r[:-1]).sum() for r in h] == list(range(width))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(1, 40), st.integers(1, 9), st.integers(0, 2 ** 32),
       st.sampled_from([3, 1000, 2 ** 33, 10 ** 30]))
def test_nearest_entries_equal_a_full_search(width, rows, entries, seed, size):
    rng = np.random.default_rng(seed)
    kind = np.int64 if size < 2 ** 40 else object
    parts = (rng.integers(-9, 9, (rows, width)).astype(kind) * size) // 9
    book = (rng.integers(-9, 9, (entries, width)).astype(kind) * size) // 9
    index, error = codes.nearest_entries(parts, book)
    for r in range(rows):
        d = [sum((int(a) - int(b)) ** 2 for a, b in zip(parts[r], e)) for e in book]
        assert (int(index[r]), int(error[r])) == (d.index(min(d)), min(d))


def test_compress_equals_a_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in rng.normal(0, 2, 7)], f"l{i % 3}" if i % 4 else None)
            for i in rng.permutation(150)]
    rows += [(5, None, "a"), (6, [1.0, None], "a"), (7, [float("nan")] * 7, "a"), (8, [float("inf")] * 7, "b"),
             (200, [1.5], "short"), (201, [], "empty"), (None, [0.5] * 7, "no id")]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame([(i, v, x, 1, 2) for i, v, x in rows],
                               "vec_id long, embedding array<double>, label string, id int, code int").repartition(5)
    coded, books = codes.compress(df, keep=("label",), parts=4, entries=8)
    kept = [(i, v, x) for i, v, x in rows if v is not None
            and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want, plain_books = _plain_codes([(i, [int(np.floor(256 * c)) for c in v]) for i, v, _ in order], 4, 8, 2)
    got = [(r["id"], bytes(r["code"]), r["error"]) for r in coded.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [b.tolist() for b in books] == plain_books
    assert codes.codebooks_digest(books) == hashlib.sha256(
        ",".join(str(x) for b in plain_books for e in b for x in e).encode()).hexdigest()
    back = codes.decompress(np.array([list(c) for _, c, _ in want]), books)
    assert [sum((a - b) ** 2 for a, b in zip(x, y)) for x, y in zip(
        [[int(np.floor(256 * c)) for c in v] + [0] * (8 - len(v)) for _, v, _ in order], back.tolist())
    ] == [e for _, _, e in want]


@pytest.mark.parametrize("few", [True, False])
def test_label_errors(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(codes, "BROADCAST_LABELS", 1)
    coded = spark.createDataFrame([(1, b"a", 3, "x"), (2, b"b", 4, None), (3, b"b", 5, "x"), (4, b"b", 6, None),
                                   (5, b"b", None, "huge"), (6, b"b", 1, "huge")],
                                  "id int, code binary, error long, label string")
    got = {r["id"]: r["label_error"] for r in codes.label_errors(coded, "label").collect()}
    assert got == {1: 8, 3: 8, 2: 10, 4: 10, 5: None, 6: None}


def test_codes_of_huge_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(1, [1e200, -1e200]), (2, [3.0, 1e300]), (3, [0.1, -0.1])], schema)
    coded, books = codes.compress(df, parts=2, entries=2, rounds=1)
    got = {r["id"]: (list(r["code"]), r["error"]) for r in coded.collect()}
    assert got[1] == ([0, 0], None) or got[1][1] in (0, None)
    assert len(books) == 2 and all(isinstance(int(x), int) for b in books for e in b.tolist() for x in e)
    none, empty = codes.compress(df.limit(0))
    assert none.count() == 0 and empty == [] and codes.label_errors(none.selectExpr("*", "1 as l"), "l").count() == 0
    one, books = codes.compress(df.where("vec_id = 3"), parts=16)
    assert [(list(r["code"]), r["error"]) for r in one.collect()] == [([0] * 16, 0)]


# --- fill in the middle ------------------------------------------------------------

def _plain_fim(doc_id, text):
    import re
    text = text or ""
    toks = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(toks)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, m, s = "".join(toks[:lo]), "".join(toks[lo:hi]), "".join(toks[hi:])
    if h4 % 100 < 80:
        return n, "spm", len(a), len(m), f"<S>{s}<P>{a}<M>{m}"
    return n, "psm", len(a), len(m), f"<P>{a}<S>{s}<M>{m}"


def test_fill_in_middle_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    letters = list("ab é日😀<PSM>") + [" ", "\n", "\t", "\x0b", "\x85", "\xa0"]
    rows = [(i, "".join(rng.choice(letters, int(rng.integers(0, 60))))) for i in range(300)]
    rows += [(None, "one two three"), (1000, None), (1001, ""), (1002, "   "), (1003, "x"), (7, "again a b"),
             (7, "again a b"), (1004, "<P> marked"), (1005, "word " * 60_000), (1006, "long" * 50_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, body string, n int")
    out = fim.fill_in_middle(df).withColumn("back", fim.restored())
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.collect()]
    want = [(i, *_plain_fim(i, t)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(r["back"] for r in out.collect()) == sorted(t or "" for _, t in rows)
    assert {f for _, _, f, *_ in want} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=3000), st.sampled_from([1, 5, 126]))
def test_index_is_exact_and_bounded(steps, error):
    offsets = np.concatenate([[0], np.cumsum(np.array(steps, np.int64))])
    index = fim.fit_index(offsets, error)
    assert [index.offset(r) for r in range(len(offsets))] == offsets.tolist()
    assert np.abs(index.residual.astype(int)).max() <= error + 1


def test_even_steps_need_one_segment():
    assert len(fim.fit_index(np.arange(0, 70_000, 7)).first_rank) == 1


# --- packing -----------------------------------------------------------------------

def _plain_level(levels, size, window):
    best = None
    for h in range(window - size + 1):
        if h and not levels[h]:
            continue
        after = list(levels)
        if h:
            after[h] -= 1
        if h + size < window:
            after[h + size] += 1
        key = (sum(x * x for x in after[1:window]), -h)
        best = min(best, (key, h)) if best else (key, h)
    return best[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 15), min_size=17, max_size=17), st.integers(1, 15))
def test_level_minimises_the_sum_of_squares(levels, size):
    levels[0] = levels[16] = 0
    packer = packing.Packer(16)
    packer.levels[:] = levels
    assert packer.level_for(size) == _plain_level(levels, size, 16)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=120), st.sampled_from([2, 7, 4096]))
def test_windows_hold_every_id_once(sizes, most):
    packer, windows = packing.Packer(32, most), []
    for doc, n in enumerate(sizes):
        windows += packer.add(doc, np.arange(n, dtype=np.uint32))
        assert packer.waiting == packer.levels.sum() <= most + 1
    windows += packer.close()
    lengths = [sum(len(p[3]) for p in w) for w in windows]
    assert sum(lengths) == sum(sizes)
    assert all(n == 32 or n in (1, 2, 4, 8, 16) for n in lengths)
    assert sum(n < 32 for n in lengths) <= 5
    seen = {}
    for w in windows:
        for doc, total, start, ids in w:
            assert total == sizes[doc] and ids.tolist() == list(range(start, start + len(ids)))
            seen.setdefault(doc, []).append((start, len(ids)))
    for doc, n in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at and length
            at += length
        assert at == n


def test_packed_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, "no id"), (9001, None), (9002, ""), (9003, "word " * 9000), (9004, "x" * 70_000),
             (9005, "same"), (9005, "same"), (9006, "a <|endoftext|> b"), (9007, "日本 語　テキスト\xa0x ")]
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows],
                               "doc_id long, text string, length int, ids string").repartition(3)
    pieces = [r.asDict() for r in packing.pack_documents(df, path).collect()]
    # documents back from their pieces
    found = {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        found.setdefault(p["doc_id"], []).append((p["start"], np.frombuffer(p["ids"], "<u4").tolist(), p["doc_tokens"]))
    for doc, text in rows:
        want = plain.encode(text or "", add_special_tokens=False).ids + [0]
        copies = sum(d == doc for d, _ in rows)
        got = sorted(found[doc])
        if copies == 1:
            assert sum((ids for _, ids, _ in got), []) == want, doc
            assert [s for s, _, _ in got] == np.cumsum([0, *[len(i) for _, i, _ in got][:-1]]).tolist()
        assert sum(len(i) for _, i, _ in got) == copies * len(want) and {t for _, _, t in got} == {len(want)}
    # sequences
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padding = 0
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    assert packing.pack_documents(df.limit(0), path).count() == 0
    crc = zlib.crc32(pieces[0]["ids"])
    assert crc == spark.createDataFrame([(pieces[0]["ids"],)], "b binary").selectExpr("crc32(b)").first()[0]
