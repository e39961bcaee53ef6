"""Operators without SQL against plain versions, enumeration or held-out rows."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import ann, bpe, pii, quality, sharding

SF = "/root/testdata/sf0.001"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, i, "x") for i, t in rows],
                                 "doc_id long, text string, score long, spans string")


def _plain_jump(key, shards):
    key &= (1 << 64) - 1
    bucket, jump = -1, 0
    while jump < shards:
        bucket = jump
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        jump = int((bucket + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return bucket


def test_shards_equal_a_plain_walk(spark):
    docs = _docs(spark, [(i, "t" * (i % 7)) for i in range(-300, 300)] + [(5, "again"), (None, None)])
    keys = docs.select("doc_id", F.xxhash64("doc_id").alias("key")).distinct().collect()
    want = {r["doc_id"]: (_plain_jump(r["key"], 24), _plain_jump(r["key"], 25)) for r in keys}
    got = sharding.shard_documents(docs).collect()
    assert len(got) == 602
    assert all((r["shard"], r["grown_shard"]) == want[r["doc_id"]] for r in got)
    moved = [r for r in got if r["shard"] != r["grown_shard"]]
    assert moved and all(r["grown_shard"] == 24 for r in moved) and len(moved) < 602 / 25 * 2


# --- quality -----------------------------------------------------------------------

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 4, 2, 5])
    potentials = rng.normal(0, 2, (lengths.sum(), 2))
    transition = rng.normal(0, 1, (2, 2))
    marginals, expected = quality.forward_backward(potentials, lengths, transition)
    moves, start = np.zeros((2, 2)), 0
    for n in lengths:
        want, total, pairs = np.zeros((n, 2)), 0.0, np.zeros((2, 2))
        for path in itertools.product(range(2), repeat=int(n)):
            weight = np.exp(sum(potentials[start + t, s] for t, s in enumerate(path))
                            + sum(transition[a, b] for a, b in zip(path, path[1:])))
            total += weight
            for t, s in enumerate(path):
                want[t, s] += weight
            for a, b in zip(path, path[1:]):
                pairs[a, b] += weight
        assert np.allclose(marginals[start:start + n], want / total)
        moves += pairs / total
        start += n
    assert np.allclose(expected, moves)


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality.train(docs, labels)
    scored = quality.score_documents(docs, field)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in scored.collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) > 50
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) >= 0.95
    # labels of held-out rows are never learned from
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    assert (quality.train(docs, flipped).weights == field.weights).all()
    odd = _docs(spark, [(1, None), (2, ""), (3, " \n"), (4, "a b c\n" * 30_000), (4, "x"), (4, "x"), (None, "x")])
    got = quality.score_documents(odd, field).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality.score_documents(odd.limit(0), field).count() == 0
    kept = quality.keep_good(odd, field)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] for r in got)
    neutral = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_documents(odd, neutral).collect()} == {0.5}


# --- personal data -----------------------------------------------------------------

def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _plain_spans(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, low, high in ((2, r"[0-9](?:[\x20-]?[0-9])+", 13, 19),
                                     (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == 3 or _luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_personal_data_of_whole_documents(spark, tagger):
    rows = [(r["doc_id"], r["text"]) for r in
            spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(90001, None), (90002, ""), (90003, "a@b.c " * 20_000), (90004, "mail x@y.zz"), (90004, "mail x@y.zz"),
             (None, "call +1 (499) 555-6503")]
    got = pii.scan_documents(_docs(spark, rows).repartition(8), tagger).collect()
    assert len(got) == len(rows)
    plain = {}
    for i, t in rows:
        plain.setdefault(i, _plain_spans(t or ""))
    for r in got:
        want = plain[r["doc_id"]]
        named = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == i for x, _, _ in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r["spans"].split(",")) or not named
    assert pii.scan_documents(_docs(spark, rows[:1]).limit(0), tagger).count() == 0


def test_tagger_finds_held_out_spans(spark, tagger):
    """Other documents than those of the fit: share of format characters tagged with their kind."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 5 = 3")
    texts = [r["text"] for r in docs.select("text").collect() if r["text"] and _plain_spans(r["text"])][:120]
    fast = pii.FastTagger(tagger)
    tags = pii.tag_texts(fast, [pii.encode_chars(t) for t in texts])
    right = total = marked = 0
    for text, tag in zip(texts, tags):
        truth = np.zeros(len(text), int)
        for kind, a, b in _plain_spans(text):
            truth[a:b] = kind + 1
        total += (truth > 0).sum()
        marked += (np.asarray(tag) > 0).sum()
        right += ((truth > 0) & (np.asarray(tag) == truth)).sum()
    assert right / total >= 0.85 and right / marked >= 0.5, (right / total, right / marked)


# --- neighbours and empty tables -----------------------------------------------------

def test_recall_of_a_graph_that_descends(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0.2, 1.0, (2500, 16))
    assert len(x) > ann.BLOCK
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)] + [(3, [1.0] * 16)],
                              "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(v, lambda i: i % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2500, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s, kind="stable")[:5].tolist()))
    assert hits / (5 * 50) >= 0.9


def test_empty_tables(spark):
    import public_tokenizers
    docs = _docs(spark, [(1, "x")]).limit(0)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.round_trip(docs, path, public_tokenizers.PATTERN).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.nearest_neighbours(none, lambda i: i % 50 == 0).count() == 0
    assert pii.train(docs) is not None
