"""The corpus pipeline stage by stage, against each operator's own rule."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import bpe, neardup, pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, blanks, repeats and columns that operators use names of inside."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    good = max(rows, key=lambda r: len(r["text"]) if r["lang"] == "en" else 0)
    extra = [{**good, "doc_id": None}, {**good, "doc_id": 90001}, {**good, "doc_id": 90001},
             {**good, "doc_id": 90002, "text": None}, {**good, "doc_id": 90003, "text": ""},
             {**good, "doc_id": 90004, "text": " \n "}, {**good, "doc_id": 90005, "lang": None, "n_chars": None},
             {**good, "doc_id": 90006, "text": good["text"] + " Write to jane.doe@example.org today."}]
    table = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows + extra], docs.schema)
    clashing = ["_key", "_stay_id", "text_key", "class", "body", "ids", "score", "who", "Stay_Key"]
    return table.select("*", *[F.col("doc_id").alias(c) for c in clashing]).cache()


def test_stages_on_odd_rows(spark, odd):
    docs, steps = odd, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        steps[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == odd.columns, name
            # what stays is unchanged, but for redacted texts
            if name != "personal_data":
                before = {str(r) for r in odd.collect()}
                assert {str(r) for r in docs.collect()} <= before, name
    kept = steps["near_duplicates"]
    groups = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(steps["quality"]).collect()
              if r["n_shingles"]}
    ids = [r["doc_id"] for r in kept.collect()]
    with_words = [i for i in ids if i in groups]
    assert len(with_words) == len(set(with_words)) == len(set(groups.values()))
    assert all(groups[i] == i for i in with_words if i is not None)
    # the long document and its copies come to one row; 90006 differs by six words only
    assert not {90001, 90005, 90006, None} & set(ids)
    for r in steps["personal_data"].collect():
        if r["text"] is not None:
            assert r["n_chars"] == len(r["text"])
            assert not pii.base_spans(r["text"]) or "<" in r["text"]
    last = steps["byte_bpe"].collect()
    texts = {}
    for r in steps["personal_data"].collect():
        texts.setdefault(r["doc_id"], []).append(hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert len(last) == steps["personal_data"].count()
    for r in last:
        assert r["decoded_sha256"] in texts[r["doc_id"]]
        assert len(r["ids"]) == r["n_tokens"]


def test_stages_on_an_empty_table(spark, odd):
    docs = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = out.collect()
    assert 0 < len(rows) < docs.count()
    import public_tokenizers
    encoder = bpe.load_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in rows[:50]:
        assert hashlib.sha256(encoder.decode(r["ids"])).hexdigest() == r["decoded_sha256"]
        assert hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() == r["ids_sha256"]
