"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage works on all rows its predecessor kept.  Null and empty texts pass
the stages as each operator's docstring defines; all stages but the last keep
the columns of ``documents``, and further columns of any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, decontam, neardup, pii, quality
from cohortlens.llm.common import free_shuffles, fresh_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose lines score below the threshold.

    Rows with null, empty or blank texts are scored as one blank line; rows that
    repeat go or stay together; an empty table gives an empty one.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the least id.

    Texts without words are no copies of each other and stay; rows that repeat
    id and text stay once; an empty table gives an empty one.
    """
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage.

    Null and empty texts hold none; without benchmark items all rows stay; an
    empty table gives an empty one.
    """
    searchers = decontam.fit_searchers(docs, table(spark, sf_dir, "benchmark"))
    return decontam.keep_clean(docs, searchers)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars`` follows the text.

    A null text stays null and keeps its ``n_chars``; all rows stay; an empty
    table gives an empty one.
    """
    out = pii.redact(docs, pii.train(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                          .otherwise(F.length("text").cast("long")))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of their decoded bytes.

    A null text has no ids; one row per row of ``docs``, repeated ids included;
    an empty table gives an empty one.
    """
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("byte_bpe", encoding_stage),
]

#: No SQL: trained models and byte-pair merges; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        # the driver's share of a stage goes with it
        free_shuffles(spark)
        docs = spark.read.parquet(path)
    return docs
