"""The corpus pipeline: quality rules, quality classifier, near duplicates, secrets, packing.

Each stage takes all that the one before it kept. The first four return the columns of ``documents``;
the last returns the packed pieces.

Defined cases: a null text counts as empty, so the quality rules reject it, as they do texts without
words; null languages and sources are groups of their own; of rows under one doc_id, and of rows with
a null doc_id and one text, one stays; other columns go through unchanged whatever their names; an empty
table gives empty stages; without labels of both kinds the classifier keeps all or none by their share.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.llm import compression_classifier, ngram_join, packing, quality_rules, secret_scan
from pitspark.llm.common import crc_mod, text_or_empty, written

END_ID = 1


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.quality_kept(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says label 1.

    It learns from labelled rows of the whole table that are not held out: few bad ones are left in ``docs``.
    """
    every, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = compression_classifier.fit(every.select("doc_id", "text"), labels, crc_mod("doc_id", 3) != 1)
    return docs.filter(compression_classifier.score(text_or_empty("text"), model) >= 0.5)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets redacted and n_chars brought up to date."""
    clean = secret_scan.without_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.packed_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The classifier's dictionaries and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
