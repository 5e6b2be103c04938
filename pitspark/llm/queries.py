"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pitspark.llm import byte_bpe, compression_classifier, i_match, media, merkle, ngram_join, packing, pitman_yor, quality_rules, secret_scan, spelling, sql, token_records, warc
from pitspark.llm.common import crc_mod

END_ID = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_records(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archived(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"))


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 7) == 2
    return pitman_yor.scored(_table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op6_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), crc_mod("doc_id", 3) == 1
    scored = compression_classifier.classified(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(_table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_i_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i_match.fingerprinted(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": op1_token_records,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_pitman_yor": op4_pitman_yor,
    "op5_packing": op5_packing,
    "op6_compression_classifier": op6_compression_classifier,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_media": op9_media,
    "op10_ngram_join": op10_ngram_join,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_i_match": op12_i_match,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL: dict[str, str] = dict(sql.SQL)
