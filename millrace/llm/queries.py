"""The registered queries of the thirteen training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontaminate, fingerprints, lexicon, lines, merkle, neardup, packing, pii, rules, spelling, warc
from .common import read
from .oracles import ORACLE_SQL


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(read(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"))


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op7_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encode_decode(read(spark, sf_dir, "documents"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(read(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(read(spark, sf_dir, "documents"))


def op10_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack_matrix(read(spark, sf_dir, "documents"))
    return rows.withColumn("ids_crc32", F.crc32("ids")).withColumn("positions_crc32", F.crc32("position_ids")).drop("ids", "position_ids")


def op11_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_private_data": op3_private_data,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_bpe_lexicon": op7_bpe_lexicon,
    "op8_warc_index": op8_warc_index,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_matrix": op10_token_matrix,
    "op11_benchmark_passages": op11_benchmark_passages,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
