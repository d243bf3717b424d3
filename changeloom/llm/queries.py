"""The registered queries of the training-data operators: thin calls over whole
tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm.common import read_table
from changeloom.llm.decontaminate import find_contamination
from changeloom.llm.license_scan import scan_licenses
from changeloom.llm.line_dedup import dedup_lines
from changeloom.llm.maxent_lm import score_texts
from changeloom.llm.near_dedup import near_duplicates
from changeloom.llm.pii import KINDS, find_pii, of_kind, told
from changeloom.llm.piece_fst import encode_pieces
from changeloom.llm.repetition import repetition_quality
from changeloom.llm.sentence_spans import dedup_spans
from changeloom.llm.substring_dedup import dedup_substrings


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text").cast("binary"), 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_quality(read_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    counts = [F.size(of_kind("base", k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2, percent=80)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents"), width=200).drop("spans")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("hits")


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_spans(docs).select("doc_id", "spans.n_sentences", "spans.n_removed", F.sha2(F.col("spans.text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_maxent_lm": op5_maxent_lm,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_decontamination": op9_decontamination,
    "op10_sentence_spans": op10_sentence_spans,
}
