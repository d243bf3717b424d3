"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination
and encoding, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm.common import cut, fresh, read_table
from changeloom.llm.decontaminate import drop_contaminated
from changeloom.llm.line_dedup import dedup_lines
from changeloom.llm.near_dedup import keep_first
from changeloom.llm.piece_fst import encode_pieces
from changeloom.llm.repetition import keep_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep, as they are."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document of smaller doc_id holds;
    n_chars follows the text."""
    columns = docs.columns
    (lines,) = fresh(docs, "lines")
    out, new = dedup_lines(docs, out_col=lines), F.col(f"{lines}.text")
    changed = F.col(f"{lines}.n_dropped") > 0
    out = out.withColumn("n_chars", F.when(changed, F.length(new).cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.when(changed, new).otherwise(F.col("text"))).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, 0.8."""
    return keep_first(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, and whether decoding gives its text again."""
    return encode_pieces(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]

#: SQL can't express the suffix arrays, signatures, alignments and piece paths;
#: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
