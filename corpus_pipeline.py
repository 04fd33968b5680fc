"""The corpus pipeline: quality rules, near-duplicates, repeated lines, benchmark leaks, then pieces.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and all but the last return the
columns of documents. ``run`` writes each stage's rows to the shared folder and reads them for the next.
Rows with a null id pass the stages that look documents up by id unchanged. Null and empty texts go in the first stage
(fewer than 50 words); repeated rows of one id are one document, of which the second stage keeps one row; ties go to the
smaller id; very long texts are handled whole; columns that documents don't have are left out before the first stage;
an empty table gives an empty result. Each operator's module states these cases for itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knnscore.llm import decontamination, near_dedup, quality_rules, sentencepiece, substring_dedup
from knnscore.llm._shared import stored, table
from knnscore.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return near_dedup.keep_one(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line has; documents of which nothing is left go."""
    cleaned = substring_dedup.deduplicate(docs, carry=("lang", "source"))
    kept = cleaned.where("n_removed = 0 OR text IS NULL OR length(trim(BOTH '\n' FROM text)) > 0")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text."""
    return sentencepiece.encode(docs, tokenizer_file("piece_bpe_32k.model").read_bytes())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_lines),
    ("benchmark decontamination", leaks),
    ("SentencePiece encoding and decoding", encoded),
]

ORACLE_SQL: str | None = None  # neither compression ratios nor pieces can be written in SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
