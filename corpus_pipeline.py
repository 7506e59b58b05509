"""Documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Language ID and the quality classifier drop what they reject, near-dedup keeps the smallest id of each group, repeated
passages are cut (a document of which nothing is left goes), and packing gives the pieces of sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import cost_packing, run_index, simhash_anchors, subword_quality, word_language
from tallymill.llm.common import shared_folder, table
from tallymill.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known.

    A null or empty text has no language and goes; repeated rows and null ids are judged by their texts like any others;
    all columns stay as they are, whatever their names.
    """
    return word_language.accepted(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a quality of one half or more; an untrained model (no labels) keeps all. Rows and columns as before."""
    return subword_quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five-word shingles, similarity 0.8 or more), the smallest id's.

    Repeated rows are one; documents without an id stand for themselves; those of fewer than five words are their own shingle.
    """
    return simhash_anchors.representatives(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what repeats an earlier 100-byte string; a document that loses all its text goes, and n_chars follows the text.

    A null id comes before all others; rows of one id and text are one place, so neither cuts the other.
    """
    kept = run_index.dedup(docs, emptied=False)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4,096 tokens; a row is a document, null texts are empty, and further columns do not matter."""
    return cost_packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", passage_dedup), ("packing", packing)]

#: No SQL expresses the trained stages. tests/llm holds near-dedup, passages and packing against brute force on each stage's own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; stages are written below spark.checkpoint.dir."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
