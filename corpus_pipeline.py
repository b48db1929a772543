"""Corpus pipeline over ``documents``: each stage is one operator, written as Parquet and read again by the next.

All stages but the last return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blinkframe.llm import exact_dedup, near_dedup, packing, quality_rules, suffix_dedup
from blinkframe.llm.frames import shared_folder, table
from blinkframe.llm.queries import WORD_TOKENIZER
from blinkframe.sources.shared import remove

#: Bytes of a passage that must repeat in another document to be cut; 50 words of running text have more.
PASSAGE_BYTES = 150


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, measured against the languages of ``docs`` itself."""
    return quality_rules.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts stays: the one with the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that shares four fifths of its five-word shingles stays: the one with the least doc_id."""
    return near_dedup.near_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has too are cut out of texts; n_chars follows."""
    kept = suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[f"`{c}`" for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, WORD_TOKENIZER)


STAGES = [
    ("quality rules", good_quality),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packed),
]

#: Neither near-duplicate components nor tokenization have a practical SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each but the last returns is written in the shared folder and read again.

    A stage's table goes once the next one is written; the last of them stays, as the result is read from it. An empty
    table gives no rows. Null and repeated ids, null texts and columns of any name pass through the stages.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    *stages, (_, last) = STAGES
    for number, (_, stage) in enumerate(stages):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        remove(spark, f"{folder}/{number - 1}")
    return last(spark, docs, sf_dir)
