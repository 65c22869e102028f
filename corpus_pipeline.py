"""Corpus pipeline: the documents of a folder, cleaned and tokenised stage by stage.

Every stage takes ``(spark, docs, sf_dir)``, works on all the rows that the one before it kept, and
returns a DataFrame; between stages the rows are written as Parquet to the shared folder and read
back, so no stage is computed twice and a lost executor costs only its own tasks.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import bpe, decontam, langid, simhash, substring
from termloom.llm._state import remove, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go, and those without text."""
    return langid.drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words stay where they occur first and are cut out elsewhere."""
    return substring.drop_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its edit budget, go."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their offsets and the check that decoding gives the text again."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("bpe", tokens),
]

#: The language model, the fingerprints and the tokens can't be expressed in SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the rows of ``bpe.encode_documents`` for what is kept.

    Documents with a null or empty text go in the first stage; an empty table gives no rows.  Rows with a
    null doc_id are kept on their own text.  Rows that repeat a doc_id and a text become one (near_dedup),
    rows that share a doc_id alone stay apart.  Of documents that tie, the smallest doc_id stays.  Each
    stage's folder is deleted once the next one is written, the last with the session.
    """
    folder = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{folder}/{i}-{name}"
            df.write.parquet(path)
            df = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return df
