"""Queries of this subpackage over a folder of tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import ann, bpe, chat, decontam, langid, lm, quality, sharding, simhash, substring


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, benchmark, labels = _table("documents"), _table("benchmark"), _table("labels")
embeddings, conversations = _table("embeddings"), _table("conversations")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_neighbours": lambda s, d: ann.neighbours(embeddings(s, d)),
        "op2_chat": lambda s, d: chat.format_conversations(conversations(s, d)),
        "op3_bpe": lambda s, d: bpe.encode_documents(documents(s, d)),
        "op4_simhash_groups": lambda s, d: simhash.near_duplicate_groups(documents(s, d)),
        "op5_repeated_spans": lambda s, d: substring.repeated_spans(documents(s, d)),
        "op6_quality": lambda s, d: quality.classify(documents(s, d), labels(s, d)),
        "op7_leaks": lambda s, d: decontam.leaks(documents(s, d), benchmark(s, d)),
        "op8_shards": lambda s, d: sharding.assign(documents(s, d)),
        "op9_lm_scores": lambda s, d: lm.score(documents(s, d)),
        "op10_language": lambda s, d: langid.identify(documents(s, d)),
    }


OP5_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+') AS words
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
k AS (
  SELECT doc_id, unnest(range(len(words) - 49)) AS pos, words FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, pos, array_to_string(words[pos + 1 : pos + 50], ' ') AS win FROM k),
c AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY win) AS n,
         first_value(doc_id) OVER (PARTITION BY win ORDER BY doc_id, pos) = doc_id
         AND first_value(pos) OVER (PARTITION BY win ORDER BY doc_id, pos) = pos AS first
  FROM h),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, first ORDER BY pos) AS run FROM c WHERE n > 1)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start_word, CAST(max(pos) + 50 AS INTEGER) AS end_word, first,
       CAST(max(n) AS BIGINT) AS copies
FROM r GROUP BY doc_id, first, run
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.SQL, "op5_repeated_spans": OP5_SQL, "op8_shards": sharding.SQL}
