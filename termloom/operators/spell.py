"""Spelling: correction by one edit, and completion of prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as T


def correct_words(words: DataFrame, spell: DataFrame, deletes: DataFrame) -> DataFrame:
    """(word, corrected) of each distinct ``word``.

    A known word stays, in lower case.  Any other becomes the most frequent known word within one edit
    (ties by the alphabet), or stays as it is.  Only words that share a deletion are compared.
    """
    asked = words.select("word").distinct().withColumn("lower", F.lower("word"))
    keys = F.array_distinct(F.concat(F.array("lower"), T.one_deletions(F.col("lower"))))
    near = asked.select("word", "lower", F.explode(keys).alias("del")).join(deletes.withColumnRenamed("word", "known"), "del")
    near = near.where((F.col("lower") == F.col("known")) | T.within_one_edit(F.col("lower"), F.col("known")))
    best = near.groupBy("word").agg(
        F.max(F.when(F.col("lower") == F.col("known"), F.col("known"))).alias("same"),
        F.min(F.struct((-F.col("df")).alias("order"), F.col("known"))).alias("best"),
    )
    return asked.join(best, "word", "left").select("word", F.coalesce("same", "best.known", "word").alias("corrected"))


def correct_queries(queries: DataFrame, spell: DataFrame, deletes: DataFrame) -> DataFrame:
    """(qid, corrected): the query's words corrected, one blank between them; quotes, ``-`` and ``|`` go."""
    words = queries.select("qid", F.posexplode_outer(T.split_words(F.col("text"))).alias("pos", "word"))
    fixed = correct_words(words.where("word IS NOT NULL"), spell, deletes)
    joined = words.join(fixed, "word", "left").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "corrected"))).alias("w"))
    return joined.select("qid", F.array_join(F.transform("w", lambda x: x["corrected"]), " ").alias("corrected"))


def suggest(spell: DataFrame, prefixes: DataFrame, k: int = 8) -> DataFrame:
    """(prefix, rank, word, df): the k most frequent words that begin with each prefix, k from 1 to 50.

    A word is listed under each of its own prefixes of the lengths asked for, so this is an equi-join.
    """
    if not 1 <= k <= 50:
        raise ValueError("k must be from 1 to 50")
    asked = prefixes.select("prefix", F.lower("prefix").alias("low")).distinct().withColumn("len", F.length("low"))
    lengths = asked.agg(F.array_sort(F.collect_set("len")).alias("lens"))  # one row, of at most as many as a word is long
    keyed = spell.crossJoin(F.broadcast(lengths)).select("word", "df", F.explode("lens").alias("len")).where(F.length("word") >= F.col("len"))
    hits = keyed.withColumn("low", F.substring("word", F.lit(1), F.col("len"))).join(asked, ["low", "len"])
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("df"), "word"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("prefix", "rank", "word", "df")
