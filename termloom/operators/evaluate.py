"""Quality of rankings (qid, rank, doc_id) against judgements (qid, doc_id, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The ranking with its grades; what isn't judged has 0."""
    return run.select("qid", "rank", "doc_id").join(qrels, ["qid", "doc_id"], "left").select("qid", "rank", "doc_id", F.coalesce("grade", F.lit(0)).alias("grade"))


def _gain(rank: str):
    return (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(rank) + 1)


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10, retrieved: bool = True) -> DataFrame:
    """(qid, ndcg).  ``retrieved``: the ideal ranks what was retrieved; else all that is judged."""
    rows = judged(run, qrels)
    ideal = rows if retrieved else qrels
    got = rows.where(F.col("rank") <= k).groupBy("qid").agg(F.sum(_gain("rank")).alias("dcg"))
    best = ideal.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"))))
    best = best.where(F.col("place") <= k).groupBy("qid").agg(F.sum(_gain("place")).alias("ideal"))
    value = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    return rows.select("qid").distinct().join(got, "qid", "left").join(best, "qid", "left").select("qid", F.round(value, 6).alias("ndcg"))


def mrr(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, mrr): one over the first relevant rank, 0 beyond k."""
    first = F.min(F.when((F.col("grade") > 0) & (F.col("rank") <= k), F.col("rank")))
    return judged(run, qrels).groupBy("qid").agg(first.alias("first")).select("qid", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def recall(run: DataFrame, qrels: DataFrame, k: int = 100) -> DataFrame:
    """(qid, recall) of every query that was run; 0 where nothing is relevant."""
    found = judged(run, qrels).groupBy("qid").agg(F.sum(((F.col("grade") > 0) & (F.col("rank") <= k)).cast("int")).alias("found"))
    all_of = qrels.where("grade > 0").groupBy("qid").agg(F.count("*").alias("relevant"))
    value = F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant")).otherwise(0.0)
    return found.join(all_of, "qid", "left").select("qid", F.round(value, 6).alias("recall"))


def percentiles(rows: DataFrame, group: str, value: str, shares=(0.5, 0.95, 0.99)) -> DataFrame:
    """Of each group, its size and the value at place floor(n * share), not interpolated.

    Equal values are counted first, then a group's distinct values are gone through in order.
    """
    w = Window.partitionBy(group)
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    at = counted.select(group, value, F.sum("c").over(w.orderBy(value)).alias("upto"), F.sum("c").over(w).alias("n"))
    names = [f"p{round(s * 100)}" for s in shares]
    place = lambda s: F.least(F.floor(F.col("n") * s), F.col("n") - 1)
    pick = [F.min(F.when(F.col("upto") > place(s), F.col(value))).alias(x) for s, x in zip(shares, names, strict=True)]
    return at.groupBy(group).agg(F.max("n").alias("n"), *pick)
