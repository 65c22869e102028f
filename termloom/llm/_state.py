"""Where lineage is cut: files in the folder that all executors share; and rows that repeat."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; a folder of our own only where it is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="termloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on any file system that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there from now on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def one_of_equal(docs: DataFrame, source: DataFrame, which: Column | None = None) -> DataFrame:
    """The rows, but of those that repeat a doc_id and a text only one: the first by its other columns as JSON.

    ``source`` is a table whose doc_ids are cheap to read and hold all those that repeat.  Rows with a null
    doc_id or text stay, and those that ``which`` does not name.  Where no doc_id repeats this is no step.
    The texts of rows that repeat are spread by doc_id and text and merged before they are exchanged.
    """
    may = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    ids = source.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__tl_id"))
    if ids.isEmpty():
        return docs
    may = may if which is None else may & F.coalesce(which, F.lit(False))
    same = F.col("doc_id") == F.col("__tl_id")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    kinds = docs.select("doc_id", "text").dtypes
    again = docs.where(may).join(ids, same, "left_semi")
    others = F.struct(*rest) if rest else F.lit(0)
    first = F.min_by(others, F.to_json(F.struct(*rest)) if rest else F.lit(0))
    once = again.groupBy("doc_id", "text").agg(first.alias("__tl_rest"))
    once = once.select(*[(F.col(c).cast(dict(kinds)[c]) if c in ("doc_id", "text") else F.col(f"__tl_rest.`{c}`")).alias(c) for c in docs.columns])
    return docs.where(~may).unionByName(docs.where(may).join(ids, same, "left_anti")).unionByName(once)
