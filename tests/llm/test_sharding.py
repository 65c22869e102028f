import duckdb
import pytest
from pyspark.sql import functions as F

from termloom.llm import sharding

SCHEMA = "doc_id bigint, text string, source string"


def check(df, shards):
    out = sharding.assign(df, shards)
    rows = [(r["source"], r["doc_id"], r["shard"], r["part"], len((r["text"] or "").encode()) + 1) for r in out.collect()]
    assert len(rows) == df.count()
    key = lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0)
    shard = [r[2] for r in sorted(rows, key=key)]
    assert shard == sorted(shard)
    per = out.withColumn("at", F.spark_partition_id()).groupBy("at").agg(F.countDistinct("shard", "part").alias("n")).agg(F.max("n")).first()[0]
    assert per in (None, 1)
    sizes = {}
    for r in rows:
        sizes[r[2], r[3]] = sizes.get((r[2], r[3]), 0) + r[4]
    return sizes, rows


def test_balance(spark):
    rows = [(i, "x" * (i * 37 % 900), "hot" if i % 3 else f"s{i % 17}") for i in range(6000)]
    sizes, _ = check(spark.createDataFrame(rows, SCHEMA), 16)
    assert len(sizes) >= 16 and max(sizes.values()) <= 1.3 * sum(sizes.values()) / 16


def test_one_key(spark):
    rows = [(7, f"text {i} " * 20, "s") for i in range(500)] + [(1, "a", "a"), (9, "z", "z")]
    sizes, placed = check(spark.createDataFrame(rows, SCHEMA), 8)
    assert len(sizes) >= 8 and max(sizes.values()) <= 2 * sum(sizes.values()) / 8
    same = spark.createDataFrame([(7, "same", "s")] * 50, SCHEMA)
    assert len(check(same, 4)[0]) == 1


def test_odd_rows(spark):
    rows = [(None, "a", None), (1, None, "s"), (1, None, "s"), (2, "", None), (3, "y" * 500_000, "s"), (None, None, "é")]
    df = spark.createDataFrame([(*r, "old", 5) for r in rows], SCHEMA + ", shard string, part int")
    check(df, 4)
    out = sharding.assign(df, 4)
    assert sorted(out.columns) == sorted(df.columns) and dict(out.dtypes)["shard"] == "int"
    assert sharding.assign(df.limit(0), 4).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf_dir, sf):
    d = sf_dir.replace("sf0.001", sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = sharding.assign(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "text", "lang", "source", "n_chars", "shard", "part")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(sharding.SQL).fetchall())
