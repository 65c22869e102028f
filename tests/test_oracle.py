"""Every registered query of the reference's operators against its SQL in DuckDB, over whole tables."""

import math
import os

import duckdb
import pytest

from termloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    fix = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else x.item() if hasattr(x, "item") else x
    return sorted((tuple(fix(x) for x in r) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    if name not in registry.oracle_sql():
        assert len(got)
        return
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_forward_index_of_odd_texts(spark, tmp_path):
    """Documents without a word, or with stopwords alone, have no row in SQL."""
    texts = ["the cat sat", "the mat the mat", "", None, "?!", "the", "the The", *[f"the word{i}" for i in range(9)]]
    odd = [*enumerate(texts), (None, "the lost cat")]
    spark.createDataFrame(odd, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.queries()["forward_index"](spark, str(tmp_path)).toPandas()
    assert len(got) == 11
    assert rows(got) == rows(c.sql(registry.oracle_sql()["forward_index"]).df())
