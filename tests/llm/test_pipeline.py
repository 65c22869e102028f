import os

import corpus_pipeline
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

from termloom.llm import bpe, langid, queries, simhash, substring
from tests.llm import brute
from tests.llm.test_bpe import PATTERN

def test_every_stage_against_its_slow_version(spark, sf_dir):
    """Each stage on the rows that the one before it kept, then run() as a whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    model = langid.fit(docs)
    rejected = {r["doc_id"] for r in langid.identify(docs, model).where("rejected").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in rejected]
    got = dict(r for r in ((x["doc_id"], x["text"]) for x in corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).collect()))
    assert got == dict(rows)

    groups = brute.simhash_groups(rows, simhash.MAX_DISTANCE)
    away = {i for k, v in groups.items() for i in v if i != k}
    rows = [r for r in rows if r[0] not in away]
    rows = brute.without_repeats(rows, substring.K)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    # exact containment is enough of a slow version here; edits are compared in test_leaks
    exact = {i for i, t in rows for _, it in items if brute.flat(it).tobytes() in brute.flat(t).tobytes()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    kept = {i for i, _ in rows} - exact
    assert set(out) <= kept
    assert len(out) >= 0.95 * len(kept)
    if os.path.exists(bpe.VOCABULARY):
        other = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=load_tiktoken_bpe(bpe.VOCABULARY), special_tokens={})
        for i, t in rows:
            if i in out:
                assert out[i]["ids"] == other.encode_ordinary(t) and out[i]["round_trip"]


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"group_id": F.lit(1), "rejected": F.lit("x"), "start_word": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_odd_rows(spark, sf_dir):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "the and of that is here", "en", None, 3), (3, "the and of that is here", None, "s", None), (3, "the and of that is here", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    # null and empty texts go, of the equal rows one stays, the row without an id stays
    assert sorted(repr(r["doc_id"]) for r in docs.collect()) == ["3", "None"]


@pytest.mark.parametrize("name", [n for n in queries.queries()])
def test_query_runs(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0
