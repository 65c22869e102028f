import dataclasses

import pytest
from pyspark.sql import functions as F

from termloom.operators import search as S
from termloom.plans import index as I
from termloom.plans.catalog import Catalog
from termloom.plans.config import BuildConfig, SearchOptions
from termloom.plans.search import search

DOCS = [
    ("d1", "the cat sat on the mat", "en", 10), ("d2", "a kitten is a young animal", "en", 20), ("d3", "dogs chase a cat, and cats flee", "en", 30),
    ("d4", "the mat is red", "en", 40), ("d5", "the cat sat on the mat", "xx", 50), ("d6", "", "xx", 60), ("d7", None, "xx", 70),
    ("d8", "red red dogs bark", "de", 80), ("d9", "young dogs and a young cat on a mat", "de", 90), ("d10", "unrelated words entirely", "de", 100),
    (None, "lost cat", "de", 0),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    corpus = spark.createDataFrame(DOCS, "doc_id string, text string, lang string, n int")
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate([(1, 0, 0), (1, 0.1, 0), (0, 1, 0), (0, 0.9, 0.1), (0, 0, 1), (1, 1, 1)])], "vec_id bigint, embedding array<double>")
    return I.build(corpus, str(tmp_path_factory.mktemp("index") / "i"), BuildConfig(threshold=0.5), vectors)


def queries(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid int, text string")


def same(a, b):
    key = lambda df: sorted(tuple(r) for r in df.select("qid", "rank", "doc_id", "score").collect())
    assert key(a) == key(b)


TEXTS = ("cat mat", "young dogs", "red", "zzz", "", "cat red young mat")


def test_counts(index):
    assert index.n_docs == 10
    assert {r["doc_id"]: r["dl"] for r in index.docs.collect()}["d7"] == 0
    assert index.docs.where("NOT canonical").select("doc_id").toPandas()["doc_id"].tolist() in (["d5", "d7"], ["d7", "d5"], ["d1", "d7"], ["d7", "d1"])
    stats = index.postings.where("tf > 0").agg(F.countDistinct("term")).first()[0]
    assert stats == index.stats["n_terms"]


def test_alpha_and_groups(spark, index):
    t = S.query_terms(queries(spark, *TEXTS))
    same(S.topk(S.score(index, t, 1.0), 10), S.bm25(index, t))
    exact = dataclasses.replace(index, postings=index.postings.where("tf > 0").withColumn("w", F.col("tf").cast("double")))
    same(S.topk(S.score(index, t, 0.0), 10), S.bm25(exact, t))
    singles = t.withColumn("grp", F.hash("term"))
    same(S.topk(S.score_groups(index, singles), 10), S.bm25(index, t))
    for k in (1, 2, 10):
        same(S.pruned(index, t, k), S.bm25(index, t, k))
    same(S.diversify(index, t, 10, 1.0), S.bm25(index, t, 10))


def test_expansion_finds_neighbours(spark, index):
    edge = index.neighbours.first()
    q = queries(spark, edge["dst"])
    t = S.query_terms(q)
    more = {r["doc_id"] for r in S.score(index, t, 1.0).collect()}
    less = {r["doc_id"] for r in S.score(index, t, 0.0).collect()}
    holds = {r["doc_id"] for r in index.postings.where((F.col("term") == edge["src"]) & (F.col("tf") > 0)).collect()}
    assert less | holds <= more


def test_operators(spark, index):
    ids = lambda text, **o: [r["doc_id"] for r in search(index, text, SearchOptions(alpha=0.0, **o)).orderBy("rank").collect()]
    assert set(ids("cat mat")) == {"d1", "d3", "d4", "d5", "d9"}
    assert set(ids("cat -mat")) == {"d3"}
    assert set(ids('"cat sat" mat')) == {"d1", "d5"}
    assert set(ids('"cat sat" mat', dedup=True)) == {"d1"}
    assert set(ids("cat", filters=({"field": "n", "gte": 30},))) == {"d3", "d5", "d9"}
    assert set(ids("cat", filters=({"field": "lang", "eq": "de"},))) == {"d9"}
    assert set(ids("bark|animal", bigram_weight=0.0)) == {"d2", "d8"}
    assert ids("cat", k=1, offset=1) == ids("cat")[1:2]
    assert set(ids("mats", correct=True)) >= {"d1", "d4"}
    assert ids("", correct=False) == [] and ids("zzz") == []
    tiers = search(index, "cat", SearchOptions(tiers=(("n", False),), band=1.0)).orderBy("rank").collect()
    n = {d[0]: d[3] for d in DOCS}
    for a, b in zip(tiers, tiers[1:], strict=False):
        assert (a["bucket"], -n[a["doc_id"]]) <= (b["bucket"], -n[b["doc_id"]])
    with pytest.raises(ValueError):
        search(index, "cat", SearchOptions(tiers=(("nothing", True),)))
    with pytest.raises(ValueError):
        search(index, "cat", SearchOptions(filters=({"field": "nothing", "eq": 1},)))
    with pytest.raises(ValueError):
        SearchOptions(k=0)


def test_bonuses(spark, index):
    q = queries(spark, "cat sat", "young cat")
    t = S.query_terms(q)
    plain = {(r["qid"], r["doc_id"]): r["score"] for r in S.score(index, t).collect()}
    close = {(r["qid"], r["doc_id"]): r["score"] for r in S.proximity_bonus(index, S.topk(S.score(index, t), 100), t, 1.0).collect()}
    assert close[(0, "d1")] == pytest.approx(plain[(0, "d1")] + 0.5, abs=1e-5)
    assert close[(1, "d9")] == pytest.approx(plain[(1, "d9")] + 0.5, abs=1e-5)
    pairs = S.ordered_pairs(q)
    both = {(r["qid"], r["doc_id"]): r["score"] for r in S.bigram_bonus(index, S.topk(S.score(index, t), 100), pairs, 0.25).collect()}
    assert set(both) == set(plain) and all(both[x] >= plain[x] - 1e-9 for x in plain)


def test_explained_parts_add_up(spark, index):
    t = S.query_terms(queries(spark, *TEXTS))
    for r in S.explain(index, t, 5).groupBy("qid", "doc_id").agg(F.sum("contribution").alias("s"), F.max("score").alias("score")).collect():
        assert r["s"] == pytest.approx(r["score"], abs=1e-4)


def test_feedback_adds_terms(spark, index):
    t = S.query_terms(queries(spark, "bark"))
    assert S.relevance_feedback(index, t, 10).count() > S.bm25(index, t).count()


def test_catalog(spark, index, tmp_path):
    index.save(str(tmp_path / "pets"))
    c = Catalog(spark, str(tmp_path), cache=1)
    assert c.datasets() == ["pets"]
    c.alias("animals", "pets")
    assert c.search("animals", "cat") is c.search("pets", "cat")
    assert len(c.timed("animals", "cat")) == len(c.timed("pets", "cat")) > 0
    assert set(c.metrics("pets")) == {"p50", "p95", "p99"} and c.stats("pets")["n_docs"] == 10
    with pytest.raises(KeyError):
        c.alias("x", "missing")


def test_empty_corpus(spark, tmp_path):
    i = I.build(spark.createDataFrame([], "doc_id string, text string"), str(tmp_path / "e"))
    assert i.n_docs == 0 and search(i, "cat").count() == 0


def test_golden_animals(spark, tmp_path):
    """With an edge between cat and kitten the blend finds both; without the expanded part only the word itself."""
    rows = [("cat", "a cat purrs"), ("kitten", "a kitten naps"), ("dog", "a dog barks"), ("fish", "fish swim")]
    corpus = spark.createDataFrame(rows, "doc_id string, text string")
    i = I.build(corpus, str(tmp_path / "a"), BuildConfig(stop_df=1.0))
    edges = spark.createDataFrame([("kitten", "cat", 0.8)], "src string, dst string, sim double")
    from termloom.operators.expand import expanded

    wide = expanded(i.postings.select("term", "doc_id", "tf"), edges).join(i.docs.select("doc_id", "dl"), "doc_id")
    i = dataclasses.replace(i, postings=wide)
    t = S.query_terms(queries(spark, "cat"))
    assert [r["doc_id"] for r in S.blended(i, t, 10, 0.0).collect()] == ["cat"]
    assert [r["doc_id"] for r in S.blended(i, t, 10, 0.5).orderBy("rank").collect()] == ["cat", "kitten"]


@pytest.mark.parametrize("mode", [{"prf": True, "prf_k": 2}, {"mmr_lambda": 0.5}, {"features": True}])
def test_modes_obey_the_other_options(index, mode):
    ids = lambda text, **o: [r["doc_id"] for r in search(index, text, SearchOptions(**mode, **o)).orderBy("rank").collect()]
    assert {"d1", "d5"} <= set(ids("cat mat")) and not {"d1", "d4", "d5", "d9"} & set(ids("cat -mat"))
    assert set(ids('"cat sat" mat')) == {"d1", "d5"} and len(ids('"cat sat" mat', dedup=True)) == 1
    assert {"d9"} <= set(ids("cat", filters=({"field": "lang", "eq": "de"},))) <= {"d8", "d9", "d10"}
    every = ids("cat mat")
    assert len(every) > 2 and ids("cat mat", k=2, offset=1)[:1] == every[1:2]


@pytest.mark.parametrize("options", [{"alpha": 0.0}, {"alpha": 0.3}, {"alpha": 0.5, "qexp_weight": 0.5}])
def test_alternatives_leave_other_queries_alone(spark, index, options):
    o = SearchOptions(payload=False, bigram_weight=0.0, **options)
    key = lambda df: sorted((r["doc_id"], r["score"]) for r in df.collect())
    both = search(index, queries(spark, "kitten mat", "bark|animal"), o)
    assert key(both.where("qid = 0")) == key(search(index, "kitten mat", o))
    assert key(both.where("qid = 1")) == key(search(index, "bark|animal", o))
