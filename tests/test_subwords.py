from pyspark.sql import functions as F

from termloom.functions.subwords import tokeniser
from termloom.plans import index as I
from termloom.plans.config import BuildConfig, SearchOptions
from termloom.plans.search import search


def test_wordpiece_index(spark, tmp_path):
    vocab = tmp_path / "vocab.txt"
    vocab.write_text("\n".join(["[UNK]", "[CLS]", "cat", "##s", "mat", "dog", "sat", "on", "##-", ".", "the", "play", "##ing"]))
    rows = [("a", "The cats sat on the mat."), ("b", "dogs playing"), ("c", None), ("d", "mat on cats"), ("e", "unknownword [CLS]")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", tokeniser(str(vocab))(F.col("text")).alias("t")).collect()}
    assert got == {"a": ["the", "cat", "##s", "sat", "on", "the", "mat"], "b": ["dog", "##s", "play", "##ing"], "c": [], "d": ["mat", "on", "cat", "##s"], "e": []}
    i = I.build(df, str(tmp_path / "i"), BuildConfig(tokenizer=str(vocab)))
    weights = {r["term"]: r["idf"] for r in i.vocab.collect()}
    assert weights["##s"] < weights["cat"]
    ids = lambda q: {r["doc_id"] for r in search(i, q, SearchOptions(alpha=0.0)).collect()}
    assert ids("cat") == {"a", "d"} and ids("cat -sat") == {"d"} and ids("sat|dog") == {"a", "b"} and ids('"on the mat" mat') == {"a"}
