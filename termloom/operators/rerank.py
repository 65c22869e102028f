"""Second-stage ranking: tree ensembles as Column expressions, and pluggable scorers in batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators import search as S
from termloom.plans.index import Index

FEATURES = ("combined", "exact", "semantic", "coverage", "doc_len", "log_doc_len", "semantic_share", "reciprocal_rank")


def load_model(path: str) -> dict:
    """A tree ensemble dumped as JSON: ``{max_feature_idx, tree_info: [{tree_structure}]}``."""
    with open(path) as f:
        return check_model(json.load(f))


def check_model(model: Mapping) -> dict:
    def visit(node: Mapping) -> None:
        if "leaf_value" in node and "split_feature" not in node:
            return
        if node.get("decision_type", "<=") != "<=":
            raise ValueError("only splits of the kind <= are supported")
        if node["split_feature"] > model["max_feature_idx"]:
            raise ValueError("a split names a feature that the model hasn't")
        visit(node["left_child"])
        visit(node["right_child"])

    for tree in model["tree_info"]:
        visit(tree["tree_structure"])
    return dict(model)


def _tree(node: Mapping, columns: list[Column]) -> Column:
    if "split_feature" not in node:
        return F.lit(float(node["leaf_value"]))
    value = columns[node["split_feature"]].cast("double")
    missing = value.isNull() | F.isnan(value)
    left = F.when(missing, F.lit(bool(node.get("default_left", True)))).otherwise(value <= float(node["threshold"]))
    return F.when(left, _tree(node["left_child"], columns)).otherwise(_tree(node["right_child"], columns))


def ensemble(model: Mapping, columns: list[Column]) -> Column:
    """The sum of the trees' leaves, as nested CASE expressions that stay in the JVM."""
    out = F.lit(0.0)
    for tree in model["tree_info"]:
        out = out + _tree(tree["tree_structure"], columns)
    return out


def _described(best: DataFrame) -> DataFrame:
    """(qid, doc_id, rank, and the eight FEATURES) of ranked rows of ``search.features``."""
    return best.select(
        "qid", "doc_id", "rank", F.col("score").alias("combined"), "exact", "semantic", "coverage", "doc_len",
        F.log(1 + F.col("doc_len")).alias("log_doc_len"), (F.col("semantic") / F.greatest("score", F.lit(1e-6))).alias("semantic_share"),
        (1 / F.col("rank")).alias("reciprocal_rank"),
    )


def candidates(index: Index, terms: DataFrame, depth: int = 100) -> DataFrame:
    """(qid, doc_id, rank, and the eight FEATURES) of the ``depth`` best."""
    return _described(S.features(index, terms, depth))


def by_trees(best: DataFrame, model: Mapping) -> DataFrame:
    """(qid, doc_id, score) of ranked rows of ``search.features``, by the ensemble."""
    score = F.round(ensemble(check_model(model), [F.col(c) for c in FEATURES]), 6)
    return _described(best).select("qid", "doc_id", score.alias("score"))


def rerank_trees(index: Index, terms: DataFrame, model: Mapping, k: int = 10, depth: int = 100) -> DataFrame:
    """The ``depth`` best by BM25, ranked anew by the ensemble's score."""
    return S.topk(by_trees(S.features(index, terms, min(max(depth, 100), 10_000)), model), k)


def rerank_pairs(hits: DataFrame, queries: DataFrame, corpus: DataFrame, scorer: Callable, k: int = 10, depth: int = 50, chars: int = 1200) -> DataFrame:
    """The ``depth`` best (10 to 500) scored anew by ``scorer(queries, texts) -> scores``, in Arrow batches.

    A text's first ``chars`` characters are what the scorer sees, as such models read no more.
    """
    near = S.topk(hits.drop("rank"), min(max(depth, 10), 500)).select("qid", "doc_id")
    rows = near.join(queries.select("qid", F.col("text").alias("query")), "qid").join(
        corpus.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text")), "doc_id"
    )
    kinds = dict(rows.dtypes)

    def run(frames):
        for f in frames:
            yield f[["qid", "doc_id"]].assign(score=[float(s) for s in scorer(f["query"].tolist(), f["text"].tolist())])

    scored = rows.mapInPandas(run, f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, score double")
    return S.topk(scored.withColumn("score", F.round("score", 6)), k)


def onnx_scorer(folder: str) -> Callable:
    """A cross-encoder in ``folder`` (model-int8.onnx or model.onnx, tokenizer.json), loaded once in each worker."""
    state: dict = {}

    def score(queries, texts):
        import os

        import numpy as np
        import onnxruntime
        from tokenizers import Tokenizer

        if not state:
            path = next(p for p in (f"{folder}/model-int8.onnx", f"{folder}/model.onnx") if os.path.exists(p))
            state["model"], state["words"] = onnxruntime.InferenceSession(path), Tokenizer.from_file(f"{folder}/tokenizer.json")
            state["words"].enable_truncation(192)
            state["words"].enable_padding()
        codes = state["words"].encode_batch(list(zip(queries, texts, strict=True)))
        feed = {"input_ids": [c.ids for c in codes], "attention_mask": [c.attention_mask for c in codes], "token_type_ids": [c.type_ids for c in codes]}
        names = {i.name for i in state["model"].get_inputs()}
        out = state["model"].run(None, {n: np.array(v, np.int64) for n, v in feed.items() if n in names})[0]
        return np.asarray(out).reshape(len(codes), -1)[:, 0]

    return score


def teacher_grades(scored: DataFrame) -> DataFrame:
    """(qid, doc_id, grade): by a teacher's score t, the 2 best get 4, to 5: 3, to 10: 2, to 20: 1, the others 0."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("t"), "doc_id"))
    grade = F.when(rank <= 2, 4).when(rank <= 5, 3).when(rank <= 10, 2).when(rank <= 20, 1).otherwise(0)
    return scored.select("qid", "doc_id", grade.alias("grade"))


def split_queries(rows: DataFrame, share: float = 0.2) -> DataFrame:
    """Rows with ``held``: whether their qid belongs to the validation share, by a digest of it."""
    draw = F.conv(F.substring(F.md5(F.col("qid").cast("string")), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    return rows.withColumn("held", draw < share)
