"""Scoring of a batch of queries against an index.

All operators take queries as rows: ``(qid, term)`` with distinct terms.  A batch of up to ``place.LIMIT``
entries travels to the documents and is scored where they lie.  A larger one meets the postings by term (Spark
broadcasts it when its measured size allows, and shuffles both by term when not); lengths travel with the
postings, so scoring needs no join with the documents.  Ranking is by the score rounded to 6 decimals, then by doc_id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions.subwords import tokeniser
from termloom.operators import build as B
from termloom.operators import expand as E
from termloom.operators import place as L
from termloom.operators.place import Only
from termloom.plans.config import BuildConfig
from termloom.plans.index import Index, settled


def saturate(w: Column, dl: Column, avgdl: float, config: BuildConfig) -> Column:
    """BM25's saturated frequency; 0 where there is no posting."""
    length = 1 - config.b + config.b * dl / F.lit(float(avgdl) or 1.0)
    return F.when(w > 0, w * (config.k1 + 1) / (w + config.k1 * length) + config.delta).otherwise(0.0)


def _distinct(queries: DataFrame, text: Column, config: BuildConfig) -> DataFrame:
    said = queries.select("qid", tokeniser(config.tokenizer)(text).alias("terms"))
    return said.select("qid", F.explode(F.array_distinct("terms")).alias("term"))


def query_terms(queries: DataFrame, config: BuildConfig = BuildConfig()) -> DataFrame:
    """(qid, term) of the words that each query (qid, text) includes."""
    return _distinct(queries, T.included_text(F.col("text")), config)


def excluded_terms(queries: DataFrame, config: BuildConfig = BuildConfig()) -> DataFrame:
    """(qid, term) of the words that each query excludes."""
    return _distinct(queries, T.excluded_text(F.col("text")), config)


def ordered_pairs(queries: DataFrame, config: BuildConfig = BuildConfig()) -> DataFrame:
    """(qid, t1, t2) of neighbouring words, stopwords included, once for each occurrence."""
    said = queries.select("qid", tokeniser(config.tokenizer)(T.included_text(F.col("text"))).alias("terms"))
    words = said.select("qid", F.posexplode("terms").alias("pos", "t1"))
    after = F.lead("t1").over(Window.partitionBy("qid").orderBy("pos"))
    return words.select("qid", "t1", after.alias("t2")).where("t2 IS NOT NULL")


def or_groups(queries: DataFrame, config: BuildConfig = BuildConfig()) -> DataFrame:
    """(qid, grp, term)."""
    if config.tokenizer:
        words = queries.select("qid", F.posexplode(F.split("text", r"\s+")).alias("pos", "word"))
        parts = words.select("qid", "pos", F.filter(F.split("word", r"\|"), lambda p: p != "").alias("parts"))
        each = parts.select("qid", "pos", (F.size("parts") > 1).alias("many"), F.explode("parts").alias("part"))
        each = each.select("qid", "pos", "many", tokeniser(config.tokenizer)(F.col("part")).alias("terms"))
        each = each.select("qid", "pos", "many", F.explode("terms").alias("term"))
        return each.select("qid", F.when(F.col("many"), F.concat("pos", F.lit("|"))).otherwise(F.concat("pos", F.lit(" "), "term")).alias("grp"), "term").distinct()
    groups = queries.select("qid", F.posexplode(T.or_groups(F.col("text"))).alias("grp", "terms"))
    return groups.select("qid", "grp", F.explode("terms").alias("term"))


def lookup(index: Index, terms: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """The postings of the terms, with their idf and all columns of ``terms``."""
    known = terms.join(index.vocab.select("term", "idf"), "term").where("idf > 0")
    return (index.postings if postings is None else postings).join(known, "term")


def _parts(index: Index, alpha: float) -> Column:
    combined = saturate(F.col("w"), F.col("dl"), index.avgdl, index.config)
    if alpha >= 1:
        return F.col("idf") * combined
    exact = saturate(F.col("tf"), F.col("dl"), index.avgdl, index.config)
    return F.col("idf") * exact if alpha <= 0 else F.col("idf") * (alpha * combined + (1 - alpha) * exact)


def _in_place(index: Index, entries: DataFrame, alpha: float, only: Only, **how) -> DataFrame | None:
    place = index.here()
    if place is None or (only.phrases is not None and place.counted):
        return None
    return L.score(place, index.vocab, index.avgdl, index.config, entries, alpha, only, **how)


def documents(index: Index) -> DataFrame:
    """(doc_id, terms, fields) of all documents; what else ``docs`` has may take more to compute."""
    place = index.here()
    return index.docs if place is None or place.counted else place.rows


def _narrowed(index: Index, hits: DataFrame, only: Only) -> DataFrame:
    """The hits (qid, doc_id, ...) that ``only`` wants, by joins."""
    if only.excluded is not None:
        hits = exclude(index, hits, only.excluded)
    if only.where is not None:
        hits = hits.join(documents(index).where(only.where).select("doc_id"), "doc_id", "left_semi")
    if only.phrases is not None:
        hits = _hold_phrases(index, hits, only.phrases)
    return hits.join(documents(index).select("doc_id", *only.carry), "doc_id") if only.carry else hits


def _six(hits: DataFrame, only: Only) -> DataFrame:
    return hits.select("qid", "doc_id", F.round("score", 6).alias("score"), *only.carry)


def score(index: Index, terms: DataFrame, alpha: float = 1.0, only: Only = Only()) -> DataFrame:
    """(qid, doc_id, score) of every document that scores above 0.

    ``alpha`` blends the expanded postings with the exact ones: 1 takes the expanded alone, 0 the exact.
    """
    alpha = min(max(alpha, 0.0), 1.0)
    hits = _in_place(index, terms, alpha, only)
    if hits is None:
        part = _parts(index, alpha)
        if "weight" in terms.columns:
            part = part * F.col("weight")
        hits = lookup(index, terms).groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))
        hits = _narrowed(index, hits.where("score > 0"), only)
    return _six(hits, only)


def _postings_of(index: Index, best: DataFrame, joined) -> DataFrame:
    """The postings of the documents of ``best`` (doc_id, ...); those of all where they aren't scored in place."""
    place = index.here()
    if place is None:
        return index.postings
    rows = place.rows.join(joined(best.select("doc_id").distinct()), "doc_id", "left_semi")
    if place.counted:
        rows = rows.withColumnRenamed("terms", "counts")
    else:
        rows = B.counted(rows.select("doc_id", "terms"), list(place.stops), index.config)
    lengthy = B.each(rows, F.col("counts"), "c", "doc_id", "dl").select("doc_id", "dl", "c.term", "c.tf")
    return E.expanded(lengthy, place.edges).select("term", "doc_id", "tf", "w", "dl")


def _rank(*order) -> Column:
    return F.row_number().over(Window.partitionBy("qid").orderBy(*order))


def topk(hits: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """(qid, rank, doc_id, score, ...): ranks offset + 1 to offset + k of each query.

    Spark limits the groups before it exchanges them, so no more than offset + k rows of a query and a
    partition travel.
    """
    ranked = hits.withColumn("rank", _rank(F.desc("score"), "doc_id"))
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def totals(hits: DataFrame) -> DataFrame:
    """(qid, total): all hits of each query."""
    return hits.groupBy("qid").agg(F.count("*").alias("total"))


def bm25(index: Index, terms: DataFrame, k: int = 10) -> DataFrame:
    return topk(score(index, terms, only=Only(best=k)), k)


def blended(index: Index, terms: DataFrame, k: int = 10, alpha: float = 0.5) -> DataFrame:
    return topk(score(index, terms, alpha, Only(best=k)), k)


def exclude(index: Index, hits: DataFrame, excluded: DataFrame) -> DataFrame:
    """Hits without the documents that hold an excluded word itself."""
    gone = index.postings.where("tf > 0").join(excluded, "term").select("qid", "doc_id")
    return hits.join(gone, ["qid", "doc_id"], "left_anti")


def score_groups(index: Index, groups: DataFrame, only: Only = Only()) -> DataFrame:
    """Each group of alternatives (qid, grp, term) counts with its best term."""
    hits = _in_place(index, groups, 1.0, only)
    if hits is None:
        best = lookup(index, groups).groupBy("qid", "doc_id", "grp").agg(F.max(_parts(index, 1.0)).alias("part"))
        hits = best.groupBy("qid", "doc_id").agg(F.sum("part").alias("score")).where("score > 0")
        hits = _narrowed(index, hits, only)
    return _six(hits, only)


def query_expansion(index: Index, terms: DataFrame, weight: float) -> DataFrame:
    """(qid, term, weight): neighbours of the query's terms that it doesn't hold, the best edge of each."""
    near = terms.join(index.neighbours, terms["term"] == F.col("src")).groupBy("qid", F.col("dst").alias("term")).agg((weight * F.max("sim")).alias("weight"))
    return near.join(terms, ["qid", "term"], "left_anti")


def score_expanded_query(index: Index, terms: DataFrame, weight: float, alpha: float = 0.5, only: Only = Only()) -> DataFrame:
    """The blended score, and that of the neighbours on the exact postings at their weight."""
    wider = query_expansion(index, terms, weight)
    one = lambda x: F.lit(float(x))
    both = terms.select("qid", "term", one(1).alias("weight"), one(min(max(alpha, 0), 1)).alias("alpha")).unionByName(wider.select("qid", "term", "weight", one(0).alias("alpha")))
    total = _in_place(index, both, alpha, only)
    if total is None:
        own = lookup(index, terms).select("qid", "doc_id", _parts(index, alpha).alias("part"))
        near = lookup(index, wider).where("tf > 0").select("qid", "doc_id", (_parts(index, 0.0) * F.col("weight")).alias("part"))
        total = own.unionByName(near).groupBy("qid", "doc_id").agg(F.sum("part").alias("score")).where("score > 0")
        total = _narrowed(index, total, only)
    return _six(total, only)


def features(index: Index, terms: DataFrame, k: int, offset: int = 0, only: Only = Only(), allowed: DataFrame | None = None) -> DataFrame:
    """Of the k best: combined, exact and semantic score, coverage of the query, document length.

    ``only``, ``allowed`` (qid, doc_id): the only hits that may be returned.
    """
    window = only.all() if allowed is not None else replace(only, best=k + offset)
    both = _in_place(index, terms, 1.0, window, both=True)
    if both is None:
        both = lookup(index, terms).groupBy("qid", "doc_id").agg(
            F.sum(_parts(index, 1.0)).alias("score"), F.sum(_parts(index, 0.0)).alias("exact"), F.max("dl").alias("doc_len")
        )
        both = _narrowed(index, both.where("score > 0"), only)
    found = terms.join(index.vocab.where("idf > 0").select("term", F.lit(1).alias("known")), "term", "left")
    coverage = found.groupBy("qid").agg((F.count("known") / F.count("*")).alias("coverage"))
    both = both.withColumnRenamed("score", "combined").withColumn("score", F.round("combined", 6))
    best = topk(both if allowed is None else both.join(allowed, ["qid", "doc_id"], "left_semi"), k, offset)
    six = lambda c: F.round(c, 6)
    return best.join(coverage, "qid").select(
        "qid", "rank", "doc_id", "score", six(F.greatest("exact", F.lit(0.0))).alias("exact"),
        six(F.greatest(F.col("combined") - F.col("exact"), F.lit(0.0))).alias("semantic"), six("coverage").alias("coverage"), "doc_len",
    )


def tier_window(k: int) -> int:
    """Hits that tiers put in order."""
    return max(5 * k, k + 50)


def rank_tiers(index: Index, hits: DataFrame, tiers: Sequence[tuple[str, bool]], k: int = 10, band: float = 0.10) -> DataFrame:
    """Hits by bands of score below the query's best; within a band by the tiers' columns, then score.

    The band is a share of the best score (0 to 1; 0 makes one band of all).  A missing value counts 0.
    """
    unknown = [name for name, _ in tiers if name not in documents(index).columns]
    if unknown:
        raise ValueError(f"unknown rank field {unknown[0]}")
    if not tiers:
        return topk(hits, k)
    band = min(max(band, 0.0), 1.0)
    near = topk(hits, tier_window(k)).withColumn("best", F.max("score").over(Window.partitionBy("qid")))
    bucket = F.floor(F.round((F.col("best") - F.col("score")) / (F.col("best") * band), 9)).cast("int") if band else F.lit(0)
    rows = near.join(documents(index).select("doc_id", *{name: None for name, _ in tiers}), "doc_id").withColumn("bucket", bucket)
    keys = [(F.coalesce(F.col(name).cast("double"), F.lit(0.0)).asc() if up else F.coalesce(F.col(name).cast("double"), F.lit(0.0)).desc()) for name, up in tiers]
    ranked = rows.withColumn("rank", _rank("bucket", *keys, F.desc("score"), "doc_id"))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "doc_id", "score", "bucket")


def explain(index: Index, terms: DataFrame, k: int = 5) -> DataFrame:
    """(qid, rank, doc_id, score, term, idf, tf, contribution): what each term gives to the k best."""
    best, joined = settled(topk(score(index, terms, only=Only(best=k)), k))
    parts = lookup(index, terms, _postings_of(index, best, joined)).withColumn("contribution", _parts(index, 1.0)).where("contribution > 0")
    six = lambda c: F.round(c, 6).alias(c)
    return parts.join(best, ["qid", "doc_id"]).select("qid", "rank", "doc_id", "score", "term", six("idf"), F.round("w", 6).alias("tf"), six("contribution"))


def facets(index: Index, hits: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(qid, field, value, count) over all hits; values as strings, one pass for all fields."""
    rows = hits if set(fields) <= set(hits.columns) else hits.select("qid", "doc_id").join(documents(index).select("doc_id", *fields), "doc_id")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return rows.select("qid", each.alias("f")).groupBy("qid", "f.field", "f.value").agg(F.count("*").alias("count"))


def bigram_bonus(index: Index, hits: DataFrame, pairs: DataFrame, weight: float = 0.25) -> DataFrame:
    """Hits with weight * idf added for each neighbouring pair of the query that the document has too."""
    # the candidates are few; they and the query's pairs select the bigrams that are read
    has = index.bigrams.join(pairs, ["t1", "t2"]).join(hits.select("qid", "doc_id"), ["qid", "doc_id"])
    bonus = has.groupBy("qid", "doc_id").agg(F.sum("idf").alias("bonus"))
    total = F.round(F.col("score") + weight * F.coalesce("bonus", F.lit(0.0)), 6)
    return hits.join(bonus, ["qid", "doc_id"], "left").withColumn("score", total).drop("bonus", "rank")


def proximity_bonus(index: Index, hits: DataFrame, terms: DataFrame, weight: float = 1.0) -> DataFrame:
    """Hits with weight / (1 + gap) added, gap being the smallest distance of two different query terms.

    The closest two are neighbours among the occurrences of query terms, so one window finds them.
    """
    # the hits' documents alone are taken apart
    hits, joined = settled(hits)
    said = documents(index).select("doc_id", "terms").join(joined(hits.select("qid", "doc_id")), "doc_id")
    places = said.select("qid", "doc_id", F.posexplode("terms").alias("pos", "term")).join(terms, ["qid", "term"])
    order = Window.partitionBy("qid", "doc_id").orderBy("pos")
    gap = F.when(F.lag("term").over(order) != F.col("term"), F.col("pos") - F.lag("pos").over(order))
    least = places.withColumn("gap", gap).groupBy("qid", "doc_id").agg(F.min("gap").alias("gap"))
    total = F.round(F.col("score") + F.coalesce(weight / (1 + F.col("gap")), F.lit(0.0)), 6)
    return hits.join(least, ["qid", "doc_id"], "left").withColumn("score", total).drop("gap", "rank")


def quoted_phrases(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, phrases): the words of each quoted phrase."""
    quoted = queries.select("qid", T.phrases(F.col("text")).alias("phrases"))
    if index.config.tokenizer:
        runs = queries.select("qid", F.posexplode(F.regexp_extract_all("text", F.lit('"([^"]*)"'), F.lit(1))).alias("n", "run"))
        runs = runs.select("qid", tokeniser(index.config.tokenizer)(F.col("run")).alias("p")).where(F.size("p") > 0)
        none = F.array().cast("array<array<string>>")
        listed = runs.groupBy("qid").agg(F.collect_list("p").alias("phrases"))
        quoted = queries.select("qid").join(listed, "qid", "left").select("qid", F.coalesce("phrases", none).alias("phrases"))
    return quoted


def with_phrases(index: Index, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits that hold every quoted phrase of their query word for word.

    The postings decide first which documents hold all of the phrases' indexed words; only those are
    compared with the phrases, as strings of words between blanks.
    """
    return _hold_phrases(index, hits, quoted_phrases(index, queries))


def _hold_phrases(index: Index, hits: DataFrame, quoted: DataFrame) -> DataFrame:
    wanted = quoted.select("qid", F.explode(F.array_distinct(F.flatten("phrases"))).alias("term"))
    # stopwords have no postings: a query whose phrases hold nothing else is decided by comparison alone
    known = wanted.join(index.vocab.select("term"), "term")
    needed = known.groupBy("qid").agg(F.count("*").alias("needed"))
    holds = index.postings.where("tf > 0").join(known, "term").groupBy("qid", "doc_id").agg(F.count("*").alias("n"))
    near = hits.join(needed, "qid", "left").join(holds, ["qid", "doc_id"], "left")
    near = near.where(F.coalesce("n", F.lit(0)) == F.coalesce("needed", F.lit(0))).drop("n", "needed")
    blank = F.lit(" ")
    said = documents(index).select("doc_id", F.concat(blank, F.array_join("terms", " "), blank).alias("__said"))
    rows = near.join(quoted, "qid").join(said, "doc_id")
    found = F.forall("phrases", lambda p: F.contains(F.col("__said"), F.concat(blank, F.array_join(p, " "), blank)))
    return rows.where(found).drop("phrases", "__said")


def canonical_only(index: Index, hits: DataFrame) -> DataFrame:
    """Hits that aren't a later copy of the same text."""
    return hits.join(index.docs.where("canonical").select("doc_id"), "doc_id", "left_semi")


def relevance_feedback(index: Index, terms: DataFrame, k: int = 10, prf_k: int = 10, prf_t: int = 10, alpha: float = 0.3) -> DataFrame:
    """Rocchio: the prf_t best terms of the prf_k best documents join the query, the best at weight alpha."""
    return topk(feedback_score(index, terms, prf_k, prf_t, alpha, Only(best=k)), k)


def feedback_score(index: Index, terms: DataFrame, prf_k: int = 10, prf_t: int = 10, alpha: float = 0.3, only: Only = Only()) -> DataFrame:
    """(qid, doc_id, score) of all hits of the queries that feedback has widened.  ``only`` is for the widened ones."""
    first, joined = settled(topk(score(index, terms, only=Only(best=prf_k)), prf_k).select("qid", "doc_id"))
    # the documents themselves have these terms; the postings are read for the widened queries alone
    if index.here() is None:
        said = first.join(index.forward, "doc_id").select("qid", "dl", F.explode("terms").alias("t")).select("qid", "dl", "t.term", "t.tf")
    else:
        said = _postings_of(index, first, joined).where("tf > 0").join(joined(first), "doc_id").select("qid", "dl", "term", "tf")
    said = said.join(index.vocab.select("term", "idf"), "term").join(terms, ["qid", "term"], "left_anti")
    weight = F.sum(F.col("idf") * F.col("tf") / F.greatest(F.col("dl"), F.lit(1)))
    weighed = said.where("idf > 0").groupBy("qid", "term").agg(F.round(weight, 9).alias("w"))
    chosen = weighed.withColumn("rank", _rank(F.desc("w"), "term")).where(F.col("rank") <= prf_t)
    most = F.max("w").over(Window.partitionBy("qid"))
    extra = chosen.select("qid", "term", (alpha * F.col("w") / most).alias("weight"))
    wider, _ = settled(terms.select("qid", "term", F.lit(1.0).alias("weight")).unionByName(extra))
    return score(index, wider, only=only)


def mmr_window(k: int) -> int:
    """Candidates among which k are chosen."""
    return max(3 * k, k + 20)


def diversify(index: Index, terms: DataFrame, k: int = 10, lam: float = 0.7, offset: int = 0, hits: DataFrame | None = None) -> DataFrame:
    """Maximal marginal relevance over max(3k, k + 20) candidates of each query.

    A candidate's vector is what each query term gives to its score.  The greedy choice is sequential, so
    it runs in Python, once for each query and on its candidates alone.  ``hits`` are those to choose from;
    a page at an offset is cut from the choice of offset + k.
    """
    lam = min(max(lam, 0.0), 1.0)
    k += offset
    window = mmr_window(k)
    near, joined = settled(topk(score(index, terms, only=Only(best=window)) if hits is None else hits, window).select("qid", "doc_id", "score"))
    parts = lookup(index, terms, _postings_of(index, near, joined)).withColumn("part", _parts(index, 1.0)).where("part > 0").select("qid", "doc_id", "term", "part")
    rows = parts.join(near, ["qid", "doc_id"])
    kind = dict(near.dtypes)["doc_id"], dict(terms.dtypes)["qid"]

    def choose(pdf):
        import numpy as np
        import pandas as pd

        m = pdf.pivot_table(index="doc_id", columns="term", values="part", fill_value=0.0)
        rel = pdf.groupby("doc_id")["score"].first().reindex(m.index)
        order = np.lexsort((m.index, -rel.to_numpy()))
        ids, v, s = m.index.to_numpy()[order], m.to_numpy()[order], rel.to_numpy()[order]
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        like, worth = np.zeros(len(s)), s / max(s.max(), 1e-9)
        left, picked = np.ones(len(s), bool), []
        for i in range(min(k, len(s))):
            value = np.where(left, np.round(lam * worth - (1 - lam) * like, 9) if i else worth, -np.inf)
            best = int(value.argmax())
            picked.append(best)
            left[best] = False
            like = np.maximum(like, v @ v[best])
        return pd.DataFrame({"qid": pdf["qid"].iloc[0], "rank": np.arange(1, len(picked) + 1, dtype=np.int32), "doc_id": ids[picked], "score": s[picked]})

    chosen = rows.groupBy("qid").applyInPandas(choose, f"qid {kind[1]}, rank int, doc_id {kind[0]}, score double")
    return chosen.where(F.col("rank") > offset) if offset else chosen


def pruned(index: Index, terms: DataFrame, k: int = 10) -> DataFrame:
    """The same rows as ``bm25``, by term upper bounds (after WAND).

    The k-th best score on each query's rarest term alone is a threshold.  Documents that hold none of
    the terms whose bounds are needed to reach it can't be among the k best, so their postings are left
    out before the scores are summed.
    """
    # a posting's bound: idf * (k1 + 1 + delta)
    bound = F.col("idf") * (index.config.k1 + 1 + index.config.delta)
    known = terms.join(index.vocab.select("term", "idf"), "term").where("idf > 0").select("qid", "term", "idf", bound.alias("ub"))
    by = Window.partitionBy("qid").orderBy("ub", "term")
    ordered = known.withColumn("below", F.sum("ub").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rarest = known.withColumn("n", _rank(F.desc("idf"), "term")).where("n = 1").select("qid", "term")
    floor = topk(score(index, rarest, only=Only(best=k)), k).groupBy("qid").agg(F.count("*").alias("found"), F.min("score").alias("least"))
    # terms whose bounds, with all smaller ones, stay under the threshold decide nothing alone
    theta = F.when(F.col("found") >= k, F.col("least")).otherwise(0.0)
    needed = ordered.join(floor, "qid", "left").where(F.col("below") >= F.coalesce(theta, F.lit(0.0)) - 1e-6).select("qid", "term")
    only = Only(best=k)
    inside = _in_place(index, terms, 1.0, only, required=settled(needed)[0])
    if inside is not None:
        return topk(_six(inside, only), k)
    may = index.postings.where("w > 0").join(needed, "term").select("qid", "doc_id").distinct()
    hits = lookup(index, terms).join(may, ["qid", "doc_id"], "left_semi").groupBy("qid", "doc_id").agg(F.sum(_parts(index, 1.0)).alias("score"))
    return topk(hits.where("score > 0").select("qid", "doc_id", F.round("score", 6).alias("score")), k)
