"""Index tables from a corpus ``(doc_id, text[, title])``.

Every operator is a declarative plan.  A document is one row, and what only concerns it (its terms' counts,
its length, its neighbouring words) is computed from its array of terms in place: only what is counted
over the corpus is exchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions.subwords import tokeniser
from termloom.plans.config import BuildConfig


def body(corpus: DataFrame, config: BuildConfig) -> Column:
    """The text that is indexed: title and text in one where there is a title."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if config.clean:
        text = T.clean(text)
    if "title" in corpus.columns:
        text = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat_ws(" ", "title", text)).otherwise(text)
    return text


def terms(corpus: DataFrame, config: BuildConfig = BuildConfig()) -> DataFrame:
    """(doc_id, terms[, title_terms]): the words of each document, stopwords included."""
    tokens = tokeniser(config.tokenizer)
    extra = [tokens(F.col("title")).alias("title_terms")] if "title" in corpus.columns else []
    return corpus.where("doc_id IS NOT NULL").select("doc_id", tokens(body(corpus, config)).alias("terms"), *extra)


def each(rows: DataFrame, array: Column, name: str, *columns: str) -> DataFrame:
    """(columns, name) for each element of the array.

    An inner generator would be preceded by a filter on the array's size, which computes the array, and the
    tokens that it is made of, once more.
    """
    return rows.select(*columns, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def spread(corpus: DataFrame) -> DataFrame:
    """The rows over all cores, where the table has fewer files than there are; many files stay as they lie."""
    cores, files = corpus.sparkSession.sparkContext.defaultParallelism, len(corpus.inputFiles())
    return corpus.repartition(cores) if 0 < files < cores else corpus


def positions(tokenised: DataFrame) -> DataFrame:
    """(doc_id, pos, term) of every word."""
    return tokenised.select("doc_id", F.posexplode_outer("terms").alias("pos", "term")).where("term IS NOT NULL")


def document_frequency(tokenised: DataFrame) -> DataFrame:
    """(term, df): documents that hold each word."""
    return each(tokenised, F.array_distinct("terms"), "term").groupBy("term").agg(F.count("*").alias("df"))


def stopwords(df: DataFrame, n_docs: int, config: BuildConfig = BuildConfig()) -> DataFrame:
    """(term): words in more than floor(stop_df * N) documents; none under 10 documents.

    A document holds each of them once at most in df, so there are no more than a document has distinct
    words on average, over stop_df: a list of them is bounded whatever the corpus.
    """
    limit = int(config.stop_df * n_docs) if n_docs >= 10 else n_docs
    return df.where(F.col("df") > limit).select("term")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once and not for each element that refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def runs(words: Column) -> Column:
    """(term, tf) of an array's distinct elements, sorted: the lengths of the runs of the sorted array."""

    def of(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, F.greatest(i - 1, F.lit(1))) != F.element_at(s, i)))
        count = lambda h, e: F.struct(F.element_at(s, h).alias("term"), (e - h).cast("bigint").alias("tf"))
        return _let(heads, lambda h: F.zip_with(h, F.concat(F.slice(h, F.lit(2), F.size(h)), F.array(F.size(s) + 1)), count))

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return _let(F.sort_array(words), lambda s: F.when(F.size(s) > 0, of(s)).otherwise(none))


def counted(tokenised: DataFrame, stops: list[str], config: BuildConfig = BuildConfig()) -> DataFrame:
    """The rows with ``kept`` (the words that are no stopwords, in order), ``counts`` (term, tf) and ``dl``.

    A title's words count round((title_weight - 1) * occurrences) more; terms left with nothing go.
    """
    known = lambda w: ~w.isin(stops) if stops else F.lit(True)
    rows = tokenised.withColumn("kept", F.filter("terms", known))
    rows = rows.withColumn("counts", runs(F.col("kept")))
    if "title_terms" in tokenised.columns:
        more = lambda t: F.round((config.title_weight - 1) * F.size(F.filter("title_terms", lambda w: w == t))).cast("bigint")
        added = F.transform("counts", lambda x: F.struct(x["term"].alias("term"), (x["tf"] + more(x["term"])).alias("tf")))
        weighed = F.filter(added, lambda x: x["tf"] > 0)
        rows = rows.withColumn("counts", F.when(F.size("title_terms") > 0, weighed).otherwise(F.col("counts")))
    else:  # without counting them
        return rows.withColumn("dl", F.size("kept").cast("bigint"))
    return rows.withColumn("dl", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x["tf"]))


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of counted documents."""
    return each(docs, F.col("counts"), "c", "doc_id").select("doc_id", "c.term", "c.tf")


def document_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, dl) of every counted document, also of those without a word."""
    return docs.select("doc_id", "dl")


def idf(df: Column, n: Column) -> Column:
    return F.when(df > 0, F.log((n - df + 0.5) / (df + 0.5) + 1)).otherwise(0.0)


def vocabulary(tf: DataFrame, n_docs: int, config: BuildConfig = BuildConfig()) -> DataFrame:
    """(term, df, idf) of the kept terms; a continuation piece (``##``) counts for less."""
    v = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.when(F.col("term").startswith("##"), config.subword_weight).otherwise(1.0)
    return v.withColumn("idf", idf(F.col("df"), F.lit(n_docs)) * weight)


def bigrams(docs: DataFrame, n_docs: int, config: BuildConfig = BuildConfig()) -> DataFrame:
    """(t1, t2, doc_id, idf): neighbouring kept words of each counted document, unless too rare or too common."""
    n = F.size("kept") - 1
    # as one string each, which are made distinct by hashing; words hold no blank
    listed = F.zip_with(F.slice("kept", F.lit(1), n), F.slice("kept", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    pairs = each(docs.select("doc_id", F.when(n > 0, F.array_distinct(listed)).alias("pairs")), F.col("pairs"), "pair", "doc_id")
    n = pairs.groupBy("pair").agg(F.count("*").alias("df")).where(F.col("df").between(2, max(2, int(config.bigram_max_df * n_docs))))
    word = lambda i: F.substring_index("pair", " ", i)
    return pairs.join(n, "pair").select(word(1).alias("t1"), word(-1).alias("t2"), "doc_id", idf(F.col("df"), F.lit(n_docs)).alias("idf"))


def forward_index(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, terms): each counted document's (term, tf), sorted; one without a counted word has no row."""
    some = docs.select("doc_id", "dl", F.when(F.size("counts") > 0, F.array("counts")).alias("some"))
    return each(some, F.col("some"), "terms", "doc_id", "dl")


def block_max(postings: DataFrame, vocab: DataFrame, avgdl: float, config: BuildConfig = BuildConfig(), size: int = 128) -> DataFrame:
    """(term, block, bound): the highest score of each run of ``size`` postings of a term, by doc_id.

    Postings are sorted by ranges of (term, doc_id), so a common term is spread over many slices; a
    posting's place is its rank within its slice, after the term's postings in earlier slices.
    """
    from termloom.operators.search import saturate
    from termloom.plans.index import work_folder

    spark, path = postings.sparkSession, f"{work_folder(postings.sparkSession)}/slices-{uuid.uuid4().hex}"
    bound = F.col("idf") * saturate(F.col("w"), F.col("dl"), avgdl, config)
    scored = postings.join(vocab.select("term", "idf"), "term").select("term", "doc_id", bound.alias("bound"))
    # written, as a slice must be the same for the counts and the ranks
    scored.repartitionByRange("term", "doc_id").withColumn("slice", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    earlier = Window.partitionBy("term").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("term", "slice").agg(F.count("*").alias("n"))
    counts = counts.select("term", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("term", "slice").orderBy("doc_id")) - 1
    ranked = placed.withColumn("rank", rank).join(counts, ["term", "slice"])
    return (
        ranked.select("term", F.floor((F.col("rank") + F.col("before")) / size).cast("bigint").alias("block"), "bound")
        .groupBy("term", "block").agg(F.max("bound").alias("bound"))
    )


def block_max_of_rows(rows: DataFrame, stops: tuple[str, ...], n_docs: int, avgdl: float, config: BuildConfig = BuildConfig(), size: int = 128) -> DataFrame:
    """The rows of ``block_max`` for documents (doc_id, terms), of distinct doc_ids; ``stops`` don't count.

    Documents lie in slices by doc_id, so a posting's place is its rank in its slice, after the term's postings in
    earlier slices; a slice gives one bound for each term and block.
    """
    from termloom.plans.index import work_folder

    spark, path = rows.sparkSession, f"{work_folder(rows.sparkSession)}/slices-{uuid.uuid4().hex}"
    # written, as a slice must be the same for the counts and the ranks
    kept = F.filter("terms", lambda w: ~w.isin(list(stops))) if stops else F.col("terms")
    slices = rows.select("doc_id", F.array_join(kept, " ").alias("said")).repartitionByRange("doc_id").withColumn("slice", F.spark_partition_id())
    slices.write.option("compression", "zstd").parquet(path)
    placed = spark.read.parquet(path)
    words = each(placed, F.array_distinct(F.split("said", " ")), "term", "slice").where("term <> ''")
    per = Window.partitionBy("term")
    earlier = per.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = words.groupBy("term", "slice").agg(F.count("*").alias("n"))
    counts = counts.select("term", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), idf(F.sum("n").over(per), F.lit(n_docs)).alias("idf"))
    k1, b, mean, delta = config.k1, config.b, float(avgdl) or 1.0, config.delta

    def bounds(docs, terms):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        docs = docs.sort_by("doc_id").combine_chunks()
        lists = pc.split_pattern(docs.column("said"), " ").combine_chunks()
        n = max(docs.num_rows, 1)
        doc = np.repeat(np.arange(docs.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        code = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms.column("term").combine_chunks()), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ok = code >= 0
        dl = np.bincount(doc[ok], minlength=n)
        key = np.sort(code[ok] * n + doc[ok])
        heads = lambda x: np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
        head = heads(key)
        term, doc = np.divmod(key[head], n)
        tf = np.diff(np.append(head, len(key)))
        bound = terms.column("idf").to_numpy()[term] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / mean)) + delta)
        block = (terms.column("before").to_numpy()[term] + np.arange(len(term)) - np.searchsorted(term, term)) // size
        # blocks ascend within a term
        first = heads(term * (block.max() + 1 if len(block) else 1) + block)
        most = np.maximum.reduceat(bound, first) if len(first) else bound
        return pa.table({"term": terms.column("term").take(pa.array(term[first])), "block": pa.array(block[first]), "bound": pa.array(most)})

    per_slice = placed.groupBy("slice").cogroup(counts.groupBy("slice")).applyInArrow(bounds, "term string, block bigint, bound double")
    return per_slice.groupBy("term", "block").agg(F.max("bound").alias("bound"))


def canonical(corpus: DataFrame) -> DataFrame:
    """(doc_id, canonical): whether a document is the first with its normalised text.

    Texts are compared whole; they travel as a digest of 256 bits.
    """
    return first_of_digest(corpus.where("doc_id IS NOT NULL").select("doc_id", digest(F.col("text")).alias("digest")))


def digest(text: Column) -> Column:
    return F.sha2(T.collapse_space(F.lower(T.normalize(F.coalesce(text, F.lit(""))))), 256)


def first_of_digest(rows: DataFrame) -> DataFrame:
    # partial minima first: a text with very many copies (an empty one) is no hot key
    return rows.join(_first(rows), "digest").select("doc_id", (F.col("doc_id") == F.col("first")).alias("canonical"))


def _first(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first"))


def later_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, digest) of the documents that are not the first with their digest."""
    many = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(many, "digest").where("doc_id <> first").select("doc_id", "digest").distinct()


def spell_words(corpus: DataFrame, config: BuildConfig = BuildConfig(), dictionary: DataFrame | None = None) -> DataFrame:
    """(word, df) of the words of at most 40 characters in spell_min_df documents or more, and a dictionary's."""
    return count_spell_words(corpus.where("doc_id IS NOT NULL").select(spelled(F.col("text")).alias("spelled")), config, dictionary)


def spelled(text: Column) -> Column:
    return F.array_distinct(T.split_words(F.lower(T.normalize(F.coalesce(text, F.lit(""))))))


def count_spell_words(rows: DataFrame, config: BuildConfig, dictionary: DataFrame | None = None) -> DataFrame:
    once = each(rows, F.col("spelled"), "word").where(F.length("word") <= 40)
    out = once.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") >= config.spell_min_df)
    if dictionary is not None:
        known = dictionary.select("word").distinct()
        out = out.unionByName(known.join(out, "word", "left_anti").withColumn("df", F.lit(config.spell_min_df).cast("bigint")))
    return out


def spell_deletes(words: DataFrame) -> DataFrame:
    """(del, word, df): each word under itself and under each of its deletions."""
    keys = F.array_distinct(F.concat(F.array("word"), T.one_deletions(F.col("word"))))
    return words.select(F.explode(keys).alias("del"), "word", "df")
