"""Index-build operators over whole tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from termloom.operators import build as B
from termloom.operators import expand as E
from termloom.plans import index as I
from termloom.plans.config import BuildConfig
from termloom.queries import sql as Q
from termloom.queries.text import documents, part

C = F.col
#: The vectors of the test tables are far apart; this threshold gives them neighbours.
NEAR = BuildConfig(threshold=0.3)
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def six(name: str):
    return F.round(name, 6).alias(name)


class Parts:
    """The tables of a build, as plans."""

    def __init__(self, s, d, corpus=None, config=BuildConfig()):
        self.config = config
        self.corpus = documents(s, d) if corpus is None else corpus
        self.tokenised = B.terms(B.spread(self.corpus), config)
        self.n = self.corpus.where("doc_id IS NOT NULL").count()
        self.stops = B.stopwords(B.document_frequency(self.tokenised), self.n, config)

    @functools.cached_property
    def docs(self):
        return B.counted(self.tokenised, [r["term"] for r in self.stops.collect()], self.config)

    @property
    def tf(self):
        return B.term_counts(self.docs)


@query("doc_freq", Q.tables() + " SELECT term, df FROM df0")
def doc_freq(s, d):
    return B.document_frequency(B.terms(B.spread(documents(s, d))))


@query("stopwords", Q.tables() + " SELECT term FROM stop")
def stopwords(s, d):
    return Parts(s, d).stops


@query("positions", Q.tables() + " SELECT doc_id, CAST(pos AS INTEGER) AS pos, term FROM tok")
def positions(s, d):
    return B.positions(B.terms(B.spread(documents(s, d))))


@query("term_counts", Q.tables() + " SELECT doc_id, term, tf FROM tf")
def term_counts(s, d):
    return Parts(s, d).tf


@query("idf_table", Q.tables() + " SELECT term, df, round(idf, 6) AS idf FROM vocab")
def idf_table(s, d):
    p = Parts(s, d)
    return B.vocabulary(p.tf, p.n).select("term", "df", six("idf"))


@query("doc_lengths", Q.tables() + " SELECT doc_id, dl, round(avgdl, 6) AS avgdl FROM dl, av")
def doc_lengths(s, d):
    dl = B.document_lengths(Parts(s, d).docs)
    return dl.crossJoin(F.broadcast(dl.agg(F.round(F.avg("dl"), 6).alias("avgdl"))))


@query("exact_postings", Q.tables() + " SELECT term, doc_id, tf, dl FROM post")
def exact_postings(s, d):
    return I.of_folder(s, d, BuildConfig()).postings.select("term", "doc_id", "tf", "dl")


_PART = "SELECT p_partkey AS doc_id, CASE WHEN p_name <> '' THEN p_name || ' ' ELSE '' END || p_type || ' ' || p_brand AS text FROM part"


@query(
    "title_weighted_tf",
    Q.tables(corpus=_PART)
    + f""", tt AS (SELECT p_partkey AS doc_id, unnest({Q.toks("p_name")}) AS term FROM part),
tx AS (SELECT doc_id, term, count(*) AS x FROM tt WHERE term NOT IN (SELECT term FROM stop) GROUP BY ALL)
SELECT doc_id, term, CAST(coalesce(tf, 0) + coalesce(x, 0) AS BIGINT) AS tf FROM tf FULL JOIN tx USING (doc_id, term) WHERE coalesce(tf, 0) + coalesce(x, 0) > 0""",
)
def title_weighted_tf(s, d):
    corpus = part(s, d).select(C("p_partkey").alias("doc_id"), C("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("text"))
    return Parts(s, d, corpus).tf


BIGRAMS = f""", nx AS (SELECT doc_id, term AS t1, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS t2 FROM kept),
pr AS (SELECT DISTINCT doc_id, t1, t2 FROM nx WHERE t2 IS NOT NULL),
bd AS (SELECT t1, t2, count(*) AS df FROM pr GROUP BY ALL),
bg AS (SELECT t1, t2, doc_id, {Q.idf()} AS idf FROM pr JOIN bd USING (t1, t2), n WHERE df BETWEEN 2 AND greatest(2, floor(0.1 * n.n)))"""


@query("bigram_index", Q.tables() + BIGRAMS + " SELECT t1, t2, doc_id, round(idf, 6) AS idf FROM bg")
def bigram_index(s, d):
    p = Parts(s, d)
    return B.bigrams(p.docs, p.n).select("t1", "t2", "doc_id", six("idf"))


@query("forward_index", Q.tables() + " SELECT doc_id, string_agg(term || ':' || tf, ' ' ORDER BY term) AS terms FROM tf GROUP BY doc_id")
def forward_index(s, d):
    line = F.transform("terms", lambda x: F.concat(x["term"], F.lit(":"), x["tf"].cast("string")))
    return B.forward_index(Parts(s, d).docs).select("doc_id", F.array_join(line, " ").alias("terms"))


@query(
    "block_max",
    Q.tables()
    + f""", r AS (SELECT term, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 128 AS block, idf * {Q.stf("w")} AS bound FROM post JOIN vocab USING (term), av)
SELECT term, block, round(max(bound), 6) AS bound FROM r GROUP BY ALL""",
)
def block_max(s, d):
    i = I.of_folder(s, d, BuildConfig())
    place = i.here()
    if place is None:
        rows = B.block_max(i.postings, i.vocab, i.avgdl)
    else:
        rows = B.block_max_of_rows(place.rows, place.stops, i.n_docs, i.avgdl)
    return rows.select("term", "block", six("bound"))


@query("dedup_canonical", f"SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY {Q.squash(f'lower({Q.norm("text")})')}) AS canonical FROM documents")
def dedup_canonical(s, d):
    return B.canonical(documents(s, d))


SPELL = rf"""
sw AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower({Q.norm("text")}), '[\p{{L}}\p{{N}}'']+')) AS word FROM documents)
  WHERE length(word) <= 40 GROUP BY word HAVING count(*) >= 2)"""


def deletes_sql(source: str, word: str = "word", keep: str = "word, df") -> str:
    cut = f"list_transform(range(1, length({word}) + 1), lambda i: substr({word}, 1, i - 1) || substr({word}, i + 1))"
    return f"SELECT DISTINCT unnest(list_concat([{word}], {cut})) AS del, {keep} FROM {source}"


@query("spell_vocab", "WITH" + SPELL + " SELECT word, df FROM sw")
def spell_vocab(s, d):
    return B.spell_words(documents(s, d))


@query("spell_deletes", "WITH" + SPELL + " " + deletes_sql("sw"))
def spell_deletes(s, d):
    return B.spell_deletes(B.spell_words(documents(s, d)))


def _vectors(s, d):
    table = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    return E.assign_vectors(I.of_folder(s, d, BuildConfig()).vocab, table)


@query("cosine_topk", Q.tables() + Q.edges(None) + " SELECT src, dst, sim, CAST(rank AS INTEGER) AS rank FROM edge")
def cosine_topk(s, d):
    return E.cosine_topk(_vectors(s, d), 10)


@query(
    "quantised_vectors",
    """WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
c AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM e)
SELECT vec_id, round(scale, 6) AS scale, array_to_string(list_transform(v, lambda x: CAST(round(x / scale) AS INTEGER)), ' ') AS codes FROM c""",
)
def quantised_vectors(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", E.quantise(E.unit(C("embedding"))).alias("q"))
    return e.select("vec_id", F.round("q.scale", 6).alias("scale"), F.array_join(F.transform("q.codes", lambda x: x.cast("string")), " ").alias("codes"))


@query("qexp_graph", Q.tables() + Q.edges() + " SELECT src, dst, sim FROM edge")
def qexp_graph(s, d):
    return E.cosine_topk(_vectors(s, d), 10, 0.3).select("src", "dst", "sim")


@query("neighbour_inversion", Q.tables() + Q.edges() + " SELECT dst, string_agg(src, ' ' ORDER BY sim DESC, src) AS sources FROM edge GROUP BY dst")
def neighbour_inversion(s, d):
    rows = E.invert(qexp_graph(s, d))
    return rows.select("dst", F.array_join(F.transform("sources", lambda x: x["src"]), " ").alias("sources"))


_AHEAD = " UNION ALL ".join(f"SELECT term, lead(term, {i}) OVER (PARTITION BY doc_id ORDER BY pos) AS other FROM kept" for i in range(1, 6))
PPMI = f""", ah AS ({_AHEAD}),
co AS (SELECT least(term, other) AS a, greatest(term, other) AS b, count(*) AS c FROM ah WHERE other IS NOT NULL AND other <> term GROUP BY ALL),
one AS (SELECT term, count(*) AS n FROM kept GROUP BY term),
tot AS (SELECT (SELECT sum(c) FROM co)::DOUBLE AS ap, (SELECT sum(n) FROM one)::DOUBLE AS aw),
pp AS (SELECT a, b, round(ln((c / ap) / ((x.n / aw) * (y.n / aw))), 6) AS ppmi FROM co JOIN one x ON x.term = a JOIN one y ON y.term = b, tot WHERE c >= 3),
po AS (SELECT a AS dst, b AS src, ppmi FROM pp WHERE ppmi > 0 UNION ALL SELECT b, a, ppmi FROM pp WHERE ppmi > 0),
pe AS (SELECT src, dst, ppmi / (SELECT max(ppmi) FROM po) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY ppmi DESC, src) AS r FROM po) WHERE r <= 5)"""


@query("ppmi_edges", Q.tables() + PPMI + " SELECT src, dst, round(sim, 6) AS sim FROM pe")
def ppmi_edges(s, d):
    i = I.of_folder(s, d, BuildConfig())
    place = i.here()
    docs = Parts(s, d).docs if place is None else place.rows.select("doc_id", F.filter("terms", lambda w: ~w.isin(list(place.stops))).alias("kept"))
    return E.ppmi_edges(docs).select("src", "dst", six("sim"))


@query("expanded_postings", Q.tables() + Q.edges() + Q.EXPANDED + " SELECT term, doc_id, tf, round(w, 6) AS w, dl FROM xpost")
def expanded_postings(s, d):
    return I.of_folder(s, d, NEAR, True).postings.select("term", "doc_id", "tf", six("w"), "dl")


@query(
    "index_stats",
    Q.tables()
    + """ SELECT (SELECT n FROM n) AS n_docs, (SELECT count(*) FROM vocab) AS n_terms, (SELECT count(*) FROM stop) AS n_stopwords,
(SELECT count(*) FROM tf) AS nnz, round((SELECT avgdl FROM av), 6) AS avgdl""",
)
def index_stats(s, d):
    i = I.of_folder(s, d, BuildConfig())
    row = (i.stats["n_docs"], i.stats["n_terms"], i.stats["n_stopwords"], i.stats["nnz"], round(i.avgdl, 6))
    return s.createDataFrame([row], "n_docs bigint, n_terms bigint, n_stopwords bigint, nnz bigint, avgdl double")
