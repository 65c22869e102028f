"""Batches of queries against the index of a folder's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import filters
from termloom.functions import text as T
from termloom.operators import evaluate as V
from termloom.operators import rerank as R
from termloom.operators import search as S
from termloom.operators import spell
from termloom.plans import index as I
from termloom.plans import search as P
from termloom.plans.config import BuildConfig, SearchOptions
from termloom.queries import sql as Q
from termloom.queries.index import BIGRAMS, NEAR, SPELL, deletes_sql
from termloom.queries.text import OPERATOR_TEXT, benchmark, dashed, documents, events, labels

C = F.col
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def asked(s, d, text=None) -> DataFrame:
    """Every benchmark item is a query."""
    return benchmark(s, d).where("item_id IS NOT NULL").select(C("item_id").alias("qid"), (C("text") if text is None else text).alias("text"))


def exact(s, d):
    return I.of_folder(s, d, BuildConfig())


def near(s, d):
    return I.of_folder(s, d, NEAR, True)


def terms(s, d):
    return S.query_terms(asked(s, d))


HIT = ("qid", "rank", "doc_id", "score")
PLAIN = Q.tables() + Q.asked() + Q.scored()
WIDE = Q.tables() + Q.edges() + Q.EXPANDED + Q.asked()


@query("bm25_topk", PLAIN + Q.top(10))
def bm25_topk(s, d):
    return S.bm25(exact(s, d), terms(s, d)).select(*HIT)


@query("bm25_expanded", WIDE + Q.scored(post="xpost") + Q.top(10))
def bm25_expanded(s, d):
    return S.bm25(near(s, d), terms(s, d)).select(*HIT)


@query("bm25_exact_part", WIDE + Q.scored(0, "xpost") + Q.top(10))
def bm25_exact_part(s, d):
    return S.topk(S.score(near(s, d), terms(s, d), 0.0, S.Only(best=10)), 10).select(*HIT)


@query("bm25_plus", Q.tables() + Q.asked() + Q.scored(delta=1.0) + Q.top(10))
def bm25_plus(s, d):
    return S.bm25(exact(s, d).configured(delta=1.0), terms(s, d)).select(*HIT)


@query("bound_pruned", PLAIN + Q.top(10))
def bound_pruned(s, d):
    return S.pruned(exact(s, d), terms(s, d)).select(*HIT)


@query("blended", WIDE + Q.scored(0.5, "xpost") + Q.top(10))
def blended(s, d):
    return S.blended(near(s, d), terms(s, d)).select(*HIT)


_EXCLUDED = f""", xt AS (SELECT DISTINCT qid, unnest({Q.toks(Q.excluded("text"))}) AS term FROM q),
xs AS (SELECT * FROM sc WHERE (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM xt JOIN post USING (term)))"""


@query("bm25_exclude", Q.tables() + Q.asked(OPERATOR_TEXT) + Q.scored() + _EXCLUDED + Q.top(10, "xs"))
def bm25_exclude(s, d):
    i, q = exact(s, d), asked(s, d, dashed())
    return S.topk(S.score(i, S.query_terms(q), only=S.Only(excluded=S.excluded_terms(q), best=10)), 10).select(*HIT)


def _paired():
    """Neighbouring words as alternatives: "a b c d" becomes "a|b c|d"."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / 2).cast("int")), lambda i: F.array_join(F.slice("t", 2 * i + 1, 2), "|")), " ")
_GROUPS = f""", gr AS (SELECT DISTINCT qid, (i - 1) // 2 AS grp, t[i] AS term FROM (SELECT qid, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT qid, {Q.toks("text")} AS t FROM q))),
gs AS (SELECT qid, doc_id, grp, max(idf * {Q.stf("w")}) AS s FROM gr JOIN vocab USING (term) JOIN post USING (term), av GROUP BY ALL),
sc AS (SELECT qid, doc_id, round(sum(s), 6) AS score FROM gs GROUP BY ALL HAVING sum(s) > 0)"""


@query("or_groups", Q.tables() + Q.asked() + _GROUPS + Q.top(10))
def or_groups(s, d):
    q = asked(s, d).select("qid", T.tokens(C("text")).alias("t")).where(F.size("t") > 0).select("qid", _paired().alias("text"))
    return S.topk(S.score_groups(exact(s, d), S.or_groups(q), S.Only(best=10)), 10).select(*HIT)


_QEXP = f""", qx AS (SELECT qid, dst AS term, 0.5 * max(sim) AS weight FROM qt JOIN edge ON edge.src = qt.term WHERE (qid, dst) NOT IN (SELECT (qid, term) FROM qt) GROUP BY ALL),
pt AS (SELECT qid, doc_id, idf * (0.5 * {Q.stf("w")} + 0.5 * {Q.stf("tf")}) AS p FROM qt JOIN vocab USING (term) JOIN xpost USING (term), av
  UNION ALL SELECT qid, doc_id, weight * idf * {Q.stf("tf")} FROM qx JOIN vocab USING (term) JOIN xpost USING (term), av WHERE tf > 0),
sc AS (SELECT qid, doc_id, round(sum(p), 6) AS score FROM pt GROUP BY ALL HAVING sum(p) > 0)"""


@query("qexp", WIDE + _QEXP + Q.top(10))
def qexp(s, d):
    return S.topk(S.score_expanded_query(near(s, d), terms(s, d), 0.5, only=S.Only(best=10)), 10).select(*HIT)


_FEATURES = f""", fb AS (SELECT qid, doc_id, sum(idf * {Q.stf("w")}) AS c, sum(idf * {Q.stf("tf")}) AS e, max(dl) AS doc_len
  FROM qt JOIN vocab USING (term) JOIN xpost USING (term), av GROUP BY ALL),
cv AS (SELECT qid, count(vocab.term) / count(*) AS coverage FROM qt LEFT JOIN vocab USING (term) GROUP BY qid),
sc AS (SELECT qid, doc_id, round(c, 6) AS score, round(greatest(e, 0), 6) AS exact, round(greatest(c - e, 0), 6) AS semantic, round(coverage, 6) AS coverage, doc_len
  FROM fb JOIN cv USING (qid) WHERE c > 0)"""


@query("features", WIDE + _FEATURES + Q.top(10, columns="qid, rank, doc_id, score, exact, semantic, coverage, doc_len"))
def features(s, d):
    return S.features(near(s, d), terms(s, d), 10)


_TIERS = """, c AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM sc) WHERE r <= 60),
b AS (SELECT qid, doc_id, score, CAST(floor(round((best - score) / (best * 0.1), 9)) AS INTEGER) AS bucket, n_chars FROM c JOIN documents USING (doc_id))
SELECT qid, rank, doc_id, score, bucket FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY bucket, n_chars DESC, score DESC, doc_id) AS INTEGER) AS rank FROM b) WHERE rank <= 10"""


@query("rank_tiers", PLAIN + _TIERS)
def rank_tiers(s, d):
    i = exact(s, d)
    return S.rank_tiers(i, S.score(i, terms(s, d), only=S.Only(best=S.tier_window(10))), [("n_chars", False)])


_PRF = f""", fd AS (SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM sc) WHERE r <= 10),
tw AS (SELECT qid, term, round(sum(idf * tf / greatest(dl, 1)), 9) AS w FROM fd JOIN post USING (doc_id) JOIN vocab USING (term)
  WHERE (qid, term) NOT IN (SELECT (qid, term) FROM qt) GROUP BY ALL),
ch AS (SELECT *, max(w) OVER (PARTITION BY qid) AS most FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY w DESC, term) AS r FROM tw) WHERE r <= 10),
wt AS (SELECT qid, term, 1.0::DOUBLE AS weight FROM qt UNION ALL SELECT qid, term, 0.3 * w / most FROM ch),
s2 AS (SELECT qid, doc_id, round(sum(weight * idf * {Q.stf("w")}), 6) AS score FROM wt JOIN vocab USING (term) JOIN post USING (term), av GROUP BY ALL)"""


@query("prf", PLAIN + _PRF + Q.top(10, "s2"))
def prf(s, d):
    return S.relevance_feedback(exact(s, d), terms(s, d)).select(*HIT)


@query("mmr")
def mmr(s, d):
    return S.diversify(exact(s, d), terms(s, d))


_EXPLAIN = f""", b AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 5),
bt AS MATERIALIZED (SELECT DISTINCT doc_id FROM b), bp AS MATERIALIZED (SELECT post.* FROM post JOIN bt USING (doc_id)), qm AS MATERIALIZED (SELECT * FROM qt),
bq AS MATERIALIZED (SELECT b.*, bp.term, bp.w, bp.dl FROM b JOIN bp USING (doc_id))
SELECT qid, rank, doc_id, score, term, round(idf, 6) AS idf, w AS tf, round(idf * {Q.stf("w")}, 6) AS contribution FROM bq JOIN qm USING (qid, term) JOIN vocab USING (term), av"""


@query("explain", PLAIN + _EXPLAIN)
def explain(s, d):
    return S.explain(exact(s, d), terms(s, d))


@query(
    "facets",
    PLAIN + """, f AS (SELECT qid, 'lang' AS field, lang AS value FROM sc JOIN documents USING (doc_id) UNION ALL SELECT qid, 'source', source FROM sc JOIN documents USING (doc_id))
SELECT qid, field, value, count(*) AS "count" FROM f GROUP BY ALL""",
)
def facets(s, d):
    i = exact(s, d)
    along = ("lang", "source") if i.here() is not None else ()
    return S.facets(i, S.score(i, terms(s, d), only=S.Only(carry=along)), ["lang", "source"])


_CANDIDATES = ", cd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM sc) WHERE r <= 100)"
_PAIRS = f""", qp AS (SELECT qid, t[i] AS t1, t[i + 1] AS t2 FROM (SELECT qid, t, unnest(range(1, len(t))) AS i FROM (SELECT qid, {Q.toks(Q.included("text"))} AS t FROM q))),
bo AS (SELECT qid, doc_id, sum(idf) AS bonus FROM cd JOIN qp USING (qid) JOIN bg USING (t1, t2, doc_id) GROUP BY ALL),
s2 AS (SELECT qid, doc_id, round(score + 0.25 * coalesce(bonus, 0), 6) AS score FROM cd LEFT JOIN bo USING (qid, doc_id))"""


@query("bigram_bonus", Q.tables() + BIGRAMS + Q.asked() + Q.scored() + _CANDIDATES + _PAIRS + Q.top(10, "s2"))
def bigram_bonus(s, d):
    i, q = exact(s, d), asked(s, d)
    hits = S.topk(S.score(i, S.query_terms(q), only=S.Only(best=100)), 100)
    return S.topk(S.bigram_bonus(i, hits, S.ordered_pairs(q)), 10).select(*HIT)


_NEARBY = """, pl AS (SELECT qid, doc_id, term, pos FROM cd JOIN tok USING (doc_id) JOIN qt USING (qid, term)),
gp AS (SELECT qid, doc_id, CASE WHEN lag(term) OVER w <> term THEN pos - lag(pos) OVER w END AS gap FROM pl WINDOW w AS (PARTITION BY qid, doc_id ORDER BY pos)),
gm AS (SELECT qid, doc_id, min(gap) AS gap FROM gp GROUP BY ALL),
s2 AS (SELECT qid, doc_id, round(score + coalesce(1.0 / (1 + gap), 0), 6) AS score FROM cd LEFT JOIN gm USING (qid, doc_id))"""


@query("proximity", PLAIN + _CANDIDATES + _NEARBY + Q.top(10, "s2"))
def proximity(s, d):
    i, t = exact(s, d), terms(s, d)
    return S.topk(S.proximity_bonus(i, S.topk(S.score(i, t, only=S.Only(best=100)), 100), t), 10).select(*HIT)


def _quoted():
    """The second and third word of an item as a phrase, before the whole item."""
    return F.concat(F.lit('"'), F.array_join(F.slice(T.tokens(C("text")), 2, 2), " "), F.lit('" '), C("text"))
_PHRASE = f""", ph AS (SELECT qid, list_slice({Q.toks("text")}, 2, 3) AS p FROM q),
s2 AS (SELECT qid, doc_id, score FROM sc JOIN ph USING (qid) JOIN tokd USING (doc_id)
  WHERE contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' '))"""


@query("phrase", PLAIN + _PHRASE + Q.top(10, "s2"))
def phrase(s, d):
    i, q = exact(s, d), asked(s, d, _quoted())
    return S.topk(S.score(i, S.query_terms(q), only=S.Only(phrases=S.quoted_phrases(i, q), best=10)), 10).select(*HIT)


def _filtered(s, d, *clauses):
    i, q = exact(s, d), asked(s, d)
    return S.topk(P.hits_of(i, q, SearchOptions(alpha=1.0, filters=clauses, phrase=False), 10), 10).select(*HIT)


def _filter_sql(where: str) -> str:
    return PLAIN + f", s2 AS (SELECT sc.* FROM sc JOIN documents USING (doc_id) WHERE {where})" + Q.top(10, "s2")


@query("filter_range", _filter_sql("n_chars >= 500 AND n_chars < 3000"))
def filter_range(s, d):
    return _filtered(s, d, {"field": "n_chars", "gte": 500, "lt": 3000})


@query("filter_in", _filter_sql("source IN ('src1', 'src2', 'src3') AND lang = 'en' AND source <> 'src2'"))
def filter_in(s, d):
    return _filtered(s, d, {"field": "source", "in": ["src1", "src2", "src3"], "neq": "src2"}, {"field": "lang", "eq": "en"})


@query("filter_exists", _filter_sql("lang IS NOT NULL"))
def filter_exists(s, d):
    return _filtered(s, d, {"field": "lang", "exists": True})


@query("dedup_search", PLAIN + f", ca AS (SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY {Q.squash(f'lower({Q.norm('text')})')}) AS c FROM documents), s2 AS (SELECT sc.* FROM sc JOIN ca USING (doc_id) WHERE c)" + Q.top(10, "s2"))
def dedup_search(s, d):
    i = exact(s, d)
    return S.topk(S.canonical_only(i, S.score(i, terms(s, d))), 10).select(*HIT)


@query("page_2", PLAIN + ", pg AS (" + Q.top(10, offset=10) + ") SELECT qid, rank, doc_id, score, lang, source, n_chars FROM pg JOIN documents USING (doc_id)")
def page_2(s, d):
    options = SearchOptions(offset=10, alpha=1.0, bigram_weight=0.0, phrase=False)
    return P.search(exact(s, d), asked(s, d), options).select(*HIT, "lang", "source", "n_chars")


def _allowed(extra: str = "true", words: bool = True) -> str:
    """CTE al: the hits of sc that a filter and the excluded words leave."""
    return f""", xt AS (SELECT DISTINCT qid, unnest({Q.toks(Q.excluded("text"))}) AS term FROM q),
gone AS MATERIALIZED (SELECT DISTINCT qid, doc_id FROM xt JOIN post USING (term)),
fine AS MATERIALIZED (SELECT doc_id FROM documents WHERE {extra})"""


_KEPT = "SELECT s.* FROM {0} s SEMI JOIN fine USING (doc_id) ANTI JOIN gone USING (qid, doc_id)"
LANG = ({"field": "lang", "eq": "en"},)


@query("search_prf_filtered", Q.tables() + Q.asked(OPERATOR_TEXT) + Q.scored() + _PRF + _allowed("lang = 'en'") + ", s3 AS (" + _KEPT.format("s2") + ")" + Q.top(10, "s3", 5))
def search_prf_filtered(s, d):
    """Feedback, a filter, an excluded word and a second page together."""
    return P.search(exact(s, d), asked(s, d, dashed()), SearchOptions(prf=True, filters=LANG, offset=5)).select(*HIT)


@query("search_mmr_exclude", Q.tables() + Q.asked(OPERATOR_TEXT) + Q.scored() + _allowed("lang = 'en'") + ", s3 AS (" + _KEPT.format("sc") + ")" + Q.top(10, "s3", 3))
def search_mmr_exclude(s, d):
    """Diversity at lambda 1, where the choice is by score alone, with a filter, an excluded word and an offset."""
    return P.search(exact(s, d), asked(s, d, dashed()), SearchOptions(mmr_lambda=1.0, filters=LANG, offset=3)).select(*HIT)


@query(
    "search_features_page",
    Q.tables() + Q.edges() + Q.EXPANDED + Q.asked(OPERATOR_TEXT) + _FEATURES + _allowed("lang = 'en'") + ", s3 AS (" + _KEPT.format("sc") + ")"
    + Q.top(10, "s3", 10, "qid, rank, doc_id, score, exact, semantic, coverage, doc_len"),
)
def search_features_page(s, d):
    return P.search(near(s, d), asked(s, d, dashed()), SearchOptions(features=True, filters=LANG, offset=10))


_EITHER = "CASE WHEN item_id % 2 = 0 THEN text ELSE regexp_replace(text, ' ', '|', 'g') END"


@query(
    "search_mixed_or",
    WIDE.replace(Q.asked(), Q.asked(_EITHER)) + f""", part AS (SELECT qid, unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS word, generate_subscripts(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), 1) AS i, contains(text, '|') AS either FROM q),
wt AS (SELECT DISTINCT qid, either, CASE WHEN contains(word, '|') THEN i::VARCHAR ELSE i || ' ' || term END AS grp, term FROM (SELECT qid, either, i, word, unnest({Q.toks("replace(word, '|', ' ')")}) AS term FROM part)),
pl AS (SELECT qid, doc_id, sum(idf * (0.5 * {Q.stf("w")} + 0.5 * {Q.stf("tf")})) AS s FROM (SELECT DISTINCT qid, term FROM wt WHERE NOT either) JOIN vocab USING (term) JOIN xpost USING (term), av GROUP BY ALL),
gr AS (SELECT qid, doc_id, grp, max(idf * {Q.stf("w")}) AS s FROM wt JOIN vocab USING (term) JOIN xpost USING (term), av WHERE either GROUP BY ALL),
sc AS (SELECT qid, doc_id, round(sum(s), 6) AS score FROM (SELECT qid, doc_id, s FROM pl UNION ALL SELECT qid, doc_id, s FROM gr) GROUP BY ALL HAVING sum(s) > 0)""" + Q.top(10),
)
def search_mixed_or(s, d):
    """Queries with alternatives beside queries without, each by its own rule."""
    text = F.when(C("item_id") % 2 == 0, C("text")).otherwise(F.regexp_replace("text", " ", "|"))
    return P.search(near(s, d), asked(s, d, text), SearchOptions(bigram_weight=0.0, payload=False)).select(*HIT)


@query(
    "search_facets",
    Q.tables() + Q.asked(OPERATOR_TEXT) + Q.scored() + _allowed("n_chars >= 500") + ", s3 AS (" + _KEPT.format("sc") + """)
SELECT qid, 'source' AS field, source AS value, count(*) AS "count", any_value(total) AS total FROM s3 JOIN documents USING (doc_id) JOIN (SELECT qid, count(*) AS total FROM s3 GROUP BY qid) USING (qid) GROUP BY qid, source""",
)
def search_facets(s, d):
    return P.search_facets(exact(s, d), asked(s, d, dashed()), SearchOptions(alpha=1.0, facets=("source",), filters=({"field": "n_chars", "gte": 500},)))


@query("search_reranked", Q.tables() + Q.edges() + Q.EXPANDED + Q.asked(OPERATOR_TEXT) + _FEATURES + _allowed("lang = 'en'") + ", s3 AS (" + _KEPT.format("sc") + ")" + """, ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM s3) WHERE r <= 100),
s4 AS (SELECT qid, doc_id, (CASE WHEN score <= 20 THEN -0.5 WHEN doc_len <= 300 THEN 0.75 ELSE 0.25 END + CASE WHEN 1.0::DOUBLE / r <= 0.1 THEN 0 ELSE 0.125 END)::DOUBLE AS score FROM ft)""" + Q.top(10, "s4", 2))
def search_reranked(s, d):
    """The tree ensemble as an option of the search: over what filters and exclusion leave."""
    return P.search(near(s, d), asked(s, d, dashed()), SearchOptions(trees=MODEL, filters=LANG, offset=2, payload=False)).select(*HIT)


@query("hit_totals", PLAIN + " SELECT qid, count(*) AS total FROM sc GROUP BY qid")
def hit_totals(s, d):
    return S.totals(S.score(exact(s, d), terms(s, d)))


def _typo():
    """Every word of the queries without its second letter."""
    return F.array_join(F.transform(T.tokens(C("text")), lambda w: F.concat(F.substring(w, 1, 1), F.substring(w, F.lit(3), F.length(w)))), " ")
_CORRECT = f""", qw AS (SELECT DISTINCT substr(w, 1, 1) || substr(w, 3) AS word FROM (SELECT unnest({Q.toks("text")}) AS w FROM benchmark)),
qd AS ({deletes_sql("qw", keep="word AS asked")}), dd AS ({deletes_sql("sw")}),
cn AS (SELECT DISTINCT asked, word, df FROM qd JOIN dd USING (del) WHERE asked = word
  OR length(asked) = length(word) AND len(list_filter(list_zip(string_split(asked, ''), string_split(word, '')), lambda x: x[1] <> x[2])) <= 1
  OR length(asked) = length(word) + 1 AND del = word OR length(asked) + 1 = length(word) AND del = asked),
bs AS (SELECT asked, coalesce(max(CASE WHEN word = asked THEN word END), first(word ORDER BY df DESC, word)) AS corrected FROM cn GROUP BY asked)
SELECT qw.word, coalesce(corrected, qw.word) AS corrected FROM qw LEFT JOIN bs ON asked = qw.word"""


@query("spell_correct", "WITH" + SPELL + _CORRECT)
def spell_correct(s, d):
    i = exact(s, d)
    words = asked(s, d, _typo()).select(F.explode(F.filter(F.split("text", " "), lambda w: w != "")).alias("word"))
    return spell.correct_words(words, i.spell, i.deletes)


@query(
    "spell_correct_queries",
    "WITH" + SPELL + _CORRECT.replace("SELECT qw.word, coalesce(corrected, qw.word) AS corrected FROM", ", fx AS (SELECT qw.word, coalesce(corrected, qw.word) AS corrected FROM")
    + f""")
SELECT item_id AS qid, coalesce(string_agg(corrected, ' ' ORDER BY pos), '') AS corrected
FROM (SELECT item_id, unnest(w) AS typed, generate_subscripts(w, 1) AS pos FROM (SELECT item_id, {Q.toks("text")} AS w FROM benchmark WHERE item_id IS NOT NULL)) t
LEFT JOIN fx ON word = substr(typed, 1, 1) || substr(typed, 3) AND word <> '' GROUP BY item_id""",
)
def spell_correct_queries(s, d):
    i = exact(s, d)
    return spell.correct_queries(asked(s, d, _typo()), i.spell, i.deletes)


@query(
    "suggest",
    "WITH" + SPELL + f""", pf AS (SELECT DISTINCT substr(w, 1, 3) AS prefix FROM (SELECT unnest({Q.toks("text")}) AS w FROM benchmark))
SELECT prefix, rank, word, df FROM (SELECT prefix, word, df, CAST(row_number() OVER (PARTITION BY prefix ORDER BY df DESC, word) AS INTEGER) AS rank FROM pf JOIN sw ON starts_with(word, prefix)) WHERE rank <= 8""",
)
def suggest(s, d):
    prefixes = asked(s, d).select(F.explode(T.tokens(C("text"))).alias("w")).select(F.substring("w", 1, 3).alias("prefix"))
    return spell.suggest(exact(s, d).spell, prefixes)


#: f0 (combined) up to 20 or not, then f4 (length) and f7 (reciprocal rank).
MODEL = {
    "max_feature_idx": 7,
    "tree_info": [
        {"tree_structure": {
            "split_feature": 0, "threshold": 20.0, "decision_type": "<=", "default_left": True, "left_child": {"leaf_value": -0.5},
            "right_child": {"split_feature": 4, "threshold": 300.0, "decision_type": "<=", "left_child": {"leaf_value": 0.75}, "right_child": {"leaf_value": 0.25}}}},
        {"tree_structure": {"split_feature": 7, "threshold": 0.1, "decision_type": "<=", "left_child": {"leaf_value": 0.0}, "right_child": {"leaf_value": 0.125}}},
    ],
}
_TREES = """, ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM sc) WHERE r <= 100),
s2 AS (SELECT qid, doc_id, (CASE WHEN score <= 20 THEN -0.5 WHEN doc_len <= 300 THEN 0.75 ELSE 0.25 END + CASE WHEN 1.0::DOUBLE / r <= 0.1 THEN 0 ELSE 0.125 END)::DOUBLE AS score FROM ft)"""


@query("gbdt_rerank", WIDE + _FEATURES + _TREES + Q.top(10, "s2"))
def gbdt_rerank(s, d):
    return R.rerank_trees(near(s, d), terms(s, d), MODEL).select(*HIT)


@query(
    "rerank_candidates",
    WIDE + _FEATURES + """ SELECT qid, doc_id, CAST(r AS INTEGER) AS rank, score AS combined, exact, semantic, coverage, doc_len, round(ln(1 + doc_len), 6) AS log_doc_len,
round(semantic / greatest(score, 1e-6), 6) AS semantic_share, round(1.0::DOUBLE / r, 6) AS reciprocal_rank
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM sc) WHERE r <= 100""",
)
def rerank_candidates(s, d):
    rows = R.candidates(near(s, d), terms(s, d))
    return rows.withColumns({c: F.round(c, 6) for c in ("log_doc_len", "semantic_share", "reciprocal_rank")})


def overlap(queries, texts):
    """A stand-in for a cross-encoder: share of the query's words that the text holds."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = [pc.list_parent_indices, pc.list_flatten]
    (qi, qw), (ti, tw) = ([f(pc.utf8_split_whitespace(pc.utf8_lower(pa.array(x, pa.string())))) for f in lists] for x in (queries, texts))
    asked = pa.table({"i": qi, "w": qw}).filter(pc.not_equal(qw, "")).group_by(["i", "w"]).aggregate([])
    held = pa.table({"i": ti, "w": tw}).group_by(["i", "w"]).aggregate([])
    count = lambda t: dict(zip(*t.group_by("i").aggregate([("w", "count")]).to_pydict().values(), strict=True))
    n, both = count(asked), count(asked.join(held, ["i", "w"], join_type="left semi"))
    return [both.get(i, 0) / max(n.get(i, 0), 1) for i in range(len(queries))]


_SPLIT = lambda x: f"list_filter(string_split_regex(lower({x}), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"
_OVERLAP = f""", cd AS MATERIALIZED (SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM sc) WHERE r <= 50),
ov AS (SELECT qid, doc_id, list_distinct({_SPLIT("q.text")}) AS a, {_SPLIT("substr(coalesce(documents.text, ''), 1, 1200)")} AS b FROM cd JOIN q USING (qid) JOIN documents USING (doc_id)),
s2 AS (SELECT qid, doc_id, round(len(list_filter(a, lambda w: list_contains(b, w)))::DOUBLE / greatest(len(a), 1), 6) AS score FROM ov)"""


@query("cross_encoder", PLAIN + _OVERLAP + Q.top(10, "s2"))
def cross_encoder(s, d):
    i, q = exact(s, d), asked(s, d)
    return R.rerank_pairs(S.score(i, S.query_terms(q), only=S.Only(best=50)), q, documents(s, d), overlap).select(*HIT)


def _run(s, d):
    return I.settled(S.topk(S.score(exact(s, d), terms(s, d), only=S.Only(best=100)), 100))[0]


def _qrels(s, d, run):
    grades = labels(s, d).where("doc_id IS NOT NULL").select("doc_id", (2 * C("quality") + C("toxic")).cast("int").alias("grade"))
    return run.select("qid", "doc_id").join(grades, "doc_id").select("qid", "doc_id", "grade")


_JUDGED = ", rn AS (" + Q.top(100) + """), jd AS (SELECT qid, rank, coalesce(2 * quality + toxic, 0) AS grade FROM rn LEFT JOIN labels USING (doc_id)),
qs AS (SELECT DISTINCT qid FROM rn)"""


@query(
    "ndcg",
    PLAIN + _JUDGED + """, dc AS (SELECT qid, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM jd WHERE rank <= 10 GROUP BY qid),
id AS (SELECT qid, sum((pow(2, grade) - 1) / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC) AS place FROM jd) WHERE place <= 10 GROUP BY qid)
SELECT qid, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM qs JOIN dc USING (qid) JOIN id USING (qid)""",
)
def ndcg(s, d):
    run = _run(s, d)
    return V.ndcg(run, _qrels(s, d, run))


@query("mrr", PLAIN + _JUDGED + " SELECT qid, round(coalesce(1.0::DOUBLE / min(CASE WHEN grade > 0 AND rank <= 10 THEN rank END), 0), 6) AS mrr FROM jd GROUP BY qid")
def mrr(s, d):
    run = _run(s, d)
    return V.mrr(run, _qrels(s, d, run))


@query("recall", PLAIN + _JUDGED + " SELECT qid, round(CASE WHEN count(*) FILTER (grade > 0) > 0 THEN count(*) FILTER (grade > 0 AND rank <= 20) / count(*) FILTER (grade > 0) ELSE 0 END, 6) AS recall FROM jd GROUP BY qid")
def recall(s, d):
    run = _run(s, d)
    return V.recall(run, _qrels(s, d, run), 20)


@query("teacher_grades", PLAIN + """ SELECT qid, doc_id, CAST(CASE WHEN r <= 2 THEN 4 WHEN r <= 5 THEN 3 WHEN r <= 10 THEN 2 WHEN r <= 20 THEN 1 ELSE 0 END AS INTEGER) AS grade
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM sc)""")
def teacher_grades(s, d):
    return R.teacher_grades(S.score(exact(s, d), terms(s, d)).withColumnRenamed("score", "t"))


@query(
    "latency_percentiles",
    """SELECT event_type, max(n) AS n, max(CASE WHEN place = least(floor(n * 0.5), n - 1) THEN value END) AS p50, max(CASE WHEN place = least(floor(n * 0.95), n - 1) THEN value END) AS p95,
max(CASE WHEN place = least(floor(n * 0.99), n - 1) THEN value END) AS p99
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type""",
)
def latency_percentiles(s, d):
    return V.percentiles(events(s, d), "event_type", "value")
