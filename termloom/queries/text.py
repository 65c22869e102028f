"""Text functions, markup, payloads and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import filters
from termloom.functions import text as T
from termloom.operators import rerank as R
from termloom.queries import sql as Q
from termloom.sources import readers

C = F.col


def _t(name):
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


documents, pages, benchmark, conversations = _t("documents"), _t("pages"), _t("benchmark"), _t("conversations")
part, events, labels = _t("part"), _t("events"), _t("labels")

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("normalize_text", f"SELECT doc_id, {Q.norm('text')} AS norm_text FROM documents")
def normalize_text(s, d):
    return documents(s, d).select("doc_id", T.normalize(C("text")).alias("norm_text"))


@query("tokenise", f"SELECT doc_id, len(t) AS n_terms, array_to_string(t, ' ') AS terms FROM (SELECT doc_id, {Q.toks('text')} AS t FROM documents)")
def tokenise(s, d):
    return documents(s, d).select("doc_id", T.tokens(C("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_terms"), F.array_join("t", " ").alias("terms"))


OPERATOR_TEXT = "text || ' -' || regexp_extract(text, '[A-Za-z]+')"


def dashed():
    """The text, and its first word excluded."""
    return F.concat(C("text"), F.lit(" -"), F.regexp_extract("text", "[A-Za-z]+", 0))


@query(
    "query_parse",
    f"""WITH q AS (SELECT item_id AS qid, {OPERATOR_TEXT} AS text FROM benchmark)
SELECT qid, array_to_string(list_sort(list_distinct({Q.toks(Q.included("text"))})), ' ') AS included,
       array_to_string(list_sort(list_distinct({Q.toks(Q.excluded("text"))})), ' ') AS excluded FROM q""",
)
def query_parse(s, d):
    q = benchmark(s, d).select(C("item_id").alias("qid"), dashed().alias("text"))
    return q.select(
        "qid", F.array_join(T.query_terms(T.included_text(C("text"))), " ").alias("included"),
        F.array_join(T.query_terms(T.excluded_text(C("text"))), " ").alias("excluded"),
    )


_VISIBLE = r"""regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script[^a-z0-9].*?</script[^>]*>|<style[^a-z0-9].*?</style[^>]*>|<[^>]*>', ' ', 'g')"""


def _decode(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


@query("html_strip_pages", f"SELECT page_id, {Q.squash(_decode(_VISIBLE))} AS clean_text FROM pages")
def html_strip_pages(s, d):
    return pages(s, d).select("page_id", T.strip_html(C("html")).alias("clean_text"))


_KIND = r"""CASE WHEN regexp_matches(h, '<p>|<div|<br|<html|<body|<script|</') THEN 'html' WHEN regexp_matches(h, '(?m)^[ \t]*(# |```|\* |- )') THEN 'markdown' ELSE 'plain' END"""


@query(
    "detect_markup",
    f"""SELECT id, kind, {_KIND} AS markup FROM (SELECT page_id AS id, 'page' AS kind, substr(html, 1, 2048) AS h FROM pages
UNION ALL SELECT doc_id, 'document', substr(text, 1, 2048) FROM documents)""",
)
def detect_markup(s, d):
    a = pages(s, d).select(C("page_id").alias("id"), F.lit("page").alias("kind"), C("html").alias("t"))
    b = documents(s, d).select(C("doc_id").alias("id"), F.lit("document").alias("kind"), C("text").alias("t"))
    return a.union(b).select("id", "kind", T.markup_kind(C("t")).alias("markup"))


@query("markdown_strip")
def markdown_strip(s, d):
    return conversations(s, d).select("conv_id", "turn", T.strip_markdown(C("text")).alias("clean_text"))


@query("clean_documents")
def clean_documents(s, d):
    return documents(s, d).select("doc_id", T.clean(C("text")).alias("clean_text"))


@query("snippets", f"SELECT doc_id, {Q.squash('substr(text, 1, 320)')} AS snippet FROM documents")
def snippets(s, d):
    return documents(s, d).select("doc_id", T.snippet(C("text")).alias("snippet"))


_MARKED = (
    rf"""regexp_replace(regexp_replace(snip, '([^\p{{L}}\p{{N}}])', '\1' || {Q._CUT}, 'g'),
  '(?i)(^|' || {Q._CUT} || ')(' || array_to_string(words, '|') || ')([^\p{{L}}\p{{N}}]|$)', '\1' || {Q._ONE} || '\2' || {Q._TWO} || '\3', 'g')"""
)


@query(
    "highlight",
    f"""WITH s AS (SELECT doc_id, {Q.squash("substr(text, 1, 320)")} AS snip, list_sort(list_distinct({Q.toks("source || ' the de und la ' || lang")})) AS w FROM documents),
w AS (SELECT doc_id, snip, list_concat(list_filter(w, lambda x: length(x) > 2), list_filter(w, lambda x: length(x) <= 2)) AS words FROM s)
SELECT doc_id, replace(replace({Q.escape(f"replace({_MARKED}, {Q._CUT}, '')")}, {Q._ONE}, '<mark>'), {Q._TWO}, '</mark>') AS marked FROM w""",
)
def highlight(s, d):
    words = T.highlight_words(F.concat("source", F.lit(" the de und la "), "lang"))
    return documents(s, d).select("doc_id", T.highlight(T.snippet(C("text")), words).alias("marked"))


@query("truncated", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS short FROM documents")
def truncated(s, d):
    return documents(s, d).select("doc_id", T.truncate(C("text")).alias("short"))


@query("html_escaped", f"SELECT page_id, {Q.escape('html')} AS safe FROM pages")
def html_escaped(s, d):
    return pages(s, d).select("page_id", T.html_escape(C("html")).alias("safe"))


@query(
    "payloads",
    """SELECT p_partkey AS doc_id, p_name AS text, '{"p_brand":"' || p_brand || '","p_type":"' || p_type || '","p_size":' || p_size || '}' AS payload FROM part""",
)
def payloads(s, d):
    rows = part(s, d).select(C("p_partkey").alias("doc_id"), C("p_name").alias("text"), "p_brand", "p_type", "p_size")
    return readers.with_payload(rows).select("doc_id", "text", "payload")


@query("rank_fields", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, 0.0::DOUBLE AS absent FROM events")
def rank_fields(s, d):
    return events(s, d).select("event_id", readers.rank_field(C("props"), "k").alias("k"), readers.rank_field(C("props"), "none").alias("absent"))


@query(
    "filter_json",
    """SELECT event_id, event_type FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 20 AND CAST(json_extract(props, '$.k') AS DOUBLE) < 60
AND CAST(json_extract(props, '$.k') AS DOUBLE) NOT IN (33) AND json_extract(props, '$.none') IS NULL""",
)
def filter_json(s, d):
    clauses = [{"field": "k", "gte": 20, "lt": 60, "neq": 33}, {"field": "none", "exists": False}]
    return events(s, d).where(filters.predicate(clauses, C("props"))).select("event_id", "event_type")


@query("dictionary_words", r"""SELECT DISTINCT lower(trim(w)) AS word FROM (SELECT unnest(string_split_regex(p_name, '\s+')) AS w FROM part) WHERE regexp_matches(lower(trim(w)), '^[a-z0-9''-]+$')""")
def dictionary_words(s, d):
    return readers.dictionary(part(s, d).select(F.explode(F.split("p_name", r"\s+")).alias("value")))


@query("query_split", "SELECT doc_id AS qid, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 AS held FROM documents")
def query_split(s, d):
    return R.split_queries(documents(s, d).select(C("doc_id").alias("qid")))
