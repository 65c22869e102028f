"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

K1, B = 1.5, 0.75
_ONE, _TWO, _CUT = "chr(57344)", "chr(57345)", "chr(57346)"


def norm(x: str) -> str:
    """Full stops between letters or digits and commas between digits are marked first, twice as matches share ends."""
    for pattern in (r"([\p{L}\p{N}])\.([\p{L}\p{N}])", "([0-9]),([0-9])"):
        for _ in range(2):
            x = rf"regexp_replace({x}, '{pattern}', '\1' || {_ONE} || '\2', 'g')"
    return rf"""regexp_replace({x}, '[()\[\]{{}}"''`\x{{E000}}]', '', 'g')"""


def toks(x: str) -> str:
    return rf"regexp_extract_all(lower({norm(f"coalesce({x}, '')")}), '[\p{{L}}\p{{N}}]+')"


def included(x: str) -> str:
    return rf"array_to_string(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '' AND NOT (starts_with(w, '-') AND length(w) > 1)), ' ')"


def excluded(x: str) -> str:
    return rf"array_to_string(list_transform(list_filter(string_split_regex({x}, '\s+'), lambda w: starts_with(w, '-') AND length(w) > 1), lambda w: substr(w, 2)), ' ')"


def squash(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def escape(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{raw}', '{safe}')"
    return x


def stf(w: str, delta: float = 0.0) -> str:
    return f"(CASE WHEN {w} > 0 THEN {w} * {K1 + 1} / ({w} + {K1} * (1 - {B} + {B} * dl / avgdl)) + {delta} ELSE 0 END)"


def idf(df: str = "df") -> str:
    return f"ln((n.n - {df} + 0.5) / ({df} + 0.5) + 1)"


def tables(stop: float = 0.4, corpus: str = "SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL") -> str:
    """CTEs corpus, tokd, tok, n, df0, stop, kept, tf, dl, av, vocab, post."""
    return f"""
WITH corpus AS ({corpus}),
tokd AS (SELECT doc_id, {toks("text")} AS toks FROM corpus),
tok AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM tokd),
n AS (SELECT count(*) AS n FROM corpus),
df0 AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term),
stop AS (SELECT term FROM df0, n WHERE n.n >= 10 AND df > floor({stop} * n.n)),
kept AS (SELECT * FROM tok WHERE term NOT IN (SELECT term FROM stop)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM kept GROUP BY ALL),
dl AS (SELECT c.doc_id, coalesce(CAST(sum(tf) AS BIGINT), 0) AS dl FROM corpus c LEFT JOIN tf USING (doc_id) GROUP BY c.doc_id),
av AS (SELECT avg(dl) AS avgdl FROM dl),
vocab AS (SELECT term, df, {idf()} AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), n),
post AS (SELECT term, doc_id, tf, CAST(tf AS DOUBLE) AS w, dl FROM tf JOIN dl USING (doc_id))"""


def edges(theta: float | None = 0.3, k: int = 10) -> str:
    """CTEs vec, edge: the k nearest terms by their vectors."""
    cut = "" if theta is None else f"WHERE sim >= {theta}"
    return f"""
, named AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS vec_id FROM vocab),
vec AS (SELECT term, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v
        FROM named JOIN embeddings USING (vec_id)),
sims AS (SELECT a.term AS src, b.term AS dst, round(list_dot_product(a.v, b.v), 6) AS sim FROM vec a, vec b WHERE a.term <> b.term),
edge AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM sims {cut}) WHERE rank <= {k})"""


EXPANDED = """
, xpost AS (SELECT term, doc_id, CAST(sum(tf) AS BIGINT) AS tf, sum(w) AS w, any_value(dl) AS dl FROM (
    SELECT term, doc_id, tf, w, dl FROM post UNION ALL
    SELECT dst, doc_id, 0, sim * tf, dl FROM edge JOIN post ON post.term = edge.src) GROUP BY term, doc_id)"""


def asked(text: str = "text", source: str = "benchmark") -> str:
    """CTEs q, qt: the queries and their included terms."""
    return f"""
, q AS (SELECT item_id AS qid, {text} AS text FROM {source} WHERE item_id IS NOT NULL),
qt AS (SELECT DISTINCT qid, unnest({toks(included("text"))}) AS term FROM q)"""


def scored(alpha: float = 1.0, post: str = "post", delta: float = 0.0) -> str:
    """CTE sc: (qid, doc_id, score)."""
    part = stf("w", delta) if alpha == 1 else stf("tf", delta) if alpha == 0 else f"({alpha} * {stf('w')} + {1 - alpha} * {stf('tf')})"
    return f"""
, sc AS (SELECT qid, doc_id, round(s, 6) AS score FROM (
    SELECT qid, doc_id, sum(idf * {part}) AS s FROM qt JOIN vocab USING (term) JOIN {post} USING (term), av GROUP BY qid, doc_id) WHERE s > 0)"""


def top(k: int, source: str = "sc", offset: int = 0, columns: str = "qid, rank, doc_id, score") -> str:
    return f"""
SELECT {columns} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {source})
WHERE rank > {offset} AND rank <= {offset + k}"""
