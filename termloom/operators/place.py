"""Scoring of a batch of queries document by document.

A document's row holds all its words, so what a query gives it is computed where the row lies: the batch's
terms travel to the documents, and no posting is exchanged.  The batch is bounded (``LIMIT`` entries); a larger
one is scored by joins (``search.lookup``).  Expanded frequencies are made of the edges that lead to the
batch's terms, so expanded postings are not needed either.  Memory: ``CELLS`` cells for a block of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query terms, or edges that lead to them, of a batch that is scored in place.
LIMIT, EDGES = 1 << 16, 1 << 22
CELLS = 1 << 21


@dataclass
class Place:
    """The documents' rows (doc_id, terms[, dl], ...), of distinct doc_ids.

    ``terms``: words in order, of which ``stops`` don't count, or counted ones (term, tf) with ``dl``.
    ``edges`` (src, dst, sim) expand the frequencies.  ``postings``: those of the same index, once they are made.
    """

    rows: DataFrame
    stops: tuple[str, ...] = ()
    edges: DataFrame | None = None
    postings: DataFrame | None = None

    @property
    def counted(self) -> bool:
        return "struct" in dict(self.rows.dtypes)["terms"]


@dataclass(frozen=True)
class Only:
    """Which hits are wanted: without documents that hold an excluded word (qid, term), of documents that ``where``
    allows, with the phrases (qid, phrases) that a query quotes; of each query those that may be among the ``best`` first.
    ``carry``: the documents' columns that come along."""

    excluded: DataFrame | None = None
    where: Column | None = None
    phrases: DataFrame | None = None
    best: int | None = None
    carry: tuple[str, ...] = ()

    def all(self) -> Only:
        return replace(self, best=None)


@dataclass
class Batch:
    """Entries by term, as arrays: ``of[t]`` to ``of[t + 1]`` are term t's; queries and groups by number."""

    words: pa.Array  # the terms, the sources of edges, excluded words, words of phrases, stopwords
    terms: int
    stops: tuple[int, int]
    qid: pa.Array
    of: np.ndarray
    column: np.ndarray
    factor: np.ndarray
    alpha: np.ndarray
    groups: np.ndarray | None  # the query of each group, ascending
    edge_of: np.ndarray | None
    edge_to: np.ndarray | None
    edge_sim: np.ndarray | None
    excluded: tuple | None
    required: tuple | None
    held: tuple | None
    needed: np.ndarray | None
    phrases: list | None


def _lists(place: np.ndarray, n: int, *columns: np.ndarray) -> tuple:
    """Rows grouped by ``place``: bounds of each of n groups, then the columns in that order."""
    order = np.argsort(place, kind="stable")
    return np.concatenate(([0], np.cumsum(np.bincount(place, minlength=n)))), *[c[order] for c in columns]


def _spread(bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element of ``at`` all members of its group: places in ``at``, places of the members."""
    n = bounds[at + 1] - bounds[at]
    rows = np.repeat(np.arange(len(at)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + bounds[at][rows]


def _few(df: DataFrame, most: int) -> pa.Table | None:
    got = df.limit(most + 1).toArrow()
    return got if got.num_rows <= most else None


def batch(place: Place, vocab: DataFrame, entries: DataFrame, alpha: float, only: Only, required: DataFrame | None = None) -> Batch | None:
    """None where the batch is too large."""
    spark = entries.sparkSession
    has = [c for c in ("weight", "alpha", "grp") if c in entries.columns]
    rows = _few(entries.select("qid", "term", *has).where("term IS NOT NULL"), LIMIT)
    extra = {name: _few(df.select("qid", "term"), LIMIT) for name, df in (("excluded", only.excluded), ("required", required)) if df is not None}
    said = _few(only.phrases.select("qid", "phrases").where(F.size("phrases") > 0), LIMIT) if only.phrases is not None else None
    if rows is None or any(x is None for x in extra.values()) or (only.phrases is not None and said is None):
        return None
    terms = pc.unique(rows["term"])
    held = [(q.as_py(), w) for q, p in zip(said["qid"], said["phrases"].to_pylist(), strict=True) for w in dict.fromkeys(w for x in p for w in x)] if said is not None else []
    names = pa.chunked_array([terms.cast(pa.string()), pa.array([w for _, w in held], pa.string())]).unique()
    asked = spark.createDataFrame(pa.table({"term": names}), "term string")
    known = vocab.select("term", "idf").join(F.broadcast(asked), "term").toArrow()
    # by name, so that sums are made in the same order each time
    idf = dict(sorted(zip(known["term"].to_pylist(), known["idf"].to_pylist(), strict=True)))
    wanted = set(terms.to_pylist())
    words = [t for t, x in idf.items() if t in wanted and x > 0]
    at, n_terms = {w: i for i, w in enumerate(words)}, len(words)

    def number(w: str) -> int:
        if w not in at:
            at[w] = len(words)
            words.append(w)
        return at[w]

    near = None
    if place.edges is not None and (alpha > 0 or "alpha" in has):
        targets = spark.createDataFrame(pa.table({"dst": pa.array(words, pa.string())}), "dst string")
        near = _few(place.edges.select("src", "dst", "sim").join(F.broadcast(targets), "dst"), EDGES)
        if near is None:
            return None
    edges = [None] * 3
    if near is not None:
        src, dst = np.array([number(w) for w in near["src"].to_pylist()], np.int64), np.array([at[w] for w in near["dst"].to_pylist()], np.int64)
        edges = [src, dst, near["sim"].to_numpy()]
    tables = [rows["qid"], *[t["qid"] for t in extra.values()]]
    ids = pc.unique(pa.chunked_array([c for t in tables for c in t.chunks], tables[0].type))
    where = {q: i for i, q in enumerate(ids.to_pylist())}
    query = np.array([where[q] for q in rows["qid"].to_pylist()], np.int64)
    term = np.array([at[w] if w in at and at[w] < n_terms else -1 for w in rows["term"].to_pylist()], np.int64)
    weight = rows["weight"].to_numpy() if "weight" in has else np.ones(len(query))
    blend = rows["alpha"].to_numpy() if "alpha" in has else np.full(len(query), alpha)
    column, groups = query, None
    if "grp" in has:
        seen: dict = {}
        pairs = list(zip(query.tolist(), rows["grp"].to_pylist(), strict=True))
        for p in sorted(set(pairs), key=lambda p: p[0]):
            seen[p] = len(seen)
        column, groups = np.array([seen[p] for p in pairs], np.int64), np.array([p[0] for p in seen], np.int64)
    ok = term >= 0
    value = np.array([idf[w] for w in words[:n_terms]], float)
    of, column, factor, blend = _lists(term[ok], n_terms, column[ok], value[term[ok]] * weight[ok], blend[ok])
    silent = set(place.stops)
    marks = {name: [(number(w), where[q]) for q, w in zip(t["qid"].to_pylist(), t["term"].to_pylist(), strict=True) if w is not None and w not in silent] for name, t in extra.items()}
    phrases, needed = None, None
    if said is not None:
        phrases, needed = [[] for _ in where], np.zeros(len(where), np.int64)
        for q, p in zip(said["qid"].to_pylist(), said["phrases"].to_pylist(), strict=True):
            if q in where:
                phrases[where[q]] = [" " + " ".join(x) + " " for x in p]
        marks["held"] = [(number(w), where[q]) for q, w in held if w in idf and q in where]
        for _, q in marks["held"]:
            needed[q] += 1
    before = len(words)
    words += place.stops
    listed = {name: _lists(np.array([w for w, _ in pairs], np.int64), len(words), np.array([q for _, q in pairs], np.int64)) for name, pairs in marks.items()}
    if edges[0] is not None:
        edges = _lists(edges[0], len(words), edges[1], edges[2])
    return Batch(
        pa.array(words, pa.string()), n_terms, (before, len(words)), ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, of, column, factor, blend, groups, *edges,
        listed.get("excluded"), listed.get("required"), listed.get("held"), needed, phrases,
    )


def _counts(b: Batch, rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of the batch's words: document, word, frequency, by document and word; and all documents' lengths."""
    lists = rows.column("terms")
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    doc = np.repeat(np.arange(rows.num_rows), size)
    counted = pa.types.is_struct(flat.type)
    word = pc.fill_null(pc.index_in(flat.field("term") if counted else flat, value_set=b.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    low, high = b.stops
    if "dl" in rows.schema.names:
        dl = pc.fill_null(rows.column("dl"), 0).to_numpy(zero_copy_only=False).astype(float)
    else:
        dl = (size - np.bincount(doc[(word >= low) & (word < high)], minlength=rows.num_rows)).astype(float)
    ok = (word >= 0) & (word < low)
    key = doc[ok] * len(b.words) + word[ok]
    if counted:
        return (*np.divmod(key, max(len(b.words), 1)), flat.field("tf").to_numpy(zero_copy_only=False)[ok].astype(float), dl)
    key.sort()
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return (*np.divmod(key[head], max(len(b.words), 1)), np.diff(np.append(head, len(key))).astype(float), dl)


def _marked(lists: tuple, doc: np.ndarray, word: np.ndarray, cells: int, queries: int) -> np.ndarray:
    """How many of a query's marked words each document holds."""
    at, member = _spread(lists[0], word)
    return np.bincount(doc[at] * queries + lists[1][member], minlength=cells)


def _block(b: Batch, doc, word, tf, dl, n: int, saturated, both: bool) -> list[np.ndarray]:
    """(documents, queries) of scores above 0, others 0; with ``both`` the exact ones too."""
    queries, terms = len(b.qid), b.terms
    own = word < terms
    if b.edge_of is not None:
        at, member = _spread(b.edge_of, word)
        cell = np.concatenate((doc[own] * terms + word[own], doc[at] * terms + b.edge_to[member]))
        dense = np.bincount(cell, np.concatenate((tf[own], b.edge_sim[member] * tf[at])), n * terms)
        plain = np.bincount(doc[own] * terms + word[own], tf[own], n * terms)
        there = np.flatnonzero((dense != 0) | (plain != 0))
        d, t = np.divmod(there, max(terms, 1))
        w, plain = dense[there], plain[there]
    else:
        d, t, w = doc[own], word[own], tf[own]
        plain = w
    full, exact = saturated(w, dl[d]), None
    if both or (b.edge_of is not None and (b.alpha < 1).any()):
        exact = saturated(plain, dl[d])
    at, member = _spread(b.of, t)
    factor, out = b.factor[member], []
    if both:
        parts = [factor * full[at], factor * exact[at]]
    elif exact is None:
        parts = [factor * full[at]]
    else:
        a = b.alpha[member]
        parts = [factor * (a * full[at] + (1 - a) * exact[at])]
    for part in parts:
        if b.groups is None:
            out.append(np.bincount(d[at] * queries + b.column[member], part, n * queries).reshape(n, queries))
            continue
        most = np.full(n * len(b.groups), 0.0)
        np.maximum.at(most, d[at] * len(b.groups) + b.column[member], part)
        first = np.flatnonzero(np.concatenate(([True], b.groups[1:] != b.groups[:-1]))) if len(b.groups) else np.zeros(0, np.int64)
        total = np.zeros((n, queries))
        if len(first):
            total[:, b.groups[first]] = np.add.reduceat(most.reshape(n, -1), first, axis=1)
        out.append(total)
    allowed = np.ones(n * queries, bool)
    if b.excluded is not None:
        allowed &= _marked(b.excluded, doc, word, n * queries, queries) == 0
    if b.held is not None:
        allowed &= _marked(b.held, doc, word, n * queries, queries) == np.tile(b.needed, n)
    if b.required is not None:  # by the words that expansion gives, too
        at, member = _spread(b.required[0], t)
        allowed &= np.bincount((d[at] * queries + b.required[1][member])[w[at] > 0], minlength=n * queries) > 0
    out[0][~allowed.reshape(n, queries) | (out[0] <= 0)] = 0
    return out


def _hits(b: Batch, rows: pa.RecordBatch, saturated, both: bool) -> list[np.ndarray]:
    doc, word, tf, dl = _counts(b, rows)
    queries = max(len(b.qid), 1)
    wide = max(queries, b.terms if b.edge_of is not None else 1, len(b.groups) if b.groups is not None else 1)
    step = max(1, CELLS // wide)
    parts = []
    for lo in range(0, rows.num_rows, step):
        hi = min(lo + step, rows.num_rows)
        i, j = np.searchsorted(doc, (lo, hi))
        parts.append(_block(b, doc[i:j] - lo, word[i:j], tf[i:j], dl[lo:hi], hi - lo, saturated, both))
    return [*(np.concatenate(x) for x in zip(*parts, strict=True)), dl]


def _one_copy(score: np.ndarray, ids: list, last: list) -> None:
    """Of rows with one id next to each other, the first that a query hits."""
    for i, x in enumerate(ids):
        if last and last[0] == x:
            score[i][last[1]] = 0
            last[1] = last[1] | (score[i] > 0)
        else:
            last[:] = [x, score[i] > 0]


def score(place: Place, vocab: DataFrame, avgdl: float, config, entries: DataFrame, alpha: float = 1.0, only: Only = Only(), required: DataFrame | None = None, both: bool = False, newest: bool = False) -> DataFrame | None:
    """(qid, doc_id, score[, exact, doc_len], carry) of every wanted hit above 0, not rounded; None where the batch is too large.

    ``both``: the expanded score, the exact one and the document's length.  ``newest``: rows of one doc_id lie next
    to each other, and the first that a query hits stands for all.
    """
    b = batch(place, vocab, entries, alpha, only, required)
    if b is None:
        return None
    rows = place.rows if only.where is None else place.rows.where(only.where)
    rows = rows.select("doc_id", "terms", *(["dl"] if "dl" in rows.columns else []), *only.carry)
    kinds = dict(rows.dtypes)
    k1, b_, mean, delta = config.k1, config.b, float(avgdl) or 1.0, config.delta
    best, phrases, carry = only.best, b.phrases, only.carry
    keep = best is not None and best * len(b.qid) <= 2 * CELLS

    def saturated(w, dl):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(w > 0, w * (k1 + 1) / (w + k1 * (1 - b_ + b_ * dl / mean)) + delta, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((best if keep else 0, len(b.qid)))
        last: list = []
        for rows in batches:
            if not rows.num_rows or not len(b.qid):
                continue
            got = _hits(b, rows, saturated, both)
            s = got[0]
            if phrases is not None:
                texts: dict = {}
                lists = rows.column("terms")
                for i, q in zip(*np.nonzero(s), strict=True):
                    if phrases[q]:
                        if i not in texts:
                            texts = {i: " " + " ".join(lists[int(i)].as_py()) + " "}
                        if not all(p in texts[i] for p in phrases[q]):
                            s[i, q] = 0
            if newest:
                _one_copy(s, rows.column("doc_id").to_pylist(), last)
            found = s > 0
            if keep:  # what is under the best so far by more than rounding moves it can't be among them
                m = max(0, s.shape[0] - best)
                mine = np.partition(s, m, axis=0)[m:] if m else s
                top = np.concatenate((top, mine))
                top = np.partition(top, len(top) - best, axis=0)[len(top) - best :]
                found &= s >= top.min(axis=0) - 1.1e-6
            i, q = np.nonzero(found)
            if not len(i):
                continue
            at = pa.array(i)
            columns = [b.qid.take(pa.array(q)), rows.column("doc_id").take(at), pa.array(s[i, q])]
            if both:
                columns += [pa.array(got[1][i, q]), pa.array(got[2][i].astype(np.int64))]
            columns += [rows.column(c).take(at) for c in carry]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["qid", "doc_id", "score", *(["exact", "doc_len"] if both else []), *only.carry]
    kind = {"qid": dict(entries.dtypes)["qid"], "doc_id": kinds["doc_id"], "score": "double", "exact": "double", "doc_len": "bigint"}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kind.get(c) or kinds[c]}" for c in names))
