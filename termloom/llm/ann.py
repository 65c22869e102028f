"""Nearest neighbours (cosine) by shifted space-filling curves.

Each curve projects the vectors to ``DIMS`` random directions, shifts the grid by a random vector and
orders the cells along a Hilbert curve.  A curve's keys are range-partitioned into blocks of about
``BLOCK`` rows; every block's rows are queries against the block itself and ``reach`` neighbouring
blocks on either side, and the curves' candidates are merged and reranked by their exact cosine.

How many curves and how far a window reaches is calibrated, not assumed: for ``QUERIES`` vectors drawn
by a hash of their id the exact neighbours are found by brute force, and the cheapest plan whose
windows hold at least ``RECALL`` of them is taken.  Data without structure (directions at random in
many dimensions) has no cheap plan; then windows grow up to the whole curve, which is exact and costs
quadratic time.  Every row is a query, whatever the plan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm._state import cut

K, CURVES, DIMS, BITS, BLOCK = 10, 6, 6, 8, 2048
QUERIES, RECALL = 256, 0.95


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index of each cell (rows of non-negative coordinates of ``bits`` bits) along a Hilbert curve."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of each level
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(v: np.ndarray, curves: int = CURVES, seed: int = 5) -> np.ndarray:
    """(curves, rows) Hilbert keys of unit vectors."""
    rng = np.random.default_rng(seed)
    out = np.empty((curves, len(v)), np.int64)
    for c in range(curves):
        way = np.linalg.qr(rng.normal(size=(v.shape[1], min(DIMS, v.shape[1]))))[0]
        x = v @ way * math.sqrt(v.shape[1])
        u = 1 / (1 + np.exp(-1.702 * x))  # about uniform if directions are
        cell = ((u + rng.random(way.shape[1])) / 2 * (1 << BITS)).astype(np.int64)
        out[c] = hilbert(np.clip(cell, 0, (1 << BITS) - 1), BITS)
    return out


def top(query: np.ndarray, qid: np.ndarray, cand: np.ndarray, cid: np.ndarray, k: int):
    """(query row, candidate id, cosine) of each query's k best other candidates: by cosine, then id."""
    found = []
    cols = 16384
    for at in range(0, len(query), 512):
        q, ids = query[at : at + 512], qid[at : at + 512]
        row, near, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for c in range(0, len(cand), cols):
            x, names = cand[c : c + cols], cid[c : c + cols]
            s = q @ x.T
            s[ids[:, None] == names] = -2  # a vector is no neighbour of its own
            m = min(k + 6, len(x))  # a few more: float32 decides who is looked at, float64 who stays
            best = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
            # values as good as the m-th may lie outside where copies tie
            floor = np.take_along_axis(s, best, 1).min(axis=1)
            if m < len(x):
                tied = np.flatnonzero((s >= floor[:, None] - 1e-6).sum(axis=1) > m)
            else:
                tied = np.zeros(0, np.int64)
            plain = np.setdiff1d(np.arange(len(q)), tied)
            r = [np.repeat(plain, m)]
            p = [best[plain].ravel()]
            for t in tied:
                w = np.flatnonzero(s[t] >= floor[t] - 1e-6)
                r.append(np.full(len(w), t))
                p.append(w)
            r, p = np.concatenate(r), np.concatenate(p)
            e = np.round(np.einsum("ij,ij->i", q[r].astype(np.float64), x[p].astype(np.float64)), 6)
            ok = names[p] != ids[r]
            row, near, sim = np.concatenate([row, r[ok]]), np.concatenate([near, names[p[ok]]]), np.concatenate([sim, e[ok]])
            order = np.lexsort((near, -sim, row))
            row, near, sim = row[order], near[order], sim[order]
            if len(row):
                nth = np.arange(len(row)) - np.searchsorted(row, row, "left")
                row, near, sim = row[nth < k], near[nth < k], sim[nth < k]
        found.append((row + at, near, sim))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def unit_vectors(table: DataFrame) -> tuple[DataFrame, int]:
    """(id, v) of the usable rows at unit length, one for each id; their dimension."""
    e = table.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    e = e.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(sound).withColumn("norm", norm)
    e = e.where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    sizes = e.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return e.select("id", "v"), 0
    dim = sizes[0]["dim"]
    unit = F.transform("v", lambda x: (x / F.col("norm")).cast("float"))
    return e.where(F.size("v") == dim).select("id", unit.alias("v")).groupBy("id").agg(F.min("v").alias("v")), dim


def neighbours(table: DataFrame, k: int = K, curves: int = CURVES, recall: float = RECALL) -> DataFrame:
    """(vec_id, rank, neighbour_id, cosine): the k nearest other vectors of every vector.

    Ranked by cosine (6 decimals), ties by smaller id.  Vectors that are null, empty, of zero or
    infinite length, of another dimension than the commonest, or hold a null or NaN are left out, as
    are null ids; of rows that share a vec_id the smallest vector counts.  Equal vectors of different
    ids are neighbours.  With k or fewer vectors each has all the others; an empty table gives no
    rows.  Columns other than vec_id and embedding are not read.
    """
    unit, dim = unit_vectors(table)
    if not dim:
        return unit.select(F.col("id").alias("vec_id"), F.lit(0).alias("rank"), F.col("id").alias("neighbour_id"), F.lit(0.0).alias("cosine")).limit(0)

    def keyed(batches):
        for b in batches:
            if b.num_rows:
                keys = curve_keys(_matrix(b.column(1), dim), curves).T
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * curves), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), listed], ["id", "v", "keys"])

    rows = cut(unit.mapInArrow(keyed, "id bigint, v array<float>, keys array<bigint>"))
    n = rows.count()
    blocks = max(1, round(n / BLOCK))
    # block bounds: quantiles of each curve's keys over all rows
    share = [i / blocks for i in range(1, blocks)]
    cuts = [np.zeros(0, np.int64)] * curves
    if share:
        got = rows.agg(*[F.percentile_approx(F.col("keys")[c], share, 50 * blocks).alias(str(c)) for c in range(curves)]).first()
        cuts = [np.unique(np.array(x, np.int64)) for x in got]
    use, reach = _plan(rows, cuts, dim, k, n, recall)
    last = [len(c) for c in cuts]

    def spread(batches):
        for b in batches:
            keys = np.array(b.column(2).flatten().to_numpy()).reshape(-1, curves)
            for c in range(use):
                own = np.searchsorted(cuts[c], keys[:, c], "right")
                lo, hi = np.maximum(own - reach, 0), np.minimum(own + reach, last[c])
                size = hi - lo + 1
                src = np.repeat(np.arange(len(own)), size)
                to = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(len(src))
                step = 8192
                for at in range(0, len(src), step):
                    s, t = src[at : at + step], to[at : at + step]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(s), c, np.int32)), pa.array(t.astype(np.int32)), pa.array(own[s] == t), b.column(0).take(pa.array(s)), b.column(1).take(pa.array(s))],
                        ["curve", "block", "own", "id", "v"],
                    )

    def search(t: pa.Table) -> pa.Table:
        own = t.column("own").to_numpy()
        ids, v = t.column("id").to_numpy(), _matrix(t.column("v"), dim)
        row, near, sim = top(v[own], ids[own], v, ids, k)
        return pa.table({"id": ids[own][row], "near": near, "sim": sim})

    windows = rows.mapInArrow(spread, "curve int, block int, own boolean, id bigint, v array<float>")
    found = windows.groupBy("curve", "block").applyInArrow(search, "id bigint, near bigint, sim double")
    if use > 1:
        found = found.groupBy("id", "near").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "near"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("id").alias("vec_id"), "rank", F.col("near").alias("neighbour_id"), F.col("sim").alias("cosine")
    )


def _plan(rows: DataFrame, cuts: list[np.ndarray], dim: int, k: int, n: int, recall: float) -> tuple[int, int]:
    """(curves, blocks to either side) of the cheapest windows that hold ``recall`` of the sample's true neighbours."""
    blocks = max(len(c) for c in cuts) + 1
    if blocks == 1:
        return 1, 0
    asked = rows.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(QUERIES).select("id", "v", "keys").toArrow()
    qid, q = asked.column("id").to_numpy(), _matrix(asked.column("v"), dim)
    own = np.array(asked.column("keys").combine_chunks().flatten().to_numpy()).reshape(len(qid), -1)

    def truth(batches):
        for b in batches:
            if b.num_rows:
                v, ids = _matrix(b.column(1), dim), b.column(0).to_numpy()
                row, near, sim = top(q, qid, v, ids, k)
                order = np.argsort(ids)
                at = order[np.searchsorted(ids[order], near)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), pa.array(near), pa.array(sim), b.column(2).take(pa.array(at))], ["q", "near", "sim", "keys"]
                )

    true = rows.mapInArrow(truth, "q bigint, near bigint, sim double, keys array<bigint>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "near"))
    true = true.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "keys").toArrow()
    at = true.column("q").to_numpy()
    theirs = np.array(true.column("keys").combine_chunks().flatten().to_numpy()).reshape(len(at), -1)
    apart = np.stack([np.abs(np.searchsorted(c, own[at, i], "right") - np.searchsorted(c, theirs[:, i], "right")) for i, c in enumerate(cuts)], axis=1)
    best = (blocks, 1, blocks - 1)  # a window over the whole curve
    for use in range(1, len(cuts) + 1):
        nearest = np.sort(apart[:, :use].min(axis=1))
        reach = int(nearest[max(0, math.ceil(recall * len(nearest)) - 1)])
        cost = use * min(2 * reach + 1, blocks)
        best = min(best, (cost, use, reach))
    if best[0] >= 0.75 * blocks:  # hardly cheaper than the whole, which misses nothing
        best = (blocks, 1, blocks - 1)
    return best[1], best[2]
