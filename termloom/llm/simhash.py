"""SimHash near-duplicates by multi-index hashing.

Fingerprint: ``SEGMENTS * SEGMENT_BITS`` sign bits, each a majority vote of the document's distinct
words (lower-cased runs of letters and digits).  Two documents are linked when their fingerprints
differ in at most ``max_distance`` bits; a group is a connected component of those links.

Search: a table per fingerprint segment, keyed by the segment's value.  Every fingerprint probes
each table with the whole Hamming ball of radius ``radius`` around its own value, and each match is
verified on the complete fingerprint.  Pairs up to ``SEGMENTS * (radius + 1) - 1`` bits apart are
always found; beyond that, at ``max_distance``, a pair is missed with a probability below 0.1.
Tables are split by the segment's top bits, the number of which follows the number of fingerprints,
so a task's share stays bounded; the part of the ball that leaves a split is sent there, the rest is
enumerated in place against a bitmap.  A split that is overfull all the same, as very many near copies
share a segment, is cut into blocks, and every block meets every other in a task of its own.  Within a
task, fingerprints under one value are linked to a few of their number first, and pairs that are in one
component already are not enumerated, so a family of copies costs about its size and not its square.

A row's identity is its doc_id and its text (by a 64-bit hash): rows that share a doc_id but not their
text are apart.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm._state import cut, one_of_equal
from termloom.llm._text import binary, buffers, components, mix, pieces, span_hash, words

SEGMENTS, SEGMENT_BITS, RADIUS, MAX_DISTANCE = 10, 24, 2, 36
BITS = SEGMENTS * SEGMENT_BITS
#: Fingerprints in one split of a segment's table; a split of more than HOT times that is cut into blocks.
SPLIT_ROWS, HOT = 1 << 19, 4
PAIRS = 1 << 21
#: Fingerprints under one value from which pivots come first, and pivots for each.
CROWD, PIVOTS = 32, 4

# byte value -> eight one-byte counters, one for each bit
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def fingerprints(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(documents, BITS // 8) bytes.  A text without words votes with the hash of its bytes alone."""
    docs = len(offsets) - 1
    _, _, doc, h = words(offsets, data)
    key = np.unique((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    has = np.zeros(docs, bool)
    has[doc] = True
    bare = np.flatnonzero(~has)
    whole = span_hash(data, offsets[bare], offsets[bare + 1])
    key = np.sort(np.concatenate([key, (bare.astype(np.uint64) << np.uint64(48)) | (whole >> np.uint64(16))]))
    doc = (key >> np.uint64(48)).astype(np.int64)
    h = key & np.uint64((1 << 48) - 1)
    n = np.bincount(doc, minlength=docs)
    first = np.cumsum(n) - n
    part = -(-n // 255)
    owner = np.repeat(np.arange(docs), part)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(part) - part, part)
    cuts = first[owner] + 255 * nth
    counts = np.empty((len(owner), BITS), np.int32)
    for k in range(-(-BITS // 64)):
        b = mix(h, k + 1).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            lane = 8 * k + j
            if lane * 8 < BITS:
                votes = np.add.reduceat(_LANES[b[:, j]], cuts)
                counts[:, lane * 8 : lane * 8 + 8] = votes.view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(counts, np.cumsum(part) - part, axis=0) if len(owner) else np.zeros((0, BITS), np.int32)
    return np.packbits(2 * total > n[:, None], axis=1)


def _fingerprint_batches(batches):
    for piece in pieces(batches):
        fp = fingerprints(*buffers(piece.column(1)))
        o = np.arange(len(fp) + 1) * (BITS // 8)
        yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), binary(fp.ravel(), o)], ["doc_id", "h", "fp"])


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp) of the documents that have a doc_id and a text; h is the text's hash."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    return d.mapInArrow(_fingerprint_batches, "doc_id bigint, h bigint, fp binary")


def _ball(bits: int, radius: int) -> list[tuple[int, int]]:
    """(mask, flipped bits) of every mask of at most ``radius`` bits."""
    return [(sum(1 << b for b in c), r) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)]


def _near(fp: np.ndarray, x: np.ndarray, y: np.ndarray, max_distance: int) -> np.ndarray:
    return np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1) <= max_distance


def _links(low_bits: int, radius: int, max_distance: int, crowd: int):
    masks = _ball(low_bits, radius)

    def run(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        flips = table.column("flips").to_numpy()
        probing = table.column("probe").to_numpy(zero_copy_only=False)
        _, raw = buffers(table.column("fp"))
        key = table.column("low").to_numpy().astype(np.int64)
        fp = np.zeros((len(rep), 4), np.uint64)
        fp.view(np.uint8)[:, : BITS // 8] = raw.reshape(len(rep), -1)
        nodes, node = np.unique(rep, return_inverse=True)
        n = len(nodes)
        label = np.arange(n)
        home = np.flatnonzero((flips == 0) & table.column("home").to_numpy(zero_copy_only=False))
        _pivots(home, key, fp, node, label, max_distance, crowd)
        there = np.zeros(1 << low_bits, bool)
        there[key[home]] = True
        sets = {f: np.flatnonzero((flips == f) & probing) for f in np.unique(flips).tolist()}
        place = None
        for mask, flipped in masks:
            if mask == 0 or flipped == 1 and mask == 1:  # labels as they are now tell what needs no look
                known = label[node]
                place = key[home] * n + known[home]
                order = np.argsort(place, kind="stable")
                place, at_home = place[order], home[order]
            for f, rows in sets.items():
                if f + flipped > radius:
                    continue
                probe = key[rows] ^ mask
                hit = there[probe]
                q, v = rows[hit], probe[hit] * n
                # under the value, what comes before the probe's own component and what after it
                own = v + known[q]
                ends = [(v, own), (own + 1, v + n)]
                lo = np.concatenate([np.searchsorted(place, a, "left") for a, _ in ends])
                size = np.concatenate([np.searchsorted(place, b, "left") for _, b in ends]) - lo
                q = np.concatenate([q, q])
                some = np.flatnonzero(size)
                q, lo, size = q[some], lo[some], size[some]
                at, total = 0, np.cumsum(size)
                while at < len(q):  # at most about PAIRS pairs at a time
                    done = total[at - 1] if at else 0
                    end = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
                    s = size[at:end]
                    x = np.repeat(q[at:end], s)
                    y = at_home[np.repeat(lo[at:end] - (np.cumsum(s) - s), s) + np.arange(s.sum())]
                    at = end
                    new = label[node[x]] != label[node[y]]
                    x, y = x[new], y[new]
                    near = _near(fp, x, y, max_distance)
                    if near.any():
                        components(n, node[x[near]], node[y[near]], label)
        out = np.flatnonzero(label != np.arange(n))
        return pa.table({"a": nodes[out], "b": nodes[label[out]]})

    return run


def _pivots(home: np.ndarray, key: np.ndarray, fp: np.ndarray, node: np.ndarray, label: np.ndarray, max_distance: int, crowd: int) -> None:
    """Links the rows of each crowded value to PIVOTS of them, each the first that no earlier one has caught."""
    home = home[np.argsort(key[home], kind="stable")]
    first, size = np.unique(key[home], return_index=True, return_counts=True)[1:]
    rows = home[np.repeat(size >= crowd, size)]
    for _ in range(PIVOTS):
        if not len(rows):
            return
        head = np.flatnonzero(np.append(True, key[rows[1:]] != key[rows[:-1]]))
        pivot = np.repeat(rows[head], np.diff(np.append(head, len(rows))))
        near = _near(fp, rows, pivot, max_distance)
        components(len(label), node[rows[near]], node[pivot[near]], label)
        rows = rows[~near]


def links(fps: DataFrame, radius: int = RADIUS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): links that span the groups of the distinct fingerprints (rep, fp)."""
    n = fps.count()
    top = max(0, math.ceil(math.log2(max(1, n) / SPLIT_ROWS)))
    top = min(top, SEGMENT_BITS - 8)
    low = SEGMENT_BITS - top
    # the segment's value from its three bytes, in the JVM
    value = [
        sum(F.conv(F.hex(F.substring("fp", 3 * s + 1 + i, 1)), 16, 10).cast("int") * (1 << 8 * (2 - i)) for i in range(3))
        for s in range(SEGMENTS)
    ]
    spread = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), v.alias("value")) for s, v in enumerate(value)]))
    balls = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(f).alias("flips")) for m, f in _ball(top, radius)]))
    valued = fps.select("rep", "fp", spread.alias("s")).select("rep", "fp", "s.seg", "s.value")
    rows = valued.select("rep", "fp", "seg", "value", balls.alias("p")).select(
        "rep", "fp", "seg", F.shiftright("value", low).bitwiseXOR(F.col("p.mask")).alias("split"),
        F.col("value").bitwiseAND((1 << low) - 1).alias("low"), F.col("p.flips").alias("flips"),
    )
    # (home block, probe block): one of each but for the overfull splits, of which there are at most SEGMENTS * n / (HOT * SPLIT_ROWS)
    counts = valued.groupBy("seg", F.shiftright("value", low).alias("split")).count().where(F.col("count") > HOT * SPLIT_ROWS).collect()
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("home"), F.lit(True).alias("probe")))
    tasks = one
    if counts:
        many = F.create_map(*[F.lit(x) for r in counts for x in (r["seg"] << SEGMENT_BITS | r["split"], -(-r["count"] // SPLIT_ROWS))])
        blocks = F.try_element_at(many, F.col("seg") * (1 << SEGMENT_BITS) + F.col("split"))
        part = F.pmod(F.xxhash64("rep"), blocks).cast("int")
        pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"), (i == part).alias("home"), (j == part).alias("probe"))
        every = F.sequence(F.lit(0), (blocks - 1).cast("int"))
        others = F.filter(every, lambda i: i != part)
        homes = F.when(F.col("flips") == 0, F.transform(every, lambda j: pair(part, j))).otherwise(F.array(pair(part, part)))
        tasks = F.when(blocks.isNull(), one).otherwise(F.concat(homes, F.transform(others, lambda i: pair(i, part))))
    rows = rows.withColumn("t", F.explode(tasks)).select("rep", "fp", "seg", "split", "low", "flips", "t.i", "t.j", "t.home", "t.probe")
    return rows.groupBy("seg", "split", "i", "j").applyInArrow(_links(low, radius, max_distance, CROWD), "a bigint, b bigint")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node of each component, by alternating large and small stars.

    Every round is two aggregations over the edges; the rounds end when the edges no longer change.
    """
    from pyspark.sql import Window

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        # large star: every larger neighbour of u is linked with the smallest of u and its neighbours
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        w = Window.partitionBy("a")
        large = (
            both.withColumn("m", F.least(F.min("b").over(w), F.col("a")))
            .where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        # small star: u and its smaller neighbours are linked with the smallest of them
        small = large.withColumn("m", F.min("b").over(w))
        small = small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = now


def _members(docs: DataFrame, radius: int = RADIUS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, h, rep, first) of each different row: its component, and the component's smallest (doc_id, h)."""
    fps = cut(fingerprint_table(docs).distinct())
    least = fps.groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("least"))
    reps = cut(least.withColumn("rep", F.monotonically_increasing_id()))
    label = connected(links(reps.select("rep", "fp"), radius, max_distance)).withColumnRenamed("node", "rep")
    named = cut(reps.join(label, "rep", "left").select("fp", "least", F.coalesce("label", "rep").alias("rep")))
    # by component first, then by fingerprint: neither shuffles a row for each copy
    lead = named.groupBy("rep").agg(F.min("least").alias("first"))
    return fps.join(named.join(lead, "rep").select("fp", "rep", "first"), "fp").select("doc_id", "h", "rep", "first")


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, group_id, group_size) of every document that has a near copy.

    ``group_id`` is the group's smallest doc_id, ``group_size`` the number of its doc_ids.  Rows with a
    null doc_id or text are in no group.  Texts without words (empty ones too) group when their bytes are
    equal.  Equal texts always group.  Rows that repeat a doc_id and a text are one; rows that share a
    doc_id alone are apart, so a doc_id has a row for each of its texts' groups, and a group of one
    doc_id is none.  Texts of any length are read whole.  An empty table gives no rows; columns other
    than doc_id and text are not read.
    """
    each = _members(docs, radius, max_distance).groupBy("rep", "doc_id").agg(F.min("first.doc_id").alias("group_id"))
    each = cut(each)
    sizes = each.groupBy("rep").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return each.join(sizes, "rep").select("doc_id", "group_id", "group_size")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, with one row for each group: the one with the smallest doc_id.

    Of rows in a group that share this doc_id, the text with the smallest hash stays; of rows that repeat
    a doc_id and a text, one.  Rows with a null doc_id or a null text have no group and stay, whatever
    other rows hold, and so do rows whose text is near no other.  All columns are kept.  An empty table
    gives no rows.
    """
    away = _members(docs).where("doc_id <> first.doc_id OR h <> first.h").select(F.col("doc_id").alias("__tl_id"), F.col("h").alias("__tl_h"))
    h = F.when(F.col("text").isNotNull(), F.xxhash64(F.col("text").cast("string")))
    kept = docs.join(away, (docs["doc_id"] == F.col("__tl_id")) & (h == F.col("__tl_h")), "left_anti")
    return one_of_equal(kept, docs)
