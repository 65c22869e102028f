"""Sharding by sampled splitters.

Records are range-partitioned by a key.  Splitters come from a sample in which a record is drawn with
a probability in proportion to its size, as quantiles of the drawn keys, so ranges hold about equal
bytes whatever the sizes and however hot a key prefix is.  Then every range is measured: an overfull
one is subdivided at the keys where its exact running size passes a shard's share, and a single key
that is still overfull is parted by a hash of its records' text.  Keys, sizes and hashes are written
once to the shared folder, so the texts are read twice in all: to be measured and to be moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm._state import cut

SHARDS = 64
#: Draws for each shard, about: the spread of a range's size is about 1 / sqrt(DRAWS).
DRAWS = 64
#: A range is overfull beyond this many hundredths of a shard's share.
SLACK = 125


def _hash32(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def _range(key: Column, bounds: list) -> Column:
    """Number of bounds <= key, by binary search in a sorted literal array."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.struct(F.lit(a).cast("string").alias("source"), F.lit(b).cast("bigint").alias("doc_id")) for a, b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def descend(at: Column, step: Column) -> Column:
        to = at + step
        return F.when((to <= len(bounds)) & (F.try_element_at(table, to) <= key), to).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), descend)


def splitters(keys: DataFrame, shards: int, draws: int, total: int) -> list:
    """Sorted distinct (source, doc_id) bounds from (source, doc_id, size)."""
    p = F.col("size") * float(shards * draws) / float(total)
    u = _hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) / float(1 << 32)
    drawn = keys.withColumn("c", (F.floor(p) + F.when(u < p - F.floor(p), 1).otherwise(0)).cast("bigint")).where("c > 0")
    # a shard's draws in expectation: the sample is bounded by the parameters, not by the data
    rows = sorted(((r["source"], r["doc_id"], r["c"]) for r in drawn.select("source", "doc_id", "c").toLocalIterator()), key=lambda r: _order(r[:2]))
    all_draws, seen, out = sum(r[2] for r in rows), 0, []
    for source, doc_id, c in rows:
        before, seen = seen, seen + c
        if seen * shards // all_draws > before * shards // all_draws and (seen < all_draws or before * shards // all_draws < shards - 1):
            out.append((source, doc_id))
    return sorted(set(out), key=_order)


def _order(key) -> tuple:
    source, doc_id = key
    return (source is not None, (source or "").encode(), doc_id is not None, doc_id or 0)


def assign(docs: DataFrame, shards: int = SHARDS, draws: int = DRAWS, slack: int = SLACK) -> DataFrame:
    """The documents with ``shard`` and ``part``, one Spark partition for each pair.

    The key is (source, doc_id), nulls first; shard i holds smaller keys than shard i + 1.  A record's
    size is its text's bytes plus 1, a null text having none.  ``part`` is 0 but for a key whose records
    alone overfill a shard: there it is a hash of the text, so equal texts stay together, and a single
    record is never divided.  All rows and columns are kept, repeated rows too; columns of the table
    that are named shard or part are replaced.  An empty table gives no rows.
    """
    key = F.struct("source", "doc_id")
    size = (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("bigint")
    keys = cut(docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("size")))
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return docs.withColumns({"shard": F.lit(0), "part": F.lit(0)})
    bounds = splitters(keys, shards, draws, total)
    placed = keys.withColumn("shard", _range(key, bounds))
    over = _overfull(placed, shards, slack, total)
    if over:
        # the exact running size of an overfull range's keys; a new bound wherever it enters another share
        w = Window.partitionBy("shard").orderBy("source", "doc_id")
        each = placed.where(F.col("shard").isin(list(over))).groupBy("shard", "source", "doc_id").agg(F.sum("size").alias("size"))
        before = F.sum("size").over(w) - F.col("size")
        piece = F.floor(before * shards / total).cast("bigint")
        opened = each.withColumn("piece", piece).withColumn("last", F.lag("piece").over(w)).where("piece > last")
        bounds = sorted({*bounds, *((r["source"], r["doc_id"]) for r in opened.select("source", "doc_id").collect())}, key=_order)
        placed = keys.withColumn("shard", _range(key, bounds))
        over = _overfull(placed, shards, slack, total)
    shard = _range(F.struct(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("bigint").alias("doc_id")), bounds)
    parts = F.lit(1)
    if over:
        parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for s, n in over.items() for x in (s, n)]), F.col("shard")), F.lit(1))
    part = F.pmod(_hash32(F.coalesce(F.col("text").cast("string"), F.lit(""))), parts).cast("int")
    out = docs.withColumn("shard", shard)
    out = out.withColumn("part", F.when(parts > 1, part).otherwise(0) if over else F.lit(0))
    # each shard and part a partition of its own
    first, n = {}, 0
    for s in range(len(bounds) + 1):
        first[s] = n
        n += over.get(s, 1)
    at = F.element_at(F.array(*[F.lit(first[s]) for s in range(len(bounds) + 1)]), F.col("shard") + 1) + F.col("part")
    return out.repartitionById(n, at)


def _overfull(placed: DataFrame, shards: int, slack: int, total: int) -> dict[int, int]:
    """Number of parts for each range that holds more than its share and the slack."""
    rows = placed.groupBy("shard").agg(F.sum("size").alias("size")).where(F.col("size") * (100 * shards) > F.lit(slack * total)).collect()
    return {r["shard"]: -(-r["size"] * shards // total) for r in rows}


SQL = """
WITH k AS (
  SELECT *, strlen(coalesce(text, '')) + 1 AS size FROM documents),
t AS (SELECT CAST(sum(size) AS BIGINT) AS total FROM k),
p AS (
  SELECT source, doc_id, size * 4096.0::DOUBLE / total::DOUBLE AS p,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM k, t),
c AS (SELECT source, doc_id, CAST(floor(p) AS BIGINT) + CASE WHEN u < p - floor(p) THEN 1 ELSE 0 END AS c FROM p),
s AS (SELECT source, doc_id, c, sum(c) OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS seen, sum(c) OVER () AS n FROM c WHERE c > 0),
b AS (SELECT DISTINCT source, doc_id FROM s
      WHERE (seen * 64) // n > ((seen - c) * 64) // n AND (seen < n OR ((seen - c) * 64) // n < 63)),
r AS (SELECT k.source, k.doc_id, size, (SELECT count(*) FROM b WHERE (b.source, b.doc_id) <= (k.source, k.doc_id)) AS rng FROM k),
o AS (SELECT rng FROM r, t GROUP BY rng, total HAVING sum(size) * 6400 > 125 * total),
e AS (SELECT rng, source, doc_id, sum(size) AS size FROM r WHERE rng IN (SELECT rng FROM o) GROUP BY ALL),
w AS (SELECT rng, source, doc_id, CAST(floor(CAST((sum(size) OVER (PARTITION BY rng ORDER BY source, doc_id) - size) * 64 AS DOUBLE) / total) AS BIGINT) AS piece FROM e, t),
l AS (SELECT *, lag(piece) OVER (PARTITION BY rng ORDER BY source, doc_id) AS last FROM w),
bb AS (SELECT source, doc_id FROM b UNION SELECT source, doc_id FROM l WHERE piece > last),
f AS (SELECT k.*, (SELECT count(*) FROM bb WHERE (bb.source, bb.doc_id) <= (k.source, k.doc_id)) AS shard FROM k),
z AS (SELECT shard, (sum(size) * 64 + total - 1) // total AS parts
      FROM f, t GROUP BY shard, total HAVING sum(size) * 6400 > 125 * total)
SELECT f.doc_id, f.text, f.lang, f.source, f.n_chars, CAST(f.shard AS INTEGER) AS shard,
       CAST(coalesce(('0x' || substr(md5(coalesce(f.text, '')), 1, 8))::BIGINT % CAST(z.parts AS BIGINT), 0) AS INTEGER) AS part
FROM f LEFT JOIN z USING (shard)
"""
