"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared by their bytes in lower case (ASCII), every white-space byte being a blank.  An
item of length n leaks into a document when some substring of the document is within
``e = floor(rate * n)`` edits of it.  By the q-gram lemma such a substring shares at least
``n - q + 1 - q * e`` q-grams with the item, and they lie on neighbouring diagonals.  Grams have Q bytes,
or fewer where an item is too short for that bound to say anything: ``q = min(Q, floor(n / (e + 1)))``.
So: look up every document position's q-gram among the items', count the hits of each item in
diagonal bands of width 2(e+1) that overlap by half, keep the bands that reach the bound, and verify
each by a banded alignment.  The filter loses nothing; its survivors are decided exactly.

The benchmark is read from its table as it is needed and travels in slices of about ``SLICE`` bytes; the
documents are read once for each ``PASS`` slices, and what a pass finds is written before the next.  So
neither the driver nor a closure, a plan or a worker's index grows with the benchmark, and how many
passes it takes changes nothing in the rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm._state import cut
from termloom.llm._text import buffers, mix, pieces

Q, RATE = 10, 0.08
#: Bytes of benchmark text in a slice, whose index takes about forty times that; slices in one pass.
SLICE, PASS = 1 << 20, 4
#: Cells of text under the bands that are aligned together.
CELLS = 1 << 21

_FLAT = np.arange(256, dtype=np.uint8)
_FLAT[65:91] += 32
_FLAT[[9, 10, 11, 12, 13]] = 32


def codes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of the q bytes from each position (q <= 16); they may reach past the end."""
    n = len(data)
    raw = np.concatenate([data, np.zeros(16, np.uint8)]).tobytes()
    a = np.ndarray((n,), "<u8", raw, strides=(1,))
    if q < 8:
        return ((a & np.uint64((1 << 8 * q) - 1)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    b = np.ndarray((n,), "<u8", raw, offset=8, strides=(1,)) & np.uint64((1 << 8 * (q - 8)) - 1)
    return a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)


def budget(n: np.ndarray, q: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(edits allowed, length of grams) of items of n bytes."""
    e = (rate * n).astype(np.int64)
    return e, np.minimum(q, n // (e + 1))


def indices(ids: np.ndarray, texts: list[bytes], q: int = Q, rate: float = RATE) -> list[Index]:
    """An index for each length of grams that the items need; an empty item is in none."""
    n = np.array([len(t) for t in texts], np.int64)
    own = budget(n, q, rate)[1]
    return [Index(ids[own == g], [texts[i] for i in np.flatnonzero(own == g)], int(g), rate) for g in np.unique(own[own > 0])]


class Index:
    """The items' q-grams: a bitmap over code prefixes, sorted codes, and (item, position) of each."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], q: int = Q, rate: float = RATE):
        self.q, self.ids, self.text = q, ids, [_FLAT[np.frombuffer(t, np.uint8)] for t in texts]
        n = np.array([len(t) for t in self.text], np.int64)
        self.n = n
        self.e = (rate * n).astype(np.int64)
        self.need = n - q + 1 - q * self.e
        data = np.concatenate([*self.text, np.zeros(0, np.uint8)])
        at = np.cumsum(n) - n
        pos = np.concatenate([[0], *[np.arange(k - q + 1) for k in n]]).astype(np.int64)[1:]
        item = np.repeat(np.arange(len(n)), n - q + 1)
        code = codes(data, q)[at[item] + pos]
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.pos = code[order], item[order], pos[order]
        self.bits = max(16, min(24, int(len(code)).bit_length() + 5))
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self._slot(self.code)] = True

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code ^ (code >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)

    def regions(self, data: np.ndarray, code: np.ndarray, offsets: np.ndarray):
        """(item, doc, lowest diagonal) of the bands that reach the item's bound; diagonals count from the
        data's start.  Last, (items, docs) of the pairs that match without an edit and need no band."""
        hit = np.flatnonzero(self.map[self._slot(code)])
        lo = np.searchsorted(self.code, code[hit], "left")
        size = np.searchsorted(self.code, code[hit], "right") - lo
        x = np.repeat(hit, size)
        entry = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        item = self.item[entry]
        diagonal = x - self.pos[entry] + (1 << 24)  # never negative: an item may begin before its document does
        if not len(item):
            z = np.zeros(0, np.int64)
            return z, z, z, (z, z)
        doc = np.searchsorted(offsets, x, "right") - 1
        # every q-gram on one diagonal: the bytes are equal, as far as codes tell; that is looked up below
        same = mix((item.astype(np.uint64) << np.uint64(44)) | diagonal.astype(np.uint64)) + doc.astype(np.uint64)
        _, first, count = np.unique(same, return_index=True, return_counts=True)
        first = first[count >= (self.n - self.q + 1)[item[first]]]
        first = first[[self._equal(data, offsets[doc[i] : doc[i] + 2], item[i], diagonal[i] - (1 << 24)) for i in first]] if len(first) else first
        equal = np.unique(item[first] << 32 | doc[first])
        # the other pairs' hits go on to the bands
        rest = ~np.isin(item << 32 | doc, equal)
        x, item, doc, diagonal = x[rest], item[rest], doc[rest], diagonal[rest]
        equal = equal >> 32, equal & ((1 << 32) - 1)
        if not len(item):
            z = np.zeros(0, np.int64)
            return z, z, z, equal
        width = self.e[item] + 1
        band = diagonal // width
        found = []
        for shift in (0, 1):  # each hit counts in the band that begins at its half, and in the one before
            key = (item.astype(np.uint64) << np.uint64(44)) | (band - shift).astype(np.uint64)
            found.append(mix(key) + doc.astype(np.uint64))
        key = np.concatenate(found)
        unique, first, count = np.unique(key, return_index=True, return_counts=True)
        which = first % len(item)
        shift = first // len(item)
        good = count >= self.need[item[which]]
        which, shift = which[good], shift[good]
        return item[which], doc[which], (band[which] - shift) * width[which] - (1 << 24), equal

    def _equal(self, data: np.ndarray, limits: np.ndarray, item: int, at: int) -> bool:
        end = at + self.n[item]
        return bool(at >= limits[0] and end <= limits[1] and (data[at:end] == self.text[item]).all())

    def distances(self, item: np.ndarray, doc: np.ndarray, diagonal: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Fewest edits between each item and a substring of its region, by alignment within the band.

        The band holds the 2(e+1) diagonals of the region and e more on either side; positions outside
        the document match nothing.
        """
        out = np.empty(len(item), np.int64)
        order = np.argsort(self.n[item], kind="stable")  # like lengths together
        at = 0
        while at < len(order):
            end = min(at + 512, len(order))
            while end > at + 1 and (end - at) * int(self.n[item[order[end - 1]]] + 4 * self.e[item[order[end - 1]]] + 3) > CELLS:
                end = (at + end) // 2
            r = order[at:end]
            out[r] = self._align(item[r], doc[r], diagonal[r], int(self.e[item[r]].max()), offsets, data)
            at = end
        return out

    def _align(self, item, doc, diagonal, e, offsets, data):
        n = self.n[item]
        width = 2 * (e + 1) + 2 * e
        low = diagonal - e  # text position of band cell k in row i: low + i + k
        longest = int(n.max())
        want = np.zeros((len(item), longest), np.int16) - 1
        for i in np.unique(item):
            want[item == i, : self.n[i]] = self.text[i]
        k = np.arange(width, dtype=np.int32)
        start, stop = offsets[doc][:, None], offsets[doc + 1][:, None]
        big = 1 << 28  # beyond any budget
        # the text under every cell that a row's band may hold; -2 outside the document
        pos = low[:, None] + np.arange(longest + width + 1)
        inside = (pos >= start) & (pos < stop)
        text = np.where(inside, data[np.clip(pos, 0, len(data) - 1)], -2).astype(np.int16)
        block = np.where(inside, 0, big).astype(np.int32)  # a character that no match may use
        edge = np.where((pos >= start) & (pos <= stop), 0, big).astype(np.int32)
        # before row 1 a match may begin anywhere in the document, at no cost
        d = edge[:, :width].copy()
        up = np.full_like(d, big)
        best = np.full(len(item), big, np.int64)
        last = {int(i): np.flatnonzero(n == i) for i in np.unique(n)}
        for i in range(1, longest + 1):
            up[:, :-1] = d[:, 1:]
            up += 1
            d += text[:, i - 1 : i - 1 + width] != want[:, i - 1 : i]
            d += block[:, i - 1 : i - 1 + width]
            np.minimum(d, up, out=d)
            d -= k
            np.minimum.accumulate(d, axis=1, out=d)
            d += k
            d += edge[:, i : i + width]
            np.minimum(d, big, out=d)
            up[:, -1] = big
            if i in last:
                best[last[i]] = d[last[i]].min(axis=1)
        return best

    def matches(self, offsets: np.ndarray, data: np.ndarray):
        """(doc, item, edits) of every leak in the texts, once for each pair."""
        flat = _FLAT[data]
        # a q-gram that reaches into the next text is none
        code = codes(flat, self.q)
        edge = offsets[1:-1][(offsets[1:-1] > 0)]
        bad = np.zeros(len(flat) + 1, np.int64)
        if len(flat):
            np.add.at(bad, np.maximum(edge - self.q + 1, 0), 1)
            np.add.at(bad, edge, -1)
        spoiled = np.cumsum(bad[:-1]) > 0
        spoiled[max(0, len(flat) - self.q + 1) :] = True
        code[spoiled] = 0
        if not len(self.n):
            z = np.zeros(0, np.int64)
            return z, z, z
        item, doc, diagonal, equal = self.regions(flat, code, offsets)
        edits = self.distances(item, doc, diagonal, offsets, flat)
        ok = edits <= self.e[item]
        item, doc = np.concatenate([item[ok], equal[0]]), np.concatenate([doc[ok], equal[1]])
        edits = np.concatenate([edits[ok], np.zeros(len(equal[0]), np.int64)])
        order = np.lexsort((edits, item, doc))
        item, doc, edits = item[order], doc[order], edits[order]
        head = np.ones(len(item), bool)
        head[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])
        return doc[head], item[head], edits[head]


def _slices(benchmark: DataFrame):
    """The benchmark as lists of (ids, texts) of about SLICE bytes, each item once; a part of the table at a time."""
    b = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = b.where("item_id IS NOT NULL AND text <> ''").distinct().orderBy("item_id", "text").toLocalIterator()
    ids, texts, size = [], [], 0
    for row in rows:
        text = row["text"].encode()
        if ids and size + len(text) > SLICE:
            yield np.array(ids, np.int64), texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(text)
        size += len(text)
    if ids:
        yield np.array(ids, np.int64), texts


def _passes(benchmark: DataFrame):
    """(slices, whether more follow) for each pass over the documents; none without any item."""
    slices = _slices(benchmark)
    part = list(itertools.islice(slices, PASS))
    while part:
        after = list(itertools.islice(slices, PASS))
        yield part, bool(after)
        part = after


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, edits) of each document and benchmark item that leaks into it.

    ``edits`` is the smallest number of edits over the document's matching regions.  Null and empty
    texts on either side match nothing; an item of any other length matches within its budget, which is 0
    for the shortest.  Very long texts and items are compared whole.  Rows of documents that repeat a
    doc_id and a text give one row for an item, rows that share a doc_id (or have none) but not their text
    one each, however large the benchmark.  Repeated items count once; item_ids that name several texts
    give the smallest number of edits.  Empty tables give no rows.  Columns other than the ids and texts
    are not read.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.where("text <> ''").withColumn("h", F.xxhash64("text"))
    schema = "doc_id bigint, h bigint, item_id bigint, edits int"

    def search(slices):
        def run(batches):
            every = [x for ids, texts in slices for x in indices(ids, texts, q, rate)]
            for piece in pieces(batches):
                o, data = buffers(piece.column(1))
                for index in every:
                    doc, item, edits = index.matches(o, data)
                    if len(doc):
                        at = pa.array(doc)
                        yield pa.RecordBatch.from_arrays(
                            [piece.column(0).take(at), piece.column(2).take(at), pa.array(index.ids[item]), pa.array(edits.astype(np.int32))],
                            ["doc_id", "h", "item_id", "edits"],
                        )

        return run

    found = d.sparkSession.createDataFrame([], schema)
    for part, more in _passes(benchmark):
        found = found.unionByName(d.mapInArrow(search(part), schema))
        found = found.groupBy("doc_id", "h", "item_id").agg(F.min("edits").alias("edits"))
        if more:
            found = cut(found)
    return found.select("doc_id", "item_id", "edits")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """The documents into which no item leaks, with all their columns.

    Each row is decided by its own text, whatever its doc_id; rows that repeat go or stay together.  Null
    and empty texts stay.  Items of every length count, and all of a text is compared.  An empty benchmark
    leaves the documents as they are, an empty table gives no rows.
    """
    text = docs.columns.index("text")

    def keep(slices):
        def run(batches):
            every = [x for ids, texts in slices for x in indices(ids, texts, q, rate)]
            for piece in pieces(batches):
                clean = np.ones(piece.num_rows, bool)
                o, data = buffers(piece.column(text))
                for index in every:
                    clean[index.matches(o, data)[0]] = False
                yield piece.filter(pa.array(clean))

        return run

    for part, more in _passes(benchmark):
        docs = docs.mapInArrow(keep(part), docs.schema)
        if more:  # or every pass's indices would be in memory together
            docs = cut(docs)
    return docs
