"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are counts of bytes and words, repetition, and the share of words from two lexicons
learned from the labels (words that go with toxic texts, words that go with low quality).  Two
ensembles, for quality and for toxicity, are trained in numpy on binned statistics by second-order
boosting with the logistic loss, one level at a time from histograms of gradients.  The trees are
flattened into arrays of features, thresholds and leaves, and all rows of a piece of text descend
together.

The fit reads a bounded sample of labelled rows (at most about ``SAMPLE``, drawn by a hash of
doc_id); every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm._state import cut
from termloom.llm._text import buffers, pieces, span_hash, words

SAMPLE, LEXICON, LEAST = 12_000, 256, 10
TREES, DEPTH, BINS, RATE, SMOOTH = 40, 4, 64, 0.25, 1.0

NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "mark", "blank", "line", "wide", "distinct_words",
    "top_word", "same_as_last", "same_as_last_but_one", "capital_words", "marked_words", "distinct_lines", "toxic_words", "toxic_share", "poor_words", "poor_share",
)

_CLASS = np.full(256, 3, np.uint8)  # lower, upper, digit, mark, blank, line, wide
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[128:] = 0, 1, 2, 4, 5, 6


def _member(h: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros(len(h), bool)
    return lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h


def statistics(offsets: np.ndarray, data: np.ndarray, toxic: np.ndarray, poor: np.ndarray) -> np.ndarray:
    """(texts, NAMES) float32; toxic and poor are sorted word hashes."""
    docs = len(offsets) - 1
    x = np.zeros((docs, len(NAMES)), np.float32)
    size = np.diff(offsets)
    x[:, 0] = np.log1p(size)
    if not len(data):
        return x
    full = np.flatnonzero(size)
    cls = _CLASS[data]
    share = 1 / np.maximum(size, 1)
    for col, k in ((3, 1), (4, 2), (5, 3), (6, 4), (7, 5), (8, 6)):
        x[full, col] = np.add.reduceat((cls == k).view(np.uint8), offsets[full], dtype=np.int32) * share[full]
    start, end, doc, h = words(offsets, data)
    n = np.bincount(doc, minlength=docs)
    each = 1 / np.maximum(n, 1)
    mean = lambda flag, at=doc: np.bincount(at[flag], minlength=docs) * each
    x[:, 1] = np.log1p(n)
    x[:, 2] = np.bincount(doc, weights=end - start, minlength=docs) * each
    key, count = np.unique((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)), return_counts=True)
    owner = (key >> np.uint64(48)).astype(np.int64)
    distinct = np.bincount(owner, minlength=docs)
    x[:, 9] = distinct * each
    some = np.flatnonzero(distinct)
    x[some, 10] = np.maximum.reduceat(count, (np.cumsum(distinct) - distinct)[some]) * each[some]
    for col, back in ((11, 1), (12, 2)):
        if len(h) > back:
            x[:, col] = mean((h[back:] == h[:-back]) & (doc[back:] == doc[:-back]), doc[back:])
    first, last = cls[start], cls[np.minimum(end - 1, len(data) - 1)]
    x[:, 13] = mean((first == 1) & (last == 1) & (end - start > 1))
    after = np.minimum(end, len(data) - 1)
    x[:, 14] = mean((end < offsets[doc + 1]) & (cls[after] == 3) & (data[after] != 44) & (data[after] != 46))
    # lines: the texts' ends end one too
    stop = np.union1d(np.flatnonzero(cls == 5) + 1, offsets[1:][size > 0])
    begin = np.append(0, stop[:-1])
    at = np.searchsorted(offsets, begin, "right") - 1
    lines = np.unique((at.astype(np.uint64) << np.uint64(48)) | (span_hash(data, begin, stop) >> np.uint64(16)))
    x[:, 15] = np.bincount((lines >> np.uint64(48)).astype(np.int64), minlength=docs) / np.maximum(np.bincount(at, minlength=docs), 1)
    for col, lexicon in ((16, toxic), (18, poor)):
        hit = _member(h, lexicon)
        x[:, col] = np.bincount(doc[hit], minlength=docs)
        x[:, col + 1] = x[:, col] * each
    return x


@dataclass
class Forest:
    """Complete binary trees of one depth: (trees, inner nodes) features and thresholds, (trees, leaves) values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        flat = x.ravel()
        row = np.arange(len(x)) * x.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (flat[row + feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Gradient-boosted trees for labels 0 and 1; a constant where only one label occurs."""
    rows, cols = x.shape
    p = float(np.clip(y.mean() if rows else 0.5, 1e-4, 1 - 1e-4))
    inner, leaves = (1 << depth) - 1, 1 << depth
    out = Forest(float(np.log(p / (1 - p))), np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    if rows == 0 or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins).astype(np.float32)) for j in range(cols)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(cols)], axis=1)  # x > edge k  <=>  code > k
    total = np.full(rows, out.base)
    column = np.arange(cols) * bins
    feature, threshold, leaf = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-total))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            width = 1 << level
            local = node - (width - 1)
            slot = (local[:, None] * (cols * bins) + column + code).ravel()
            hist = [np.bincount(slot, weights=np.repeat(v, cols), minlength=width * cols * bins).reshape(width, cols, bins) for v in (g, h)]
            left = [np.cumsum(v, axis=2)[:, :, :-1] for v in hist]
            whole = [v.sum(axis=2)[:, :, None] for v in hist]
            right = [w - v for w, v in zip(whole, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + SMOOTH) + right[0] ** 2 / (right[1] + SMOOTH) - whole[0] ** 2 / (whole[1] + SMOOTH)
            gain[(left[1] < 1e-3) | (right[1] < 1e-3)] = 0
            for j in range(cols):
                gain[:, j, len(edges[j]) :] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            j, b = best // (bins - 1), best % (bins - 1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            for i in np.flatnonzero(good):
                f[width - 1 + i], t[width - 1 + i] = j[i], edges[j[i]][b[i]]
            node = 2 * node + 1 + (x[np.arange(rows), f[node]] > t[node])
        at = node - inner
        value = -rate * np.bincount(at, weights=g, minlength=leaves) / (np.bincount(at, weights=h, minlength=leaves) + SMOOTH)
        total += value[at]
        feature.append(f)
        threshold.append(t)
        leaf.append(value)
    return Forest(out.base, np.stack(feature), np.stack(threshold), np.stack(leaf))


@dataclass
class Model:
    toxic_words: np.ndarray
    poor_words: np.ndarray
    quality: Forest
    toxic: Forest

    def predict(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = statistics(offsets, data, self.toxic_words, self.poor_words)
        return self.quality.predict(x), self.toxic.predict(x)


def _word_labels(batches):
    """Of each piece: distinct words of its distinct texts, with the texts, toxic texts and poor texts that hold them."""
    for piece in pieces(batches):
        o, data = buffers(piece.column(1))
        quality, toxic = (piece.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        whole = span_hash(data, o[:-1], o[1:])
        once = np.zeros(piece.num_rows, bool)
        once[np.unique(whole, return_index=True)[1]] = True
        _, _, doc, h = words(o, data)
        keep = once[doc]
        key = np.unique(np.stack([h[keep], doc[keep].astype(np.uint64)]), axis=1) if keep.any() else np.zeros((2, 0), np.uint64)
        word, at = np.unique(key[0], return_inverse=True)
        d = key[1].astype(np.int64)
        n, t, p = (np.bincount(at, weights=w, minlength=len(word)) for w in (np.ones(len(d)), toxic[d] == 1, quality[d] == 0))
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *(pa.array(v.astype(np.int64)) for v in (n, t, p))], ["word", "n", "toxic", "poor"])


def _lexicon(counts: DataFrame, column: str, base: float) -> np.ndarray:
    """Hashes of the words that most surely go with a label: at least LEAST texts, most of them with it."""
    base = min(max(base, 1e-3), 0.999)
    z = (F.col(column) - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    rows = counts.where((F.col("n") >= LEAST) & (2 * F.col(column) > F.col("n"))).withColumn("z", z).where("z > 6")
    got = rows.orderBy(F.desc("z"), "word").limit(LEXICON).select("word").toArrow().column("word").to_numpy()
    return np.sort(got.view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` labelled rows, twice as many at most; a constant one where there are none."""
    lab = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    lab = lab.where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)")
    n = lab.count()
    # many labels of one doc_id share its hash: the limit holds whatever the table repeats
    lab = lab.withColumn("hash", F.xxhash64("doc_id", F.lit(23)))
    lab = lab.where(F.pmod("hash", F.lit(1 << 20)) / float(1 << 20) < min(1.0, sample / max(n, 1)))
    lab = cut(lab.orderBy("hash", "doc_id", "quality", "toxic").limit(2 * sample).drop("hash"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # the labels are bounded by the sample, so they may go to every task
    rows = cut(texts.join(F.broadcast(lab), "doc_id").select("doc_id", "text", "quality", "toxic"))
    counts = rows.mapInArrow(_word_labels, "word bigint, n bigint, toxic bigint, poor bigint")
    counts = counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "poor")]).where(F.col("n") >= LEAST)
    counts = cut(counts)
    base = lab.agg(F.avg("toxic"), F.avg(1 - F.col("quality"))).first()
    toxic_words, poor_words = (_lexicon(counts, c, b or 0.0) for c, b in zip(("toxic", "poor"), base, strict=True))

    def run(batches):
        for piece in pieces(batches):
            x = statistics(*buffers(piece.column(1)), toxic_words, poor_words)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), piece.column(3), flat], ["doc_id", "quality", "toxic", "x"])

    got = rows.mapInArrow(run, "doc_id bigint, quality int, toxic int, x array<float>")
    # an id with a label may name very many rows; the fit reads a bounded number of them too
    got = got.orderBy(F.xxhash64("doc_id", "x"), "quality", "toxic").limit(2 * sample).toArrow().sort_by("doc_id")
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)) if got.num_rows else np.zeros((0, len(NAMES)), np.float32)
    return Model(toxic_words, poor_words, *(boost(x, got.column(c).to_numpy().astype(float)) for c in ("quality", "toxic")))


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, quality, toxic, keep) of every row: the probability of good quality, that of toxicity, and
    whether the first is at least and the second under one half.

    A null text counts as an empty one.  Rows are neither merged nor dropped: repeated rows and null
    doc_ids keep a row each.  Labels that are null or neither 0 nor 1, and those without a document,
    are passed over; a document with several labels counts with each.  Without labels the
    probabilities are one half, at which a document is kept (quality is at least one half) only if toxicity
    is under it.  Texts of any length are read whole; an empty table gives no rows.  Columns other than these
    are not read.
    """
    model = model or fit(docs, labels)

    def run(batches):
        for piece in pieces(batches):
            q, t = model.predict(*buffers(piece.column(1)))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(q), pa.array(t), pa.array((q >= 0.5) & (t < 0.5))], ["doc_id", "quality", "toxic", "keep"]
            )

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id bigint, quality double, toxic double, keep boolean")
