"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed byte 3- and 4-grams (lower case, every run of
other bytes than letters being a blank), over the whole text.  Embeddings and softmax are trained by
stochastic gradient descent in numpy on labelled texts.  A temperature fitted on held-out texts
calibrates the probabilities, and the threshold below which a text is rejected is a low quantile of
the held-out texts' confidence.

The fit reads a bounded sample of labelled rows (``SAMPLE`` a language, drawn by a hash of doc_id);
every text of the table is then classified.  Since the model is linear, embedding and softmax fold
into one table of class scores for each bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm._text import buffers, pieces

BUCKETS, DIM = 1 << 16, 16
#: Labelled rows for each language that the fit may read, at most; a fifth of them are held out.
SAMPLE = 600
EPOCHS, BATCH, RATE, EMBED = 6, 16, 0.5, 0.5
#: Share of held-out texts whose confidence may fall under the threshold.
REJECT = 0.002

_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[65:91] += 32
_BLANK[[c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122)]] = 32


def subwords(offsets: np.ndarray, data: np.ndarray):
    """(bucket, doc) of each subword, the 3-grams before the 4-grams; letters: letter bytes of each doc."""
    n = len(data)
    docs = len(offsets) - 1
    flat = np.full(n + 8, 32, np.uint8)
    flat[:n] = _BLANK[data]
    word = np.ndarray((n,), "<u8", flat.tobytes(), strides=(1,))
    letters = np.zeros(n + 1, np.int64)
    np.cumsum(flat[:n] != 32, out=letters[1:])
    letters = letters[offsets[1:]] - letters[offsets[:-1]]
    # n-grams of blanks say nothing, and one that reaches into the next text is not one of this text
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    out = []
    for size in (3, 4):
        at = np.flatnonzero((left >= size) & (flat[:n] != 32) | (left >= size) & (flat[1 : n + 1] != 32))
        gram = (word[at] & np.uint64((1 << 8 * size) - 1)) + np.uint64(size << 40)
        out.append((((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64), doc[at]))
    return out, letters


def _sums(offsets: np.ndarray, data: np.ndarray, table: np.ndarray):
    """Mean of the table's rows over each doc's subwords; number of subwords; letters."""
    docs = len(offsets) - 1
    total = np.zeros((docs, table.shape[1]))
    n = np.zeros(docs, np.int64)
    grams, letters = subwords(offsets, data)
    for bucket, doc in grams:
        if len(doc):
            count = np.bincount(doc, minlength=docs)
            some = np.flatnonzero(count)
            total[some] += np.add.reduceat(table[bucket], (np.cumsum(count) - count)[some], axis=0, dtype=np.float64)
            n += count
    return total / np.maximum(n, 1)[:, None], n, letters


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray  # (BUCKETS, labels): embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, offsets: np.ndarray, data: np.ndarray):
        """(label index, confidence, rejected) of each text."""
        mean, n, letters = _sums(offsets, data, self.scores)
        p = softmax((mean + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        conf = p[np.arange(len(p)), best]
        return best, conf, (letters == 0) | (n == 0) | (conf < self.threshold)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """A model of the labels in ``langs``; a single label gives a model that knows only that one."""
    labels = sorted(set(langs))
    y = np.array([labels.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    # one entry for each text and bucket, with its share of the text; a piece of the texts at a time
    docs, buckets, shares, base = [], [], [], 0
    for piece in pieces(iter(pa.table({"text": pa.array(texts, pa.string())}).to_batches())):
        grams, _ = subwords(*buffers(piece.column(0)))
        key, count = np.unique(np.concatenate([doc * BUCKETS + bucket for bucket, doc in grams]), return_counts=True)
        doc = key // BUCKETS
        docs.append((doc + base).astype(np.int32))
        buckets.append((key % BUCKETS).astype(np.int32))
        shares.append((count / np.bincount(doc, weights=count)[doc]).astype(np.float32) if len(key) else np.zeros(0, np.float32))
        base += piece.num_rows
    doc, bucket, share = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (docs, buckets, shares))
    begin = np.searchsorted(doc, np.arange(len(y) + 1))
    # steps are normalised by a text's own weight, so that a text of few subwords moves them no further than a long one
    weight = np.bincount(doc, weights=share.astype(np.float64) ** 2, minlength=len(y)).astype(np.float64)
    step_share = (share / weight[doc]).astype(np.float32)
    emb = (rng.normal(size=(BUCKETS, DIM)) / DIM).astype(np.float32)
    w = np.zeros((DIM, len(labels)), np.float32)
    b = np.zeros(len(labels), np.float32)
    index = np.flatnonzero(~held)
    steps, step = EPOCHS * -(-len(index) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(index)
        for at in range(0, len(index), BATCH):
            ids = index[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            rows = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in ids])
            if not len(rows):
                continue
            owner = np.repeat(np.arange(len(ids)), begin[ids + 1] - begin[ids])
            x = np.zeros((len(ids), DIM), np.float32)
            np.add.at(x, owner, emb[bucket[rows]] * share[rows, None])
            g = softmax(x @ w + b)
            g[np.arange(len(ids)), y[ids]] -= 1
            back = g @ w.T
            size = np.maximum(1, (x * x).sum(axis=1, keepdims=True))
            w -= rate * 4 * (x / size).T @ g
            b -= rate * 0.1 * g.mean(axis=0)
            np.subtract.at(emb, bucket[rows], rate * EMBED * step_share[rows, None] * back[owner])
    model = Model(labels, emb @ w, b, 1.0, 0.0)
    hold = np.flatnonzero(held) if held.any() else np.arange(len(y))
    if len(hold):
        parts = [_sums(*buffers(p.column(0)), model.scores) for p in pieces(iter(pa.table({"text": pa.array([texts[i] for i in hold], pa.string())}).to_batches()))]
        mean, letters = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        logits, right = mean + b, y[hold]
        # as if one text more had been wrong: where none is, certainty grows with their number and no further
        wrong = 1 / (len(hold) + 2)
        nll = {}
        for t in np.geomspace(0.05, 20, 60):
            logp = np.log(softmax(logits / t) + 1e-12)
            mine = logp[np.arange(len(hold)), right]
            nll[t] = -((1 - wrong) * mine + wrong / max(1, len(labels) - 1) * (logp.sum(axis=1) - mine)).mean()
        model.temperature = float(min(nll, key=nll.get))
        conf = softmax(logits / model.temperature).max(axis=1)[letters > 0]
        low = float(np.quantile(conf, REJECT)) if len(conf) else 0.0
        # never above the majority: what the model holds likelier than all else together is kept
        model.threshold = min(low, 0.5)
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of the languages in ``lang``, from about ``sample`` rows of each, twice as many at most; None without labelled rows.

    Rows are drawn by a hash of doc_id and text; where the draw takes none (a few rows only), the first by
    that hash serve.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    d = d.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    counts = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    d = d.withColumn("hash", F.xxhash64("id", "text", F.lit(11)))
    draw = F.pmod("hash", F.lit(1 << 20)) / float(1 << 20)
    # copies share a hash: the limit holds whatever the table repeats
    first = lambda rows: rows.orderBy("hash", "id", "lang", "text").limit(2 * sample * len(counts)).select("id", "lang", "text").toArrow()
    rows = first(d.where(draw < share[F.col("lang")]))
    if not rows.num_rows:
        rows = first(d)
    rows = rows.sort_by([("id", "ascending"), ("lang", "ascending")])
    return train(rows.column("text").to_pylist(), rows.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang, confidence, rejected) of every row.

    ``lang`` is the likeliest language, the first by name of those that tie, also where it is rejected; a
    text is rejected if its confidence is under the threshold, not if it is equal.  A null or empty text, and
    one without letters, is rejected with a null language and confidence 0.  Texts of any length are read
    whole.  Rows are neither merged nor dropped: repeated rows and null doc_ids keep a row each.  Without
    any labelled row there is no model: then no language is named, confidence is 0, and what has letters is
    not rejected.  An empty table gives no rows.  Columns other than doc_id, text and (for the fit) lang are
    not read.
    """
    model = model or fit(docs)
    names = pa.array(model.labels if model else [], pa.string())

    def run(batches):
        for piece in pieces(batches):
            o, data = buffers(piece.column(1))
            if model is None:
                best, conf, rejected = np.zeros(piece.num_rows, int), np.zeros(piece.num_rows), ~_letters(o, data)
                known = np.zeros(piece.num_rows, bool)
            else:
                best, conf, rejected = model.predict(o, data)
                known = _sums_known(o, data)
            lang = names.take(pa.array(best, mask=~known))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), lang, pa.array(np.where(known, conf, 0.0)), pa.array(rejected)], ["doc_id", "lang", "confidence", "rejected"]
            )

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id bigint, lang string, confidence double, rejected boolean")


def _letters(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_BLANK[data] != 32, out=seen[1:])
    return seen[offsets[1:]] > seen[offsets[:-1]]


def _sums_known(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether each text has a subword."""
    return _letters(offsets, data) & (np.diff(offsets) >= 3)


def drop_rejected(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that ``identify`` does not reject, with all their columns; text is read, not changed.

    Each row is decided by its own text, so rows that repeat stay or go together, whatever their doc_id.
    Null and empty texts go, and those without letters.  Without any labelled row only they go.  An empty
    table gives no rows.
    """
    model = model or fit(docs)
    text = docs.columns.index("text")

    def run(batches):
        for piece in pieces(batches):
            o, data = buffers(piece.column(text))
            rejected = ~_letters(o, data) if model is None else model.predict(o, data)[2]
            yield piece.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
