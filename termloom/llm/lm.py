"""Language-model scores by pseudo-likelihood.

A window network predicts every word from ``REACH`` words on both sides: position-wise embeddings are
summed, passed through tanh, and a two-level softmax gives the cluster of the word and the symbol within
its cluster.  A document's score is the sum over its words of log p(word | both sides).

Everything the model knows is gathered from the whole corpus.  All words of all documents are counted;
the most frequent are symbols of their own and all others share hashed ones, and the counts set the
output biases, so the network starts as the corpus' unigram model.  A word's share of its symbol is its
count's, for the ``LISTED`` most frequent words; what those leave of a symbol its other words have in equal
parts.  So the probabilities of all words that occur add up to 1.

Training takes ``ROUNDS`` passes over the symbols, which are written once, and every word of every document
is the target of one of them.  In a pass each task trains a replica on its documents by stochastic gradient
descent; the replicas are averaged, weighted by the words each saw, and the next pass starts from the average.

The network is the prior of a count over the whole corpus, which grows with it: of the n other places where
the same two words stand on either side, c hold this word, and p = (c + BELIEF * network) / (n + BELIEF).
No place counts for itself.  The words travel to their context's bucket, packed, and come back as sums for
each document.
"""

from __future__ import annotations

import math
import posixpath
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm._state import cut, remove, shared_folder
from termloom.llm._text import buffers, mix, pieces, words

REACH, DIM, CLUSTERS, SIZE = 2, 32, 32, 32
assert CLUSTERS == SIZE  # both softmaxes are rows of one array
SYMBOLS, SHARED = CLUSTERS * SIZE, 256
ROUNDS, RATE, BATCH = 4, 0.1, 4096
_SLOTS = [o for o in range(-REACH, REACH + 1) if o]
_SHAPES = {
    "emb": (len(_SLOTS), SYMBOLS + 1, DIM), "hid": (DIM,), "wc": (DIM, CLUSTERS), "bc": (CLUSTERS,), "ww": (CLUSTERS, DIM, SIZE), "bw": (CLUSTERS, SIZE),
}
#: Words whose own counts every task knows, at most.
LISTED = 1 << 18
#: Weight of the network's probability against the counted places.
BELIEF = 1.0
#: A network's log-probabilities are kept in steps of 1 / STEPS, down to -65535 / STEPS.
STEPS = 2048
#: Words that travel together, and documents; words of a bucket on average; words from which a bucket is overfull.
FLUSH, FLUSH_DOCS, BUCKET, OVERFULL = 1 << 20, 50_000, 1 << 20, 1 << 23
#: Numbers of the parameter vector in a row, and replicas that are averaged at once.
CHUNK, FAN = 8192, 256
_CELLS = np.arange((SYMBOLS + 1) * DIM).reshape(SYMBOLS + 1, DIM)
_kept: dict[str, np.ndarray] = {}


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Parameters of the unigram model of the symbols' counts."""
    flat = np.zeros(sum(int(np.prod(s)) for s in _SHAPES.values()), np.float32)
    p = unpack(flat)
    rng = np.random.default_rng(seed)
    p["emb"][:] = rng.normal(size=p["emb"].shape) * 0.1
    p["wc"][:] = rng.normal(size=p["wc"].shape) * 0.1
    p["ww"][:] = rng.normal(size=p["ww"].shape) * 0.1
    c = counts.reshape(CLUSTERS, SIZE) + 0.5
    p["bc"][:] = np.log(c.sum(axis=1) / c.sum())
    p["bw"][:] = np.log(c / c.sum(axis=1, keepdims=True))
    return flat


def symbols(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Symbol of each word hash; ``known``: the frequent words' hashes in order of their symbols."""
    shared = SYMBOLS - SHARED + (mix(h, 9) % np.uint64(SHARED)).astype(np.int64)
    if not len(known):
        return shared
    bits = next((b for b in range(16, 23) if len(np.unique(known >> np.uint64(64 - b))) == len(known)), 0)
    if bits:  # a table of slots, each with one word
        slot = np.zeros(1 << bits, np.int16)
        slot[known >> np.uint64(64 - bits)] = np.arange(len(known))
        at = slot[h >> np.uint64(64 - bits)].astype(np.int64)
    else:
        order = np.argsort(known)
        at = order[np.minimum(np.searchsorted(known, h, sorter=order), len(known) - 1)]
    return np.where(known[at] == h, at, shared)


def contexts(sym: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(slots, words): the symbols around each word; SYMBOLS beyond its document."""
    out = np.full((len(_SLOTS), len(sym)), SYMBOLS, np.int16)  # short, so that sorting is by radix
    for i, o in enumerate(_SLOTS):
        a = abs(o)
        if a >= len(sym):
            continue
        here, there = (slice(a, None), slice(None, -a)) if o < 0 else (slice(None, -a), slice(a, None))
        out[i, here] = np.where(doc[here] == doc[there], sym[there], SYMBOLS)
    return out


def _buffer(name: str, rows: int, columns: int, kind=np.float32) -> np.ndarray:
    """Memory of this process that is used again and again: fresh pages cost more than what is computed in them."""
    have = _kept.get(name)
    if have is None or len(have) < rows:
        have = _kept[name] = np.empty((rows, columns), kind)
    return have[:rows]


def _hidden(p, ctx):
    h, more = (_buffer(name, ctx.shape[1], DIM) for name in ("hidden", "slot"))
    for i in range(len(ctx)):
        p["emb"][i].take(ctx[i], axis=0, out=more if i else h, mode="clip")  # any other mode copies
        h += more if i else p["hid"]
    return np.tanh(h, out=h)


def _weights(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster the weights of all clusters and, beside them, of its own symbols; and the biases."""
    w, b = _buffer("weights", CLUSTERS * DIM, CLUSTERS + SIZE).reshape(CLUSTERS, DIM, -1), _buffer("biases", CLUSTERS, CLUSTERS + SIZE)
    w[:, :, :CLUSTERS], w[:, :, CLUSTERS:] = p["wc"], p["ww"]
    b[:, :CLUSTERS], b[:, CLUSTERS:] = p["bc"], p["bw"]
    return w, b


def _by_cluster(y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """(order by cluster, the clusters that occur and where they are in it)."""
    cluster = (y // SIZE).astype(np.int16)
    order = np.argsort(cluster, kind="stable")
    edge = np.searchsorted(cluster[order], np.arange(CLUSTERS + 1)).tolist()
    return order, [(c, slice(edge[c], edge[c + 1])) for c in range(CLUSTERS) if edge[c] < edge[c + 1]]


def _scores(h: np.ndarray, w: np.ndarray, b: np.ndarray, live: list) -> np.ndarray:
    """(words, CLUSTERS + SIZE): of each cluster, and of each symbol of the word's own; words by cluster."""
    x = _buffer("scores", len(h), CLUSTERS + SIZE)
    for c, s in live:
        np.matmul(h[s], w[c], out=x[s])
        x[s] += b[c]
    return x


def _mine(y: np.ndarray) -> np.ndarray:
    """Where the scores of each word's cluster and symbol are in the flat scores."""
    at = np.empty((len(y), 2), np.int64)
    at[:, 0], at[:, 1] = y // SIZE, CLUSTERS + y % SIZE
    at += np.arange(0, len(y) * (CLUSTERS + SIZE), CLUSTERS + SIZE)[:, None]
    return at


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | np.float32]:
    """(sum of exp along each row, what was subtracted first); x becomes exp of what is left."""
    top = x.max()
    if not top - x.min() < 60:  # one for all rows would leave some of them nothing
        top = x.max(axis=1, keepdims=True)
    x -= top
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], np.float32), np.ravel(top)


def log_probs(p: dict, ctx: np.ndarray, sym: np.ndarray, block: int = 4096) -> np.ndarray:
    """log p(word | both sides) of each word."""
    out = np.empty(len(sym), np.float32)
    w, b = _weights(p)
    for at in range(0, len(sym), block):
        order, live = _by_cluster(sym[at : at + block])
        y = sym[at : at + block][order]
        x = _scores(_hidden(p, ctx[:, at : at + block].take(order, axis=1)), w, b, live)
        mine = x.ravel().take(_mine(y))
        total, top = _exp(x.reshape(-1, SIZE))
        out[at + order] = (mine - (np.log(total) + top).reshape(-1, 2)).sum(axis=1)
    return out


def _add_rows(table: np.ndarray, rows: np.ndarray, change: np.ndarray) -> None:
    """Adds to each row of the table its summed changes over the square root of their number."""
    at = _CELLS.take(rows, axis=0, out=_buffer("cells", len(rows), table.shape[1], np.int64), mode="clip")
    sums = np.bincount(at.ravel(), weights=change.ravel(), minlength=table.size).reshape(table.shape)
    sums /= np.sqrt(np.maximum(np.bincount(rows, minlength=len(table)), 1))[:, None]
    table += sums


def step(p: dict, ctx: np.ndarray, y: np.ndarray, rate: float) -> None:
    """One step of stochastic gradient descent on the words y in their contexts.

    A parameter's step is its summed gradient over the square root of the number of words that bear on
    it, so rare rows learn and frequent ones don't overshoot.
    """
    n = len(y)
    order, live = _by_cluster(y)
    ctx, y = ctx.take(order, axis=1), y[order]
    w, b = _weights(p)
    h = _hidden(p, ctx)
    g = _scores(h, w, b, live)
    rows = g.reshape(-1, SIZE)
    rows *= 1 / _exp(rows)[0][:, None]
    g.ravel()[_mine(y)] -= 1
    back, ones = _buffer("back", n, DIM), np.ones(n, np.float32)
    dw, db = _buffer("dw", CLUSTERS * DIM, CLUSTERS + SIZE).reshape(w.shape), _buffer("db", CLUSTERS, CLUSTERS + SIZE)
    many = np.array([s.stop - s.start for _, s in live])
    for i, (c, s) in enumerate(live):
        np.matmul(g[s], w[c].T, out=back[s])
        np.matmul(h[s].T, g[s], out=dw[i])
        np.matmul(ones[s], g[s], out=db[i])
    dw, db, own = dw[: len(live)], db[: len(live)], (rate / np.sqrt(many)).astype(np.float32)
    scale, live = np.float32(rate / math.sqrt(n)), [c for c, _ in live]
    p["ww"][live] -= own[:, None, None] * dw[:, :, CLUSTERS:]
    p["bw"][live] -= np.float32(0.1) * own[:, None] * db[:, CLUSTERS:]
    p["wc"] -= scale * dw[:, :, :CLUSTERS].sum(axis=0)
    p["bc"] -= np.float32(0.1) * scale * db[:, :CLUSTERS].sum(axis=0)
    h *= h
    np.subtract(1, h, out=h)
    back *= h
    back *= np.float32(-rate)
    p["hid"] += (ones @ back) / np.float32(math.sqrt(n))
    change = _buffer("change", n, DIM, np.float64)
    change[:] = back
    for i in range(len(ctx)):
        _add_rows(p["emb"][i], ctx[i], change)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _count(batches):
    """Counts of the word hashes, merged over the task's pieces up to a bound."""
    key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held, size = [], 0

    def merge():
        nonlocal key, n, held, size
        more, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        at = np.searchsorted(key, more)
        there = at < len(key)
        there[there] = key[at[there]] == more[there]
        n[at[there]] += c[there]
        key, n = (np.insert(x, at[~there], y[~there]) for x, y in ((key, more), (n, c)))
        held, size = [], 0

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["word", "n"])

    for piece in pieces(batches):
        held.append(words(*buffers(piece.column(1)))[3])
        size += len(held[-1])
        if size > 1 << 19:
            merge()
            if len(key) > 1 << 20:
                yield rows()
                key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    merge()
    yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs, by its hash."""
    return cut(_texts(docs).mapInArrow(_count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))


class Vocabulary:
    """Symbols of words, how often each symbol occurs, and a word's share of its symbol."""

    def __init__(self, word: np.ndarray, n: np.ndarray):
        """The listed words and their counts; ``add`` gives the counts of all words, part by part."""
        order = np.lexsort((word.view(np.int64), -n))[: SYMBOLS - SHARED]
        self.known = word[order]
        order = np.argsort(word)
        self.listed, self.n = word[order], n[order]
        self.slot = np.zeros(1 << 20, np.int32)
        self.slot[self.listed >> np.uint64(44)] = np.arange(len(order))
        self.counts, self.rest, self.kinds = (np.zeros(SYMBOLS, np.int64) for _ in range(3))

    def among(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the list, whether it is there) of each word."""
        if not len(self.listed):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = self.slot[h >> np.uint64(44)]
        there = self.listed[at] == h
        rest = np.flatnonzero(~there)  # another word has the slot, or none
        at[rest] = np.minimum(np.searchsorted(self.listed, h[rest]), len(self.listed) - 1)
        there[rest] = self.listed[at[rest]] == h[rest]
        return at, there

    def share(self, h: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """log of each word's share of its symbol."""
        out = np.zeros(len(h), np.float32)
        own = np.flatnonzero(sym >= SYMBOLS - SHARED)
        s = sym[own]
        at, there = self.among(h[own])
        n = np.where(there, self.n[at] if len(self.n) else 1, self.rest[s] / np.maximum(self.kinds[s], 1))
        out[own] = np.log(np.maximum(n, 1e-9) / np.maximum(self.counts[s], 1))
        return out


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """From all words of all documents.  The list ends where a step of 1/32 of an octave of counts would overfill it."""
    counts = word_counts(docs) if counts is None else counts
    level = F.floor(F.log2("n") * 32).cast("int")
    steps, room, least = counts.groupBy(level.alias("level")).count().collect(), LISTED, None
    for r in sorted(steps, key=lambda r: -r["level"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    top = counts.where(level >= least if least is not None else F.lit(False)).select("word", "n").toArrow()
    v = Vocabulary(top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy())

    def fold(batches):
        total = np.zeros((3, SYMBOLS))
        for b in batches:
            h, n = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            sym = symbols(h, v.known)
            rest = ~v.among(h)[1]
            for i, (at, weight) in enumerate(((sym, n), (sym[rest], n[rest]), (sym[rest], np.ones(rest.sum())))):
                total[i] += np.bincount(at, weights=weight, minlength=SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SYMBOLS)), *(pa.array(x.astype(np.int64)) for x in total)], ["sym", "n", "rest", "kinds"])

    per = counts.mapInArrow(fold, "sym bigint, n bigint, rest bigint, kinds bigint").groupBy("sym")
    per = per.agg(*[F.sum(c).alias(c) for c in ("n", "rest", "kinds")]).toArrow()
    for name, to in (("n", v.counts), ("rest", v.rest), ("kinds", v.kinds)):
        to[per.column("sym").to_numpy()] = per.column(name).to_numpy()
    return v


def symbol_table(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(sym, at) for each piece of text: its words' symbols (16 bits each) and where its documents begin in them (32 bits)."""

    def run(batches):
        for piece in pieces(batches):
            _, _, doc, h = words(*buffers(piece.column(1)))
            if len(h):
                head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([symbols(h, known).astype(np.int16).tobytes()]), pa.array([head.tobytes()])], ["sym", "at"])

    return _texts(docs).mapInArrow(run, "sym binary, at binary")


def turns(sym: np.ndarray, head: np.ndarray, rounds: int) -> np.ndarray:
    """The round in which each word is a target: by a hash of its symbol, its place and its document's symbols."""
    size = np.diff(np.append(head, len(sym)))
    place = (np.arange(len(sym)) - np.repeat(head, size)).astype(np.uint64)
    h = mix(sym.astype(np.uint64), 8)
    draw = mix(h + place * np.uint64(0x9E3779B97F4A7C15) + np.repeat(mix(np.add.reduceat(h, head), 8), size), 4)
    return ((draw >> np.uint64(40)) * np.uint64(rounds) >> np.uint64(24)).astype(np.int64)


def learn(p: dict, batches, turn: int, rounds: int, rate: float = RATE, before: float = 0) -> int:
    """Steps on the round's words of a symbol table, after ``before`` words of earlier rounds; the number of its words."""
    seen = 0
    for batch in batches:
        for raw, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sym, head = np.frombuffer(raw, np.int16).astype(np.int64), np.frombuffer(at, np.int32)
            ctx = contexts(sym, np.repeat(np.arange(len(head)), np.diff(np.append(head, len(sym)))))
            rows = np.flatnonzero(turns(sym, head, rounds) == turn)
            rows = rows[np.argsort(mix(rows.astype(np.uint64), 2))]  # neighbours apart
            for i in range(0, len(rows), BATCH):
                r = rows[i : i + BATCH]
                step(p, ctx.take(r, axis=1), sym[r], rate / (1 + ((before + seen) / 400_000)) ** 0.5)
                seen += len(r)
    return seen


def train(docs: DataFrame, known: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """Average of the tasks' replicas after the last round; the unigram model where there are no words."""
    spark = docs.sparkSession
    path = posixpath.join(shared_folder(spark), f"symbols-{uuid.uuid4().hex}")
    symbol_table(docs, known).write.parquet(path)
    table = spark.read.schema("sym binary, at binary").parquet(path)
    flat, before = start(counts), 0.0
    for turn in range(rounds):
        flat, seen = _round(table, flat, turn, rounds, rate, before)
        before += seen
    remove(spark, path)
    return flat


def _round(table: DataFrame, flat: np.ndarray, turn: int, rounds: int, rate: float, before: float) -> tuple[np.ndarray, float]:
    """(average of the replicas that start from flat, words that a replica saw on average)."""
    size = len(flat)

    def replica(batches):
        from pyspark import TaskContext

        mine = flat.copy()
        seen = learn(unpack(mine), batches, turn, rounds, rate, before)
        if seen:
            part = TaskContext.get().partitionId()
            for c in range(-(-size // CHUNK)):
                value = mine[c * CHUNK : (c + 1) * CHUNK].astype(np.float64) * seen
                row = [pa.array([c], pa.int32()), pa.array([part // FAN], pa.int32()), pa.array([1.0]), pa.array([float(seen)]), pa.array([value])]
                yield pa.RecordBatch.from_arrays(row, ["chunk", "fan", "many", "seen", "sums"])

    def total(t: pa.Table) -> pa.Table:
        v = t.column("sums").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        many, seen = ([float(np.sum(t.column(c).to_numpy()))] for c in ("many", "seen"))
        return pa.table({"chunk": t.column("chunk")[:1], "fan": t.column("fan")[:1], "many": many, "seen": seen, "sums": [v.sum(axis=0)]})

    schema = "chunk int, fan int, many double, seen double, sums array<double>"
    sums = table.mapInArrow(replica, schema).groupBy("chunk", "fan").applyInArrow(total, schema)
    got = sums.groupBy("chunk").applyInArrow(total, schema).orderBy("chunk").toArrow()
    if got.num_rows:
        seen, many = got.column("seen").to_numpy(), got.column("many").to_numpy()
        return np.concatenate([np.asarray(v.values.to_numpy()) / s for v, s in zip(got.column("sums"), seen, strict=True)]).astype(np.float32), seen[0] / many[0]
    return flat, 0.0


# ---- what the words' contexts hold elsewhere ----

_PACKED = "bucket bigint, flush bigint, ids array<bigint>, n array<bigint>, log_prob array<double>, packed binary, raw boolean"
_ENTRY = np.dtype([("key", "<u8"), ("lp", "<u2"), ("doc", "<u2")])
_SUM = np.dtype([("doc", "<u2"), ("sum", "<f4")])


def places(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the words on either side, 40 bits of it and 24 of the word) of each word."""
    left, right = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    if len(h) > 1:
        near = doc[1:] == doc[:-1]
        left[1:] = np.where(near, h[:-1], 0)
        right[:-1] = np.where(near, h[1:], 0)
    ctx = mix(mix(left, 11) + right * np.uint64(0x9E3779B97F4A7C15))
    return ctx, (ctx & np.uint64((1 << 40) - 1)) << np.uint64(24) | mix(h, 12) >> np.uint64(40)


def _row(bucket: int, flush: int, ids=None, n=None, log_prob=None, packed=None, raw: bool = False) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(), pa.bool_()]
    row = (bucket, flush, ids, n, log_prob, packed, raw)
    arrays = [
        pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) if isinstance(v, pa.Array) else pa.array([v], k) for v, k in zip(row, kinds, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "flush", "ids", "n", "log_prob", "packed", "raw"])


def _emit(flat: np.ndarray, v: Vocabulary, buckets: int):
    """For each flush a row of its documents with the network's sums, and a packed row of words for each bucket."""

    def run(batches):
        from pyspark import TaskContext

        p, flush = unpack(flat), TaskContext.get().partitionId() << 33
        held, count, docs = [], 0, 0

        def send():
            ids = pa.concat_arrays([x[0] for x in held])
            n, total = (np.concatenate([x[i] for x in held]) for i in (1, 2))
            yield _row(buckets + flush % buckets, flush, ids, pa.array(n), pa.array(total))
            to, entry = (np.concatenate([x[i] for x in held]) for i in (3, 4))
            order = np.argsort(to, kind="stable")
            edge = np.searchsorted(to[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edge)):
                yield _row(int(b), flush, packed=entry[order[edge[b] : edge[b + 1]]].tobytes())

        for piece in pieces(batches):
            _, _, doc, h = words(*buffers(piece.column(1)))
            m = piece.num_rows
            if held and (count + len(h) > FLUSH or docs + m > FLUSH_DOCS):
                yield from send()
                held, count, docs, flush = [], 0, 0, flush + 1
            sym = symbols(h, v.known)
            lp = np.clip(np.round((log_probs(p, contexts(sym, doc), sym) + v.share(h, sym)) * -STEPS), 0, 65535).astype(np.uint16)
            ctx, key = places(h, doc)
            entry = np.empty(len(h), _ENTRY)
            entry["key"], entry["lp"], entry["doc"] = key, lp, doc + docs
            to = ((ctx >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32 if buckets > 1 << 15 else np.int16)
            total = np.bincount(doc, weights=lp, minlength=m) / -STEPS if len(doc) else np.zeros(m)
            held.append((piece.column(0), np.bincount(doc, minlength=m), total, to, entry))
            count, docs = count + len(h), docs + m
        if held:
            yield from send()

    return run


def _gain(c, n, p):
    """What the counts add to log p: c of n other places hold the word."""
    return np.log((c + BELIEF * p) / ((n + BELIEF) * p))


def _resolve(overfull: int):
    """Documents' rows as they are, and for each flush its documents' sums over a bucket; overfull buckets as they came."""

    def sums(bucket, held):
        if not held:
            return
        entry = np.frombuffer(b"".join(raw for _, raw in held), _ENTRY)
        which = np.repeat(np.arange(len(held)), [len(raw) // _ENTRY.itemsize for _, raw in held])
        key = np.ascontiguousarray(entry["key"])
        order = np.argsort(key)
        key = key[order]
        ctx = key >> np.uint64(24)
        same = ctx[1:] == ctx[:-1]
        some = np.append(False, same) | np.append(same, False)  # the contexts that occur elsewhere too
        order, key, ctx = order[some], key[some], ctx[some]
        if not len(order):
            return
        n, c = (_run_lengths(x) - 1 for x in (ctx, key))
        gain = _gain(c, n, np.exp(entry["lp"][order] / -STEPS))
        at, to = np.unique(which[order] << 16 | entry["doc"][order], return_inverse=True)
        out = np.empty(len(at), _SUM)
        out["doc"], out["sum"] = at & 0xFFFF, np.bincount(to, weights=gain)
        edge = np.searchsorted(at >> 16, np.arange(len(held) + 1))
        for i in np.flatnonzero(np.diff(edge)):
            yield _row(bucket, held[i][0], packed=out[edge[i] : edge[i + 1]].tobytes())

    def run(batches):
        bucket, held, size = -1, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                at, flush, packed = (batch.column(c)[i].as_py() for c in (0, 1, 5))
                if packed is None:
                    yield batch.slice(i, 1)
                    continue
                if at != bucket:
                    yield from sums(bucket, held)
                    bucket, held, size = at, [], 0
                held.append((flush, packed))
                size += len(packed) // _ENTRY.itemsize
                if size > overfull:  # from here on what comes of this bucket passes through
                    for f, x in held:
                        yield _row(bucket, f, packed=x, raw=True)
                    held = []
        yield from sums(bucket, held)

    return run


def _run_lengths(x: np.ndarray) -> np.ndarray:
    """Of each element of a sorted array, how many are equal to it."""
    head = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    size = np.diff(np.append(head, len(x)))
    return np.repeat(size, size)


def _apart(raw: DataFrame) -> DataFrame:
    """The same sums for the words of overfull buckets, by counts with partial sums and joins that Spark may split."""

    def rows(batches):
        for batch in batches:
            for flush, bucket, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                e = np.frombuffer(packed, _ENTRY)
                key, p = np.ascontiguousarray(e["key"]), np.exp(e["lp"] / -STEPS)
                cols = [np.full(len(e), bucket), key.view(np.int64), (key >> np.uint64(24)).view(np.int64), np.full(len(e), flush), e["doc"].astype(np.int32), p]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["bucket", "key", "ctx", "flush", "doc", "p"])

    def pack(batches):
        for b in batches:
            out = np.empty(b.num_rows, _SUM)
            out["doc"], out["sum"] = b.column(1).to_numpy(), b.column(2).to_numpy()
            for flush, x in zip(b.column(0).to_pylist(), out, strict=True):
                yield _row(-1, flush, packed=x.tobytes())

    each = raw.select("flush", "bucket", "packed").mapInArrow(rows, "bucket bigint, key bigint, ctx bigint, flush bigint, doc int, p double")
    c = each.groupBy("bucket", "ctx", "key").agg(F.count("*").alias("c"))
    n = c.groupBy("bucket", "ctx").agg(F.sum("c").alias("n"))
    gain = F.log((F.col("c") - 1 + BELIEF * F.col("p")) / ((F.col("n") - 1 + BELIEF) * F.col("p")))
    sums = each.join(c.join(n, ["bucket", "ctx"]).select("bucket", "key", "c", "n"), ["bucket", "key"]).groupBy("flush", "doc").agg(F.sum(gain).alias("gain"))
    return sums.mapInArrow(pack, _PACKED)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_prob, per_word, network_log_prob) of every row.

    ``log_prob`` is the sum over the words of log p(word | both sides), from the network and from the other
    places of the word's context in the corpus; ``per_word`` is its mean.  ``network_log_prob`` leaves those
    places out.  A word's own place never counts for it, but another row with the same text does.

    A text without words, an empty or a null one has no words, sums 0 and a null mean.  Texts of any length
    are read whole; ties between equally frequent words go by their hashes.  Rows are neither merged nor
    dropped: repeated rows and null doc_ids keep a row each (and count each time).  An empty table gives
    no rows; columns other than doc_id and text are not read.
    """
    v = vocabulary(docs)
    flat = train(docs, v.known, v.counts)
    buckets = max(1, math.ceil(int(v.counts.sum()) / BUCKET))
    sent = _texts(docs).mapInArrow(_emit(flat, v, buckets), _PACKED)
    rows = cut(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_resolve(OVERFULL), _PACKED))
    raw = rows.where("raw")
    parts = rows.where("NOT raw")
    if not raw.isEmpty():
        parts = parts.unionByName(_apart(raw))

    def total(t: pa.Table) -> pa.Table:
        base = t.filter(t.column("ids").is_valid())
        ids, n, network = (base.column(c).combine_chunks().flatten() for c in ("ids", "n", "log_prob"))
        n, network = n.to_numpy(), network.to_numpy()
        sums = np.frombuffer(b"".join(x for x in t.column("packed").to_pylist() if x is not None), _SUM)
        full = network + np.bincount(sums["doc"], weights=sums["sum"], minlength=len(n))
        mean = pa.array(full / np.maximum(n, 1), mask=n == 0)
        return pa.table({"doc_id": ids, "n_words": n, "log_prob": full, "per_word": mean, "network_log_prob": network})

    return parts.groupBy("flush").applyInArrow(total, "doc_id bigint, n_words bigint, log_prob double, per_word double, network_log_prob double")
