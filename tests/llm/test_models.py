"""Language ID, quality classifier and language model: held-out accuracy and plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.llm import langid, lm, quality
from termloom.llm._text import buffers, words


@pytest.fixture(scope="module")
def larger(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


# ---- language ID ----


def test_language_held_out(spark, larger):
    docs = larger[0].where("length(text) > 0")
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    model = langid.fit(docs.where(half == 0))
    rows = langid.identify(docs.where(half == 1).select("doc_id", "text"), model).join(docs.select("doc_id", F.col("lang").alias("want")), "doc_id").collect()
    right = [r["lang"] == r["want"] for r in rows]
    assert np.mean(right) > 0.95
    assert np.mean([r["rejected"] for r in rows]) < 0.03
    kept = langid.drop_rejected(docs, model)
    assert kept.schema == docs.schema and kept.count() > 0.95 * docs.count()


def test_language_of_nothing(spark, larger):
    model = langid.fit(larger[0])
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (3, "12 34 !?"), (None, "the and of that"), (4, "zq" * 50_000), (5, "x")]
    df = spark.createDataFrame([(*r, "conf", True) for r in rows], "doc_id bigint, text string, confidence string, rejected boolean")
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (1, 2, 3):
            assert r["rejected"] and r["lang"] is None and r["confidence"] == 0
    left = [r["doc_id"] for r in langid.drop_rejected(df, model).collect()]
    assert not {1, 2, 3} & set(left) and None in left
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert langid.identify(empty).count() == 0
    # without labels nothing is identified, and only what has no letters goes
    blank = spark.createDataFrame([(1, "text", None), (2, "12", None), (3, None, None), (1, "text", None)], "doc_id bigint, text string, lang string")
    assert sorted((r["doc_id"], r["lang"], r["confidence"], r["rejected"]) for r in langid.identify(blank).collect()) == [(1, None, 0, False)] * 2 + [(2, None, 0, True), (3, None, 0, True)]
    assert [r["doc_id"] for r in langid.drop_rejected(blank).collect()] == [1, 1]


def test_language_sample_is_bounded(spark, monkeypatch):
    """Copies share their draw, yet the fit reads a bounded number of them, and the same ones each time."""
    rows = spark.createDataFrame([(1, "the same text again and again", "en")] * 500 + [(2, "ein anderer Text", "de")], "doc_id bigint, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: seen.append((texts, langs)))
    for _ in range(2):
        langid.fit(rows.repartition(7), 5)
    assert seen[0] == seen[1] and 0 < len(seen[0][0]) <= 20


def test_scores_are_the_plain_mean():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    texts = ["Hello, wörld 12", "ab", "", "x y z abcd", "aaaa bbbb"]
    mean, n, _ = langid._sums(*buffers(pa.array(texts)), table)
    for i, t in enumerate(texts):
        b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in t.encode())
        grams = [b[j : j + s] for s in (3, 4) for j in range(len(b) - s + 1) if b[j : j + 2] != b"  "]
        rows = [((int.from_bytes(g, "little") + (len(g) << 40)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48 for g in grams]
        assert n[i] == len(rows)
        if rows:
            assert np.allclose(mean[i], table[rows].mean(axis=0), atol=1e-5)


# ---- quality ----


def test_quality_held_out(spark, larger):
    docs, labels = larger
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = quality.fit(docs, labels.where(half == 0))
    rows = quality.classify(docs, labels, model).join(labels.where(half == 1).withColumnsRenamed({"quality": "q", "toxic": "t"}), "doc_id").collect()
    good = np.mean([(r["quality"] >= 0.5) == r["q"] for r in rows])
    toxic = np.mean([(r["toxic"] >= 0.5) == r["t"] for r in rows])
    assert good > 0.85 and toxic > 0.95, (good, toxic)


def test_forest_is_its_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    forest = quality.boost(x, y, trees=12)
    got = forest.predict(x)
    for i in range(50):
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[i, f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-total)))
    assert np.mean((got > 0.5) == y) > 0.95


def test_quality_of_odd_rows(spark):
    docs = [(1, "a good text of words"), (1, "a good text of words"), (2, None), (3, ""), (None, "x"), (4, "b " * 100_000)]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id bigint, text string, quality int, toxic string")
    none = spark.createDataFrame([(1, None, 0), (9, 1, 0), (None, 1, 1), (2, 7, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(df, none).collect()
    assert len(got) == 6 and all(r["quality"] == pytest.approx(0.5) and r["toxic"] == pytest.approx(0.5) for r in got)
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.classify(df, some).count() == 6 and quality.classify(df.limit(0), some).count() == 0


# ---- language model ----


def test_probabilities_add_up():
    rng = np.random.default_rng(2)
    p = lm.unpack(lm.start(rng.integers(0, 50, lm.SYMBOLS)))
    ctx = rng.integers(0, lm.SYMBOLS + 1, (len(lm._SLOTS), 3))
    for w in range(3):
        every = lm.log_probs(p, np.repeat(ctx[:, w : w + 1], lm.SYMBOLS, axis=1), np.arange(lm.SYMBOLS))
        assert np.exp(every.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def _plain_step(p, ctx, y, rate):
    """The same step word by word; (parameters after it, log p of each word before it)."""
    old, p = p, {k: x.copy() for k, x in p.items()}
    often, n, said = np.bincount(y // lm.SIZE, minlength=lm.CLUSTERS), len(y), []
    for i, x in enumerate(y):
        c, inner = divmod(x, lm.SIZE)
        h = np.tanh(old["hid"] + sum(old["emb"][k][s] for k, s in enumerate(ctx[:, i])))
        a, b = h @ old["wc"] + old["bc"], h @ old["ww"][c] + old["bw"][c]
        a, b = np.exp(a - a.max()), np.exp(b - b.max())
        a, b = a / a.sum(), b / b.sum()
        said.append(np.log(a[c]) + np.log(b[inner]))
        a[c] -= 1
        b[inner] -= 1
        back = (old["wc"] @ a + old["ww"][c] @ b) * (1 - h * h) * rate
        p["wc"] -= rate / n**0.5 * np.outer(h, a)
        p["bc"] -= 0.1 * rate / n**0.5 * a
        p["ww"][c] -= rate / often[c] ** 0.5 * np.outer(h, b)
        p["bw"][c] -= 0.1 * rate / often[c] ** 0.5 * b
        p["hid"] -= back / n**0.5
        for k, s in enumerate(ctx[:, i]):
            p["emb"][k][s] -= back / (ctx[k] == s).sum() ** 0.5
    return p, np.array(said)


@pytest.mark.parametrize(("n", "wide"), [(700, 1), (1, 1), (300, 40)])
def test_steps_are_those_of_each_word(n, wide):
    """Also where scores are so far apart that rows need a maximum of their own."""
    rng = np.random.default_rng(n)
    flat = lm.start(rng.integers(0, 50, lm.SYMBOLS)) * np.float32(wide)
    y, ctx = rng.zipf(1.3, n) % lm.SYMBOLS, (rng.zipf(1.3, (len(lm._SLOTS), n)) % (lm.SYMBOLS + 1)).astype(np.int16)
    want, said = _plain_step(lm.unpack(flat.astype(np.float64)), ctx, y, 0.1)
    p = lm.unpack(flat)
    assert np.allclose(lm.log_probs(p, ctx, y, 256), said, rtol=1e-4, atol=1e-3)
    lm.step(p, ctx, y, 0.1)
    for name in want:
        assert np.allclose(p[name], want[name], rtol=1e-4, atol=1e-4), name


def test_steps_use_kept_memory():
    """Most of the time of a step had gone into new arrays of the batch's size."""
    import tracemalloc

    rng = np.random.default_rng(4)
    p = lm.unpack(lm.start(rng.integers(0, 50, lm.SYMBOLS)))
    y, ctx = rng.integers(0, lm.SYMBOLS, lm.BATCH), rng.integers(0, lm.SYMBOLS + 1, (len(lm._SLOTS), lm.BATCH)).astype(np.int16)
    for call in (lambda: lm.step(p, ctx, y, 0.1), lambda: lm.log_probs(p, ctx, y)):
        call()
        tracemalloc.start()
        call()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 2 * lm.BATCH * lm.DIM * 4


def test_counts_are_of_all_pieces(monkeypatch):
    """Merged once for many pieces, and the same as of each word."""
    texts = [f"one two w{i % 5000} W{i % 300} x{i}" for i in range(60_000)] + [None, "", "?!"]
    merges, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: (merges.append(1), unique(*a, **k))[1])
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    key, n = (np.concatenate(x) for x in zip(*((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in lm._count(iter([batch]))), strict=True))
    assert len(merges) < 3
    h, c = unique(_words(list(enumerate(texts)))[1], return_counts=True)
    assert dict(zip(key.view(np.uint64).tolist(), n.tolist(), strict=True)) == dict(zip(h.tolist(), c.tolist(), strict=True))


def _words(rows):
    _, _, doc, h = words(*buffers(pa.array([t or "" for _, t in rows])))
    return doc, h


def test_training_beats_counting(spark, larger):
    docs = larger[0]
    v = lm.vocabulary(docs)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    doc, h = _words(rows)
    assert v.counts.sum() == len(h)  # every word of every document
    sym = lm.symbols(h, v.known)
    fit = lambda flat: float(lm.log_probs(lm.unpack(flat), lm.contexts(sym, doc), sym).sum())
    plain = fit(lm.start(v.counts))
    assert fit(lm.train(docs, v.known, v.counts)) > plain + 0.02 * abs(plain)
    scored = {r["doc_id"]: r for r in lm.score(docs).collect()}
    assert len(scored) == docs.count() and sum(r["n_words"] for r in scored.values()) == len(h)
    assert all(r["log_prob"] == pytest.approx(r["per_word"] * r["n_words"]) for r in scored.values() if r["n_words"])


def _plain_score(rows, v, flat):
    """{row: (log_prob, network_log_prob)}, word by word."""
    from collections import Counter

    p = lm.unpack(flat.astype(np.float64))
    doc, h = _words(rows)
    names = {int(x): i for i, x in enumerate(v.known)}
    shared = lambda x: lm.SYMBOLS - lm.SHARED + int(lm.mix(np.array([x], np.uint64), 9)[0] % np.uint64(lm.SHARED))
    said = [[int(x) for x in h[doc == i]] for i in range(len(rows))]
    n = Counter(x for d in said for x in d)
    sym = {x: names[x] if x in names else shared(x) for x in n}
    listed = {int(x) for x in v.listed}
    bulk, rest, kinds = Counter(), Counter(), Counter()
    for x, k in n.items():
        bulk[sym[x]] += k
        if x not in listed:
            rest[sym[x]] += k
            kinds[sym[x]] += 1
    around = lambda d, i: (d[i - 1] if i else None, d[i + 1] if i + 1 < len(d) else None)
    place, holds = Counter(), Counter()
    for d in said:
        for i, x in enumerate(d):
            place[around(d, i)] += 1
            holds[around(d, i), x] += 1
    out = {}
    for row, d in enumerate(said):
        full = network = 0.0
        for i, x in enumerate(d):
            hid = p["hid"].copy()
            for slot, o in enumerate(lm._SLOTS):
                hid += p["emb"][slot][sym[d[i + o]] if 0 <= i + o < len(d) else lm.SYMBOLS]
            hid = np.tanh(hid)
            c, inner = divmod(sym[x], lm.SIZE)
            a, b = hid @ p["wc"] + p["bc"], hid @ p["ww"][c] + p["bw"][c]
            lp = a[c] - np.log(np.exp(a).sum()) + b[inner] - np.log(np.exp(b).sum())
            if x not in names:
                lp += np.log((n[x] if x in listed else rest[sym[x]] / kinds[sym[x]]) / bulk[sym[x]])
            c, m = holds[around(d, i), x] - 1, place[around(d, i)] - 1
            network += lp
            full += np.log((c + lm.BELIEF * np.exp(lp)) / (m + lm.BELIEF))
        out[row] = full, network
    return out


@pytest.mark.parametrize("small", [False, True])
def test_scores_are_those_of_each_word(spark, monkeypatch, small):
    """Against a plain version; with small flushes and buckets, of which the fuller ones are counted apart."""
    if small:
        for name, value in (("FLUSH", 40), ("BUCKET", 200), ("OVERFULL", 250), ("LISTED", 900)):
            monkeypatch.setattr(lm, name, value)
    rng = np.random.default_rng(5)
    said = [" ".join(f"w{int(x)}" for x in rng.zipf(1.2, rng.integers(1, 60)) % 5000) for _ in range(120)]
    said += ["one sentence that occurs in just these words"] * 30 + ["", "?!", "alone"]
    rows = list(enumerate(said)) + [(None, said[0]), (7, said[3]), (8, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    flat = np.random.default_rng(6).normal(size=lm.start(np.ones(lm.SYMBOLS)).shape).astype(np.float32) * 0.3
    monkeypatch.setattr(lm, "train", lambda *a: flat)
    v = lm.vocabulary(df)
    assert 0 < len(v.known) <= lm.SYMBOLS - lm.SHARED and len(v.listed) <= lm.LISTED and (len(v.listed) < 900 or not small)
    want = sorted(((i is None, i or 0, *x) for (i, _), x in zip(rows, _plain_score(rows, v, flat).values(), strict=True)))
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["log_prob"], r["network_log_prob"]) for r in lm.score(df).collect())
    assert len(have) == len(want)
    assert np.allclose(have, want, rtol=1e-3, atol=0.02)


def test_shares_add_up(spark, monkeypatch):
    monkeypatch.setattr(lm, "LISTED", 1500)
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 80) % 9000)) for i in range(300)]
    v = lm.vocabulary(spark.createDataFrame(rows, "doc_id bigint, text string"))
    each = np.unique(_words(rows)[1])
    assert len(v.known) < len(v.listed) < len(each)
    sym = lm.symbols(each, v.known)
    mass = np.bincount(sym, weights=np.exp(v.share(each, sym).astype(float)), minlength=lm.SYMBOLS)
    assert mass[v.counts > 0] == pytest.approx(1, abs=1e-4)


def test_copies_score_apart(spark, larger):
    """A text that occurs twice is foretold by its other place; one of its kind that occurs once is not."""
    rng = np.random.default_rng(8)
    new = lambda: " ".join(f"{a}{b}" for a, b in zip(rng.choice(["ka", "lo", "mi"], 80), rng.integers(0, 900, 80), strict=True))
    once, twice = [(10**6 + i, new()) for i in range(20)], [(2 * 10**6 + i, new()) for i in range(20)]
    docs = larger[0].select("doc_id", "text").unionByName(spark.createDataFrame(once + twice + twice, "doc_id bigint, text string"))
    got = [(r["doc_id"], r["per_word"]) for r in lm.score(docs).where("doc_id >= 1000000").collect()]
    assert min(x for i, x in got if i >= 2 * 10**6) > max(x for i, x in got if i < 2 * 10**6)


def test_scores_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "one"), (4, "one"), (None, "one two three"), (5, "long words " * 60_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, word string")
    got = lm.score(df).collect()
    assert len(got) == 7
    for r in got:
        assert (r["per_word"] is None and r["log_prob"] == 0) if r["n_words"] == 0 else (r["log_prob"] < 0 and np.isfinite(r["log_prob"]))
    assert lm.score(df.limit(0)).count() == 0


def test_contexts_stay_in_their_text():
    ctx = lm.contexts(np.array([5, 6, 7, 8]), np.array([0, 0, 1, 1]))
    s = lm.SYMBOLS
    assert ctx.T.tolist() == [[s, s, 6, s], [s, 5, s, s], [s, s, 8, s], [s, 7, s, s]]
    ctx, key = lm.places(np.array([5, 6, 5, 6, 5], np.uint64), np.array([0, 0, 1, 1, 1]))
    assert ctx[0] == ctx[2] and key[0] == key[2] and len({int(x) for x in ctx}) == 4


def test_every_word_is_a_target_once(spark, monkeypatch):
    texts = [f"the same start of text {i} and words w{i % 7} w{i % 11}" for i in range(300)] + ["", None, "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    _, _, doc, h = words(*buffers(pa.array(texts)))
    known = np.unique(h)[:20]
    batches = lm.symbol_table(df, known).toArrow().to_batches()
    seen, rates = [], []
    monkeypatch.setattr(lm, "step", lambda p, ctx, y, rate: (seen.append(y), rates.append(rate)))
    sizes = [lm.learn({}, batches, t, lm.ROUNDS, before=400_000 * t) for t in range(lm.ROUNDS)]
    assert sum(sizes) == len(h) and min(sizes) > 0.8 * len(h) / lm.ROUNDS
    assert sorted(np.concatenate(seen)) == sorted(lm.symbols(h, known))
    assert all(a > b for a, b in zip(rates, rates[1:], strict=False))
    # the same word in the same place: not the same round in every document
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    first = lm.turns(lm.symbols(h, known), head, lm.ROUNDS)[np.searchsorted(doc, np.arange(300))]
    assert set(first) == set(range(lm.ROUNDS))


def test_rounds_start_from_the_average(spark, larger):
    docs = larger[0].limit(400).repartition(3).cache()
    v = lm.vocabulary(docs)
    _, _, doc, h = words(*buffers(docs.select("text").toArrow().column("text")))
    sym = lm.symbols(h, v.known)
    table = lm.symbol_table(docs, v.known).cache()
    fit = lambda flat: float(lm.log_probs(lm.unpack(flat), lm.contexts(sym, doc), sym).sum())
    flat, before = lm.start(v.counts), 0.0
    fits = [fit(flat)]
    for t in range(lm.ROUNDS):
        flat, seen = lm._round(table, flat, t, lm.ROUNDS, lm.RATE, before)
        before += seen
        fits.append(fit(flat))
    assert before * 3 == pytest.approx(len(h))
    assert fits == sorted(fits)
