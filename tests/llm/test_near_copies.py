import random

import pytest
from pyspark.sql import functions as F

from termloom.llm import simhash
from tests.llm import brute

SCHEMA = "doc_id bigint, text string"


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randrange(3, 9))) for _ in range(2000)]
    docs = []
    for i in range(120):
        base = rng.choices(vocab, k=rng.randrange(60, 200))
        docs.append((len(docs), " ".join(base)))
        for _ in range(i % 4):
            copy = [rng.choice(vocab) if rng.random() < rng.choice([0.0, 0.03, 0.1, 0.4]) else w for w in base]
            docs.append((len(docs), " ".join(copy)))
    return docs


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["group_id"], []).append(r["doc_id"])
        assert r["group_size"] >= 2
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("split_rows", [1 << 19, 16])
def test_against_all_pairs(spark, monkeypatch, split_rows):
    monkeypatch.setattr(simhash, "SPLIT_ROWS", split_rows)
    docs = corpus()
    got = found(simhash.near_duplicate_groups(spark.createDataFrame(docs, SCHEMA)))
    want = brute.simhash_groups(docs, simhash.MAX_DISTANCE)
    pairs = lambda g: {(a, b) for v in g.values() for a in v for b in v if a < b}
    assert pairs(got) <= pairs(want)
    assert len(pairs(got)) >= 0.95 * len(pairs(want)) > 50


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    docs = [(1, "same words here and there"), (2, "same words here and there"), (2, "same words here and there"), (3, None), (None, "same words here and there"), (4, ""), (5, ""),
            (6, "?!"), (7, "?!"), (8, "!!"), (9, long), (10, long + " tail"), (11, "alone in its kind"), (12, "x y z"), (12, "quite another text than that")]
    df = spark.createDataFrame([(*d, "u", 1) for d in docs], "doc_id bigint, text string, rep string, fp int")
    assert found(simhash.near_duplicate_groups(df)) == {1: [1, 2], 4: [4, 5], 6: [6, 7], 9: [9, 10]}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    left = sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr)
    assert left == sorted([d for d in docs if d[0] in (None, 1, 3, 4, 6, 8, 9, 11, 12)], key=repr)


def test_rows_that_share_a_doc_id(spark):
    """A text goes only if it is near another that stays; nulls and other texts displace nothing."""
    whales, zeta, other = "a unique document about whales", "zeta has a text of its own here", "other words altogether in this one"
    drop = lambda rows: sorted([tuple(r) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA + ", tag string")).collect()], key=repr)
    rows = [(5, None, "a"), (5, whales, "b"), (7, zeta, "c"), (7, other, "d")]
    assert drop(rows) == sorted(rows, key=repr) and drop(rows[:2]) == sorted(rows[:2], key=repr)
    # a null text stays though its id's text goes; copies of one text under two ids leave the other texts alone
    rows = [(1, zeta, "a"), (2, zeta, "b"), (2, None, "c"), (2, other, "d"), (3, other, "e"), (3, whales, "f"), (None, zeta, "g")]
    assert drop(rows) == sorted([r for r in rows if r[2] not in "be"], key=repr)
    # rows that repeat a doc_id and a text become one; the first by the other columns
    assert drop([(1, zeta, "b"), (1, zeta, "a"), (1, None, "x"), (1, None, "x")]) == sorted([(1, zeta, "a"), (1, None, "x"), (1, None, "x")], key=repr)
    got = simhash.near_duplicate_groups(spark.createDataFrame([(1, zeta), (2, zeta), (2, other), (3, other), (4, whales), (4, whales)], SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 2), (2, 1, 2), (2, 2, 2), (3, 2, 2)]


@pytest.mark.parametrize("crowd", [2, 1 << 30])
def test_crowded_segments(spark, monkeypatch, crowd):
    """Families that share segments, in overfull splits and with pivots, are grouped as by all pairs."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "SPLIT_ROWS", 8)
    monkeypatch.setattr(simhash, "HOT", 1)
    rng = random.Random(4)
    seeds = [rng.getrandbits(simhash.BITS) for _ in range(6)]
    rows = [(i, (seeds[i % 6] ^ sum(1 << b for b in {rng.randrange(simhash.BITS) for _ in range(rng.randrange(18))})).to_bytes(simhash.BITS // 8, "big")) for i in range(240)]
    got = {r["node"]: r["label"] for r in simhash.connected(simhash.links(spark.createDataFrame(rows, "rep bigint, fp binary"))).collect()}
    # within 38 bits of each other at most, of which a segment in common is all but certain
    assert all(got.get(i, i) == i % 6 for i, _ in rows)


def test_votes_are_those_of_the_words():
    import pyarrow as pa

    from termloom.llm._text import buffers, words

    m = (1 << 64) - 1

    def mix(h, seed):
        h ^= seed * 0xD6E8FEB86659FD93 & m
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m
        h = (h ^ h >> 27) * 0x94D049BB133111EB & m
        return h ^ h >> 31

    for text in ("one two three two", "Ein Satz, ein Wort", " ".join(f"w{i}" for i in range(600))):
        o, data = buffers(pa.array([text]))
        said = {int(x) >> 16 for x in words(o, data)[3]}
        votes = [0] * simhash.BITS
        for h in said:
            for b in range(simhash.BITS):
                votes[b] += mix(h, b // 64 + 1) >> (8 * (b % 64 // 8) + 7 - b % 8) & 1
        want = "".join(str(int(2 * v > len(said))) for v in votes)
        assert "".join(f"{b:08b}" for b in simhash.fingerprints(o, data)[0]) == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicate_groups(df).count() == 0 and simhash.drop_near_duplicates(df).count() == 0


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in simhash.connected(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 100: 90}


def test_exact_copies_fall_together(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.groupBy("text").count().where("count > 1").count() == 0
    assert kept.schema == docs.schema and kept.agg(F.min("doc_id")).first()[0] == docs.agg(F.min("doc_id")).first()[0]
