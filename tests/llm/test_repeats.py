import random

import duckdb
import pytest

from termloom.llm import queries, substring
from tests.llm import brute

SCHEMA = "doc_id bigint, text string"


def covered(spans, k):
    out = {}
    for r in spans.collect():
        for p in range(r["start_word"], r["end_word"] - k + 1):
            assert (r["doc_id"], p) not in out
            out[r["doc_id"], p] = r["first"]
    return out


@pytest.mark.parametrize(("block", "hot"), [(4 << 20, 1 << 17), (64, 1 << 17), (64, 2)])
def test_against_all_windows(spark, monkeypatch, block, hot):
    monkeypatch.setattr(substring, "BLOCK", block)
    monkeypatch.setattr(substring, "HOT", hot)
    rng = random.Random(7)
    docs = [(i, "".join(rng.choice(["a", "B", "é", "c1"]) + rng.choice([" ", ", ", "\n", " — "]) for _ in range(rng.randrange(30)))) for i in range(60)]
    docs += [(100, None), (None, docs[0][1]), (101, "")]
    df = spark.createDataFrame(docs, SCHEMA)
    for k, m in ((5, 2), (3, 3), (8, 2)):
        want = brute.repeats(docs, k)
        got = substring.repeated_spans(df, k, m)
        assert covered(got, k) == {at: first for at, (first, _) in want.items()}
        for r in got.collect():
            assert r["copies"] == max(want[r["doc_id"], p][1] for p in range(r["start_word"], r["end_word"] - k + 1))
        left = sorted(((r["doc_id"], r["text"]) for r in substring.drop_repeats(df, k, m).collect()), key=repr)
        assert left == sorted(brute.without_repeats(docs, k), key=repr)


def test_rows_that_share_a_doc_id(spark):
    """Spans belong to a row: a text that nothing repeats stays, and of equal rows one."""
    text = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    drop = lambda rows: sorted((tuple(r) for r in substring.drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    p, q, r = text("p"), text("q"), text("r")
    assert drop([(1, p), (2, p), (2, q)]) == [(1, p), (2, q)]
    assert drop([(1, p), (1, p)]) == [(1, p)]
    assert drop([(1, p), (1, p), (1, None), (2, p), (2, p), (3, r)]) == sorted([(1, p), (1, None), (3, r)], key=repr)
    assert drop([(1, "few words"), (1, "few words"), (1, q), (1, r)]) == sorted([(1, "few words"), (1, "few words"), (1, q), (1, r)], key=repr)
    both = drop([(1, q + " " + p), (1, r + " " + p)])  # one of the two keeps the passage
    assert sorted(len(t.split()) for _, t in both) == [60, 120]
    spans = substring.repeated_spans(spark.createDataFrame([(1, p), (1, p), (2, q)], SCHEMA)).collect()
    assert [tuple(s) for s in spans] == [(1, 0, 60, True, 2)]


def test_hot_passage_in_bounded_memory():
    """200,000 equal passages under one minimiser: windows are hashed in parts, and nothing is copied for each batch."""
    import resource

    import numpy as np
    import pyarrow as pa

    n = 200_000
    line = " ".join(f"w{i:02}" for i in range(60)).encode()
    batch = lambda at, size: pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, 7)), pa.array(np.arange(at, at + size)), pa.array(np.zeros(size, np.int64)), pa.array(np.zeros(size, np.int32)), pa.array([line] * size, pa.binary())],
        ["minimiser", "doc_id", "h", "start", "packed"],
    )
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    spans = pa.Table.from_batches(list(substring._count(50, substring.BLOCK)(batch(at, 10_000) for at in range(0, n, 10_000))))
    assert spans.num_rows == n and spans.column("first").to_numpy().sum() == 1 and set(spans.column("copies").to_numpy()) == {n}
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 1200


def test_production_windows(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(70))
    fill = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    long = fill(30_000)
    docs = [(1, fill(20) + " " + passage + ". " + fill(5)), (2, passage.upper()), (3, fill(49)), (4, fill(3) + "\n" + passage.replace(" ", "; ")), (5, long), (6, "head " + long + " tail")]
    df = spark.createDataFrame([(*d, 0, "x", len(d[1])) for d in docs], "doc_id bigint, text string, start int, minimiser string, n_chars int")
    out = {r["doc_id"]: r for r in substring.drop_repeats(df).collect()}
    assert set(out) == {1, 3, 4, 5, 6} and out[1]["text"] == docs[0][1] and out[3]["text"] == docs[2][1] and out[5]["text"] == long
    assert out[4]["text"] == docs[3][1].split("\n")[0] + "\n" and out[6]["text"] == "head tail"
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    copies = {(r["doc_id"], r["first"]): r["copies"] for r in substring.repeated_spans(df).collect()}
    assert copies == {(1, True): 3, (2, False): 3, (4, False): 3, (5, True): 2, (6, False): 2}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring.repeated_spans(df).count() == 0 and substring.drop_repeats(df).count() == 0


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(queries.OP5_SQL).fetchall())
    got = sorted(tuple(r[c] for c in ("doc_id", "start_word", "end_word", "first", "copies")) for r in queries.queries()["op5_repeated_spans"](spark, sf_dir).collect())
    assert got == want
