import numpy as np
import pytest

from termloom.llm import ann

SCHEMA = "vec_id bigint, embedding array<double>"


def truth(v, k):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("clusters", [40, 0])
def test_recall(spark, monkeypatch, clusters):
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 16))
    if clusters:
        v = rng.normal(size=(clusters, 16))[rng.integers(0, clusters, 1500)] + 0.15 * v
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in enumerate(v)], SCHEMA)
    got = {}
    for r in ann.neighbours(df, k=10).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour_id"], r["cosine"]))
    assert set(got) == set(range(1500))
    want = truth(v, 10)
    hits = sum(len({n for _, n, _ in got[i]} & set(want[i].tolist())) for i in got)
    assert hits >= 0.9 * want.size
    for i, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 11)) and i not in {n for _, n, _ in rows}
        assert [(-c, n) for _, n, c in rows] == sorted((-c, n) for _, n, c in rows)


def test_structure_is_used():
    """On clustered vectors windows are narrower than the curve."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 16))[rng.integers(0, 200, 6000)] + 0.05 * rng.normal(size=(6000, 16))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    keys = ann.curve_keys(v, 3)
    order = np.argsort(keys[0])
    place = np.empty(6000, int)
    place[order] = np.arange(6000)
    near = truth(v.astype(float), 1)[:, 0]
    assert np.median(np.abs(place - place[near])) < 600


def test_hilbert_is_a_walk():
    bits, dims = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = ann.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(1 << bits * dims))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0]), (4, None), (None, [1.0, 1.0]), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0]), (9, [float("inf"), 1.0]), (10, [None, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", rank int, keys int")
    got = sorted((r["vec_id"], r["rank"], r["neighbour_id"], r["cosine"]) for r in ann.neighbours(df, k=5).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)]
    assert ann.neighbours(df.limit(0)).count() == 0


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 32)
    df = spark.createDataFrame([(i, [1.0, float(i // 200), 0.0]) for i in range(400)], SCHEMA)
    rows = ann.neighbours(df, k=3).collect()
    assert len(rows) == 1200 and all(r["cosine"] == 1.0 for r in rows)
