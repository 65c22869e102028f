import random

import numpy as np
import pyarrow as pa
import pytest

from termloom.llm import decontam
from termloom.llm._text import buffers
from tests.llm import brute


def spoil(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        at = rng.randrange(len(t) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            t.insert(at, rng.choice("xyz "))
        elif t and kind == 1:
            del t[min(at, len(t) - 1)]
        elif t:
            t[min(at, len(t) - 1)] = rng.choice("xyz")
    return "".join(t)


def test_against_full_alignment(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcde ÄB", k=n))
    items = [(i, text([5, 8, 13, 14, 19, 26, 28, 40, 45, 60, 60, 120][i])) for i in range(12)] + [(50, None), (None, "abc" * 9), (51, ""), (3, text(40))]
    docs = []
    for i in range(60):
        n, it = items[i % 12]
        inside = spoil(rng, it, rng.randrange(9)) if i % 3 else ""
        docs.append((i, text(rng.randrange(80)) + inside + text(rng.randrange(80))))
    docs += [(90, None), (91, ""), (92, "".join(i[1] for i in items[:5])), (93, items[2][1][: len(items[2][1]) // 2])]
    b = spark.createDataFrame([(*x, "t") for x in items], "item_id bigint, text string, edits string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    for rate in (0.08, 0.03, 0.0):
        got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.leaks(d, b, 10, rate).collect()}
        assert got == brute.leaks(docs, items, rate)
        left = {r["doc_id"] for r in decontam.drop_leaks(d, b, 10, rate).collect()}
        assert left == {i for i, _ in docs} - {i for i, _ in got}
    assert got


@pytest.mark.parametrize(("size", "many"), [(1 << 20, 4), (64, 2)])
def test_passes_change_nothing(spark, monkeypatch, size, many):
    """Repeated rows, shared and null doc_ids, by one pass over the documents and by several."""
    monkeypatch.setattr(decontam, "SLICE", size)
    monkeypatch.setattr(decontam, "PASS", many)
    items = [(i, f"the question number {i * 7919} asks for nothing at all") for i in range(9)]
    docs = [(1, "x " * 40_000 + items[4][1].upper() + " y" * 9), (2, items[0][1]), (2, items[0][1]), (2, items[0][1] + " " + items[8][1]), (3, "clean"), (3, None), (None, items[1][1]), (None, "b " + items[1][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame(items + items[:1] + [(4, items[4][1].replace("asks", "ask"))], "item_id bigint, text string")
    assert len(list(decontam._passes(b))) == (1 if size > 64 else 5)
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in decontam.leaks(d, b).collect()), key=repr)
    near = {(i, n): e for (i, n), e in brute.leaks([docs[0], (3, "clean")], items, decontam.RATE).items()}
    want = [(1, n, e) for (_, n), e in near.items()]
    for i, t in {docs[1], docs[3], *docs[6:]}:
        want += [(i, n, e) for (_, n), e in brute.leaks([(0, t)], items, decontam.RATE).items()]
    assert got == sorted(want, key=repr)
    assert sorted((tuple(r) for r in decontam.drop_leaks(d, b).collect()), key=repr) == [(3, "clean", 1), (3, None, 1)]


def test_short_and_long_items(monkeypatch):
    """An item of any length is found within its budget; long ones take bounded memory and no distance is cut off."""
    monkeypatch.setattr(decontam, "CELLS", 1 << 12)
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh ", k=2_000))
    items = [(1, "short one"), (2, long), (3, "ab cd ef gh ij"), (4, "x")]
    docs = [(0, "short one"), (1, "Short\tone more"), (2, "short on"), (3, "see ab cd ef gh ij"), (4, "see ab cd eX gh ij"), (5, "see ab cd eX gX ij"), (6, "head " + spoil(rng, long, 60) + " tail"), (7, spoil(rng, long, 400))]
    o, data = buffers(pa.array([t for _, t in docs]))
    got = {}
    for index in decontam.indices(np.array([i for i, _ in items]), [t.encode() for _, t in items]):
        for doc, item, edits in zip(*index.matches(o, data), strict=True):
            got[int(doc), int(index.ids[item])] = int(edits)
    assert got == brute.leaks(docs, items, decontam.RATE) and (6, 2) in got and (4, 3) in got and (7, 2) not in got


def test_empty(spark):
    d = spark.createDataFrame([(1, "some text that leaks nothing")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.leaks(d, none).count() == 0 and decontam.drop_leaks(d, none).count() == 1
    assert decontam.leaks(d.limit(0), none).count() == 0
