"""Slow and plain versions of the operators, for comparison."""

import re
from collections import defaultdict

import numpy as np

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text):
    """Lower-cased (ASCII) runs of letters, digits and other characters than ASCII."""
    return [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text.encode())]


def groups(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    out = defaultdict(list)
    for i in ids:
        out[find(i)].append(i)
    return {k: sorted(v) for k, v in out.items()}


def simhash_groups(docs, limit):
    """{smallest doc_id: members} of groups of two or more, by comparing all fingerprints."""
    import pyarrow as pa

    from termloom.llm._text import buffers
    from termloom.llm.simhash import fingerprints

    rows = [(i, t) for i, t in docs if i is not None and t is not None]
    fp = fingerprints(*buffers(pa.array([t for _, t in rows], pa.string())))
    pairs = []
    for a in range(len(rows)):
        far = np.bitwise_count(fp[a + 1 :] ^ fp[a]).sum(axis=1)
        pairs += [(rows[a][0], rows[a + 1 + b][0]) for b in np.flatnonzero(far <= limit)]
    return {k: v for k, v in groups({i for i, _ in rows}, pairs).items() if len(v) > 1}


def repeats(docs, k):
    """{(doc_id, pos): (is first, copies)} of every window of k words that occurs twice or more."""
    seen = defaultdict(list)
    for i, t in docs:
        if i is None or t is None:
            continue
        w = [x[0] for x in words(t)]
        for p in range(len(w) - k + 1):
            seen[tuple(w[p : p + k])].append((i, p))
    return {at: (at == min(places), len(places)) for places in seen.values() if len(places) > 1 for at in places}


def without_repeats(docs, k):
    """(doc_id, text) once the words of windows that aren't a first occurrence are cut, with what follows each."""
    again = defaultdict(set)
    for (i, p), (first, _) in repeats(docs, k).items():
        if not first:
            again[i] |= set(range(p, p + k))
    out = []
    for i, t in docs:
        if t is None or not again.get(i):
            out.append((i, t))
            continue
        data, w, keep = t.encode(), words(t), []
        keep.append(data[: w[0][1]])
        for n, (_, start, _) in enumerate(w):
            if n not in again[i]:
                keep.append(data[start : w[n + 1][1] if n + 1 < len(w) else len(data)])
        text = b"".join(keep).decode()
        if text:
            out.append((i, text))
    return out


def flat(text):
    t = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return np.frombuffer(t, np.uint8)


def fewest_edits(item, text):
    """Smallest edit distance between the item and any substring of the text."""
    d = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.empty_like(d)
        new[0] = i
        sub = d[:-1] + (text != c)
        best = np.minimum(sub, d[1:] + 1)
        run = i
        for j in range(len(text)):
            run = min(best[j], run + 1)
            new[j + 1] = run
        d = new
    return int(d.min())


def leaks(docs, items, rate):
    out = {}
    for i, t in docs:
        for n, it in items:
            if i is None or n is None or t is None or it is None:
                continue
            a, b = flat(it), flat(t)
            if not len(a):
                continue
            e = fewest_edits(a, b)
            if e <= int(rate * len(a)):
                out[i, n] = min(e, out.get((i, n), e))
    return out
