"""Vectorised text primitives over Arrow string buffers.

A column of texts is one byte array plus offsets.  Everything here works on those two arrays, so
no Python object is made for a document, a word or a character.  Batches are cut into pieces of
about ``CHUNK`` bytes first, which bounds a worker's memory whatever the Arrow batch holds; a text
longer than that is a piece of its own and is processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
MAX_DOCS = 32_000

_M = 0x9E3779B97F4A7C15 | 1
_MINV = pow(_M, -1, 1 << 64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

#: ASCII letters and digits, and every byte of a non-ASCII character, make words.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64 for i < n."""
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        for base, name in ((_M, "_pow"), (_MINV, "_inv")):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            globals()[name] = np.cumprod(a, dtype=np.uint64)
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ np.uint64(seed * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each span, from one prefix sum."""
    p, q = powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[: len(values)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * q[start])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64, bytes uint8) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if offs is None or not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return o - o[0], d


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece hold about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        o, _ = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(o, o[at] + size, "right")) - 1
            end = min(max(end, at + 1), at + MAX_DOCS, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def words(offsets: np.ndarray, data: np.ndarray, hashes: bool = True):
    """(start, end, doc, hash) of each word: a maximal run of word bytes, hashed in lower case (ASCII)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    w = WORD[data]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    after[edge - 1] = False
    start = np.flatnonzero(w & ~before)
    end = np.flatnonzero(w & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    h = span_hash(LOWER[data], start, end) if hashes else None
    return start, end, doc, h


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes one after another, and their offsets."""
    size = end - start
    o = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=o[1:])
    at = np.repeat(start - o[:-1], size)
    at += np.arange(o[-1])
    return data[at], o


def binary(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow binary (or string) array over the bytes."""
    kind = kind or pa.binary()
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each node's component, after joining a[i] with b[i]."""
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        live = x != y
        if not live.any():
            break
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
    return label
