"""Byte-level BPE: encoding of whole texts to token ids, and decoding.

Pre-tokenisation uses no regular expression.  Every byte carries the class of its code point
(letter, number, blank, other white space, apostrophe, other), and the boundaries of

    '(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

follow from a scan.  The scan's automaton has transition functions of two sorts, the identity (the
class goes on) and constants (the class changes: the state is set anew).  Composition of such
functions is associative and keeps the last constant, so all prefixes' compositions are one running
maximum over the positions of the constants, which gives each byte the start of its run.

The slices between boundaries are hashed, made unique for each piece of text, looked up in a cache of
earlier merges, and merged pair by pair (lowest rank first, all slices at once) where they are new.
Each token keeps the byte offset at which it starts; decoding goes by the vocabulary's byte offsets.
"""

from __future__ import annotations

import base64
import functools
import os
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm._text import binary, buffers, gather, pieces, span_hash

VOCABULARY = os.environ.get("TERMLOOM_BPE", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
L, N, BLANK, SPACE, QUOTE, OTHER = range(6)
#: Merged slices that a worker remembers.
CACHE = 1 << 18


@functools.cache
def _classes() -> np.ndarray:
    kind = {"L": L, "N": N}
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = kind.get(unicodedata.category(chr(c))[0])
        if k is not None:
            out[c] = k
    # White_Space of Unicode; str.isspace also holds four separators that are not in it
    out[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    out[32] = BLANK
    out[39] = QUOTE
    return out


def byte_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of the code point that each byte belongs to; whether the byte begins one."""
    table = _classes()
    cls = table[data].copy()  # right for ASCII
    begins = (data & 0xC0) != 0x80
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = np.zeros((4, len(lead)), np.int64)
        for i in range(4):
            b[i] = data[np.minimum(lead + i, len(data) - 1)]
        b[1:] &= 0x3F
        two, three = b[0] < 0xE0, b[0] < 0xF0
        cp = np.where(
            two, (b[0] & 0x1F) << 6 | b[1],
            np.where(three, (b[0] & 0x0F) << 12 | b[1] << 6 | b[2], (b[0] & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]),
        )
        k = table[np.minimum(cp, 0x10FFFF)]
        size = np.where(two, 2, np.where(three, 3, 4))
        cls[lead] = k
        for i in range(1, 4):
            more = size > i
            at = lead[more] + i
            ok = at < len(data)
            cls[at[ok]] = k[more][ok]
    return cls, begins


def boundaries(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Byte positions at which a slice begins."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cls, begins = byte_classes(data)
    kind = np.where(cls == QUOTE, OTHER, np.where(cls == BLANK, SPACE, cls)).astype(np.uint8)
    doc = np.zeros(n + 1, bool)
    doc[offsets] = True
    doc_end = doc[1:]
    # the scan: constants at changes of class and beginnings of texts
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | doc[1:n]
    run = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    cut = change.copy()
    # white space before anything else: its last character parts from the run; a blank joins what follows
    ends = np.flatnonzero(np.append(change[1:], True))
    ws = ends[(kind[ends] == SPACE) & ~doc_end[ends]]
    last = ws.copy()  # first byte of the run's last character
    for _ in range(3):
        back = ~begins[last]
        last[back] -= 1
    cut[last] = True
    blank = ws[cls[ws] == BLANK]
    cut[blank + 1] = False
    # contractions: an apostrophe that begins a slice, with its letters
    q = np.flatnonzero((cls == QUOTE) & cut & (run == np.arange(n)))
    if len(q):
        left = offsets[np.searchsorted(offsets, q, "right")] - q
        pad = np.concatenate([data, np.zeros(4, np.uint8)])
        a, b = pad[q + 1], pad[q + 2]
        one = (left > 1) & np.isin(a, np.frombuffer(b"sdmt", np.uint8))
        two = (left > 2) & ((a == 108) & (b == 108) | (a == 118) & (b == 101) | (a == 114) & (b == 101))
        for at, size in ((q[one], 2), (q[two & ~one], 3)):
            cut[at + 1] = False
            after = at + size
            after = after[after < n]
            cut[after[kind[after] == L]] = True  # the letters that go on are a slice of their own
    return np.flatnonzero(cut)


class Tokenizer:
    """Ranks of a byte-level vocabulary: token bytes in rank order, and the pairs that merge into each."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.size = max(ranks.values()) + 1
        token = [b""] * self.size
        for t, r in ranks.items():
            token[r] = t
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        self.token_at = np.concatenate([[0], np.cumsum([len(t) for t in token])]).astype(np.int64)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        key, value = [], []
        for t, r in ranks.items():  # any split into two tokens may meet while merging
            for i in range(1, len(t)):
                x, y = ranks.get(t[:i]), ranks.get(t[i:])
                if x is not None and y is not None:
                    key.append(x << 20 | y)
                    value.append(r)
        # open hashing in rounds: pairs that find their slot taken go to the next table
        self.tables = []
        key, value = np.array(key, np.uint64), np.array(value, np.int32)
        while len(key):
            bits = max(8, int(len(key) - 1).bit_length() + 2)
            slot = self._slot(key, len(self.tables), bits)
            keys, values = np.full(1 << bits, (1 << 64) - 1, np.uint64), np.zeros(1 << bits, np.int32)
            keys[slot], values[slot] = key, value
            self.tables.append((bits, keys, values))
            rest = keys[slot] != key
            key, value = key[rest], value[rest]
        self.cache = (np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32))

    @staticmethod
    def _slot(key: np.ndarray, level: int, bits: int) -> np.ndarray:
        return ((key ^ np.uint64(level * 0x5851F42D4C957F2D & (1 << 63) - 1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; a large number where there is none."""
        key = a.astype(np.uint64) << np.uint64(20) | b.astype(np.uint64)
        out = np.full(len(key), 1 << 30, np.int32)
        todo = np.arange(len(key))
        for level, (bits, keys, values) in enumerate(self.tables):
            slot = self._slot(key[todo], level, bits)
            there = keys[slot]
            hit = there == key[todo]
            out[todo[hit]] = values[slot[hit]]
            todo = todo[~hit & (there != np.uint64((1 << 64) - 1))]
            if not len(todo):
                break
        return out

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the slices: in each, the pair of lowest rank (leftmost) merges until none does."""
        none = 1 << 30
        ids = self.byte_id[data]
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        done_ids, done_owner = [], []
        rank = np.full(len(ids), none, np.int32)  # of the pair that begins here
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        while len(ids):
            head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(head, len(ids)))
            low = np.minimum.reduceat(rank, head)
            live = low < none
            if not live.all():  # finished slices leave
                keep = np.repeat(live, size)
                done_ids.append(ids[~keep])
                done_owner.append(owner[~keep])
                ids, owner, rank = ids[keep], owner[keep], rank[keep]
                low, size = low[live], size[live]
                if not len(ids):
                    break
            # every occurrence of the slice's lowest rank is the same pair; of overlapping ones the leftmost merges
            hit = rank == np.repeat(low, size)
            if (hit[1:] & hit[:-1]).any():
                i = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), i, 0))
                hit &= (i - start) % 2 == 0
            at = np.flatnonzero(hit)
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            at = new[at]
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            inside = (touched + 1 < len(ids)) & (owner[np.minimum(touched + 1, len(ids) - 1)] == owner[touched])
            rank[touched] = none
            pair = touched[inside]
            rank[pair] = self.ranks(ids[pair], ids[pair + 1])
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int32)
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))])

    def encode(self, offsets: np.ndarray, data: np.ndarray):
        """(ids, offsets of the texts in them, byte at which each token begins in its text)."""
        start = boundaries(offsets, data)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), np.zeros(0, np.int32)
        end = np.append(start[1:], len(data))
        h = span_hash(data, start, end) + (end - start).astype(np.uint64)
        unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        known, kept_at, kept_ids = self.cache
        where = np.minimum(np.searchsorted(known, unique), max(0, len(known) - 1))
        hit = known[where] == unique if len(known) else np.zeros(len(unique), bool)
        miss = np.flatnonzero(~hit)
        ids, o = self.merge(*gather(data, start[at[miss]], end[at[miss]]))
        # slice -> span of its ids in one array
        flat = np.concatenate([kept_ids, ids])
        lo, hi = np.empty(len(unique), np.int64), np.empty(len(unique), np.int64)
        lo[hit], hi[hit] = kept_at[where[hit]], kept_at[where[hit] + 1]
        lo[miss], hi[miss] = o[:-1] + len(kept_ids), o[1:] + len(kept_ids)
        out, slice_at = gather(flat, lo[inverse], hi[inverse])
        self._remember(unique, lo, hi, flat, hit)
        doc_slice = np.searchsorted(start, offsets)
        text_at = slice_at[doc_slice]
        size = self.token_at[out + 1] - self.token_at[out]
        begin = np.cumsum(size) - size
        begin -= np.repeat(offsets[:-1], np.diff(text_at))
        return out, text_at, begin.astype(np.int32)

    def _remember(self, unique, lo, hi, flat, hit) -> None:
        known, kept_at, kept_ids = self.cache
        if len(known) + len(unique) > 2 * CACHE:
            known, kept_at, kept_ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)
            fresh = np.arange(len(unique))
        else:
            fresh = np.flatnonzero(~hit)
        key = np.concatenate([known, unique[fresh]])
        a = np.concatenate([kept_at[:-1], lo[fresh]])
        b = np.concatenate([kept_at[1:], hi[fresh]])
        order = np.argsort(key, kind="stable")
        if len(fresh) or len(known) != len(self.cache[0]):
            ids, o = gather(flat, a[order], b[order])
            self.cache = (key[order], o, ids)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of each list of ids."""
        data, at = gather(self.token_bytes, self.token_at[ids], self.token_at[ids + 1])
        return data, at[offsets]


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, starts, round_trip) of every row.

    ``starts`` is the byte at which each token begins in the text; ``round_trip`` tells that decoding
    gives the text's bytes again, and is checked for each row.  A null text gives null in the columns
    other than doc_id; an empty text gives empty lists.  Rows are neither merged nor dropped, whatever
    their doc_id.  Special tokens are never produced: their spelling in a text is ordinary text.  Texts of
    any length are read whole; pairs of equal rank merge from the left.  An empty table gives no rows.
    Columns other than doc_id and text are not read.  ``path`` must be readable on every executor.
    """

    def run(batches):
        t = tokenizer(path)
        for piece in pieces(batches):
            o, data = buffers(piece.column(1))
            ids, at, starts = t.encode(o, data)
            back, back_at = t.decode(ids, at)
            ok = np.diff(back_at) == np.diff(o)
            if len(back) == len(data) and ok.all():
                wrong = np.flatnonzero(back != data)
                ok[np.searchsorted(o, wrong, "right") - 1] = False
            else:
                ok[:] = [back[back_at[i] : back_at[i + 1]].tobytes() == data[o[i] : o[i + 1]].tobytes() for i in range(len(ok))]
            null = np.asarray(piece.column(1).is_null())
            n = np.diff(at).astype(np.int32)
            lost = np.append(null, False)
            listed = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=lost), pa.array(v)) for v in (ids, starts)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(n, mask=null), *listed, pa.array(ok, mask=null)], ["doc_id", "n_tokens", "ids", "starts", "round_trip"]
            )

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id bigint, n_tokens int, ids array<int>, starts array<int>, round_trip boolean")


def decode_documents(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids).

    Null ids give a null text, an empty list an empty text.  A null or an id outside the vocabulary
    within a list is passed over; bytes that are no UTF-8 (as where a list ends inside a character) become
    U+FFFD.  An empty table gives no rows, rows that repeat keep a row each.  Other columns are not read.
    """

    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            col = batch.column(1)
            null = np.asarray(col.is_null())
            at = np.zeros(len(col) + 1, np.int64)
            np.cumsum(np.where(null, 0, col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), out=at[1:])
            ids = col.flatten().fill_null(-1).to_numpy()
            fine = (ids >= 0) & (ids < t.size)
            kept = np.concatenate([[0], np.cumsum(fine)])
            data, o = t.decode(ids[fine], kept[at])
            try:
                text = binary(data, o, pa.string())
                text.validate(full=True)
            except pa.ArrowInvalid:
                text = pa.array([data[a:b].tobytes().decode(errors="replace") for a, b in zip(o[:-1], o[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(col.is_null(), None, text)], ["doc_id", "text"])

    d = tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return d.mapInArrow(run, "doc_id bigint, text string")
