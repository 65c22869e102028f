"""Exact repeats of K-word windows by super-k-mer partitioning.

Words are lower-cased (ASCII) runs of letters, digits and non-ASCII characters, so punctuation and
spacing don't hide a repeat.  The minimiser of a window of K words is the smallest hash among its
M-word parts; consecutive windows that share it form a super-k-mer, which travels as one packed
string (its words, one space between them) to the minimiser's bucket.  Equal windows have equal
minimisers, so each bucket counts its windows alone, by sorting them: nothing is sampled or dropped.
A window's identity there is two independent 64-bit hashes of its words.

A minimiser with more than ``HOT`` super-k-mers (a line that a third of all documents hold) has no bucket:
its windows travel one by one, their occurrences are counted with partial sums before the exchange and
joined with the counts, which Spark splits where a window is hot itself.  Which minimisers are hot is
counted beforehand over all texts, from those that a task meets twice or more.

A text's identity is its doc_id and a hash of the text, so rows that share a doc_id alone are apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm._state import one_of_equal
from termloom.llm._text import LOWER, WORD, binary, buffers, gather, mix, pieces, span_hash, words

K, M = 50, 6
#: Bytes of packed strings that are hashed at once; a minimiser's windows are never parted.
BLOCK = 2 << 20
#: Super-k-mers of a minimiser beyond which its windows travel alone: its bucket would take some 200 MB.
HOT = 1 << 17

_PACKED = "minimiser bigint, doc_id bigint, h bigint, start int, packed binary"
_WINDOW = "one bigint, two bigint, doc_id bigint, h bigint, pos int"
_SPAN = "doc_id bigint, h bigint, start_word int, end_word int, first boolean, copies bigint"


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values."""
    size = 1
    while size * 2 <= w:
        a = np.minimum(a[:-size], a[size:]) if len(a) > size else a[:0]
        size *= 2
    rest = w - size
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest and len(a) > rest else a[: max(0, len(a) - rest)]


def super_kmers(offsets: np.ndarray, data: np.ndarray, k: int, m: int, skip: np.ndarray = np.zeros(0, np.int64), packed: bool = True):
    """(doc, first word in its doc, windows, minimiser, packed bytes, their offsets) of each, without the minimisers in ``skip``."""
    start, end, doc, h = words(offsets, data)
    n = len(start)
    if n < k:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.arange(n - m + 1)
    low = sliding_min(span_hash(h, at, at + m), k - m + 1)
    window_doc = doc[: len(low)]
    whole = window_doc == doc[k - 1 : k - 1 + len(low)]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | ~whole[:-1] | (window_doc[1:] != window_doc[:-1])
    run = np.flatnonzero(new)
    size = np.diff(np.append(run, len(low)))
    # a run that begins inside a doc may end with windows that reach beyond it
    size = np.add.reduceat(whole.astype(np.int64), run) if len(run) else size
    some = (size > 0) & ~_among(low[run].view(np.int64), skip)
    run, size = run[some], size[some]
    first_word = np.searchsorted(doc, doc[run], "left")
    if not packed:
        return doc[run], run - first_word, size, low[run].view(np.int64), None, None
    # the words alone, one space after each
    is_word = WORD[data]
    length = end - start
    new_start = np.zeros(n + 1, np.int64)
    np.cumsum(length + 1, out=new_start[1:])
    flat = np.full(new_start[-1], 32, np.uint8)
    body = LOWER[data[is_word]]
    flat[np.arange(len(body)) + np.repeat(np.arange(n), length)] = body
    return doc[run], run - first_word, size, low[run].view(np.int64), *gather(flat, new_start[run], new_start[run + size + k - 1] - 1)


def _count_minimisers(k: int, m: int):
    """(minimiser, n) of those that occur twice or more within the task, or within 2**20 of them."""

    def rows(key, n):
        many = n > 1
        return pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(n[many])], ["minimiser", "n"])

    def run(batches):
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for piece in pieces(batches):
            low = super_kmers(*buffers(piece.column(1)), k, m, packed=False)[3]
            u, c = np.unique(low, return_counts=True)
            key, at = np.unique(np.concatenate([key, u]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n, c]), minlength=len(key)).astype(np.int64)
            if len(key) > 1 << 20:
                yield rows(key, n)
                key, n = key[:0], n[:0]
        yield rows(key, n)

    return run


def _pack(k: int, m: int, hot: np.ndarray):
    def run(batches):
        for piece in pieces(batches):
            doc, at, size, low, packed, o = super_kmers(*buffers(piece.column(1)), k, m, skip=hot)
            if len(doc):
                cols = [piece.column(i).to_numpy()[doc] for i in (0, 2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low), *map(pa.array, cols), pa.array(at.astype(np.int32)), binary(packed, o)], ["minimiser", "doc_id", "h", "start", "packed"]
                )

    return run


def _windows(k: int, m: int, hot: np.ndarray):
    """The windows of the hot minimisers, one by one."""

    def run(batches):
        for piece in pieces(batches):
            o, data = buffers(piece.column(1))
            doc, at, size, low, _, _ = super_kmers(o, data, k, m, packed=False)
            own = _among(low, hot)
            doc, at, size = doc[own], at[own], size[own]
            if not len(doc):
                continue
            _, _, owner, h = words(o, data)
            first = np.searchsorted(owner, doc, "left") + at
            each = np.repeat(np.arange(len(doc)), size)
            step = np.arange(len(each)) - (np.cumsum(size) - size)[each]
            w = first[each] + step
            one, two = span_hash(h, w, w + k), span_hash(mix(h, 7), w, w + k)
            cols = [piece.column(i).to_numpy()[doc][each] for i in (0, 2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *map(pa.array, cols), pa.array((at[each] + step).astype(np.int32))],
                ["one", "two", "doc_id", "h", "pos"],
            )

    return run


def _among(low: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(low), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, low), len(sorted_keys) - 1)] == low


def _hashes(packed, k: int, part: int):
    """(windows of each packed string, their two hashes), ``part`` bytes or so at a time."""
    o, data = buffers(packed)
    size, ones, twos, at = [], [], [], 0
    while at < len(o) - 1:
        end = max(at + 1, int(np.searchsorted(o, o[at] + part, "right")) - 1)
        _, _, owner, h = words(o[at : end + 1] - o[at], data[o[at] : o[end]])
        n = np.bincount(owner, minlength=end - at) - (k - 1)
        first = np.searchsorted(owner, np.arange(end - at), "left")
        mer = np.repeat(np.arange(end - at), n)
        w = first[mer] + np.arange(len(mer)) - (np.cumsum(n) - n)[mer]
        size.append(n)
        ones.append(span_hash(h, w, w + k))
        twos.append(span_hash(mix(h, 7), w, w + k))
        at = end
    return np.concatenate(size), np.concatenate(ones), np.concatenate(twos)


def _count_block(block: pa.Table, k: int, part: int):
    """Spans of repeated windows within the super-k-mers of complete minimiser groups."""
    doc_id, text, start = (block.column(c).to_numpy() for c in ("doc_id", "h", "start"))
    n, one, two = _hashes(block.column("packed"), k, part)
    windows = int(n.sum())
    mer = np.repeat(np.arange(len(n)), n)
    offset = np.arange(windows) - (np.cumsum(n) - n)[mer]
    one = one ^ mix(block.column("minimiser").to_numpy().view(np.uint64))[mer]
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    if (a[1:] == a[:-1]).sum() != same.sum():  # equal in one hash alone: order by both
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    repeat = np.zeros(windows, bool)
    repeat[1:] |= same
    repeat[:-1] |= same
    order = order[repeat]
    if not len(order):
        return None
    a, b = one[order], two[order]
    head = np.ones(len(order), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(head) - 1
    count = np.bincount(group)
    ids, texts, pos = doc_id[mer[order]], text[mer[order]], start[mer[order]] + offset[order]
    by = np.lexsort((pos, texts, ids, group))
    lead = by[np.searchsorted(group[by], np.arange(len(count)), "left")]
    is_first = (ids == ids[lead][group]) & (texts == texts[lead][group]) & (pos == pos[lead][group])
    # back to reading order; windows in a row with the same answer are one span
    back = np.argsort(order, kind="stable")
    w, f, c = order[back], is_first[back], count[group][back]
    new = np.ones(len(w), bool)
    new[1:] = (np.diff(w) != 1) | (mer[w[1:]] != mer[w[:-1]]) | (f[1:] != f[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(w)) - 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_id[mer[w[s]]]), pa.array(text[mer[w[s]]]), pa.array((start[mer[w[s]]] + offset[w[s]]).astype(np.int32)),
            pa.array((start[mer[w[e]]] + offset[w[e]] + k).astype(np.int32)), pa.array(f[s]), pa.array(np.maximum.reduceat(c, s).astype(np.int64)),
        ],
        ["doc_id", "h", "start_word", "end_word", "first", "copies"],
    )


def _count(k: int, part: int):
    def run(batches):
        held: list[pa.RecordBatch] = []
        size, goal = 0, part
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= goal:
                block = pa.Table.from_batches(held).combine_chunks()
                key = block.column("minimiser").to_numpy()
                full = int(np.searchsorted(key, key[-1], "left"))  # the last minimiser may go on
                if full:
                    yield from _blocks(block.slice(0, full), key[:full], k, part)
                    block = block.slice(full)
                held, size = block.to_batches(), block.nbytes
                goal = max(part, 2 * size)  # one long minimiser is put together a few times only
        if held:
            block = pa.Table.from_batches(held).combine_chunks()
            yield from _blocks(block, block.column("minimiser").to_numpy(), k, part)

    return run


def _blocks(block: pa.Table, key: np.ndarray, k: int, part: int):
    """The block in parts of about ``part`` bytes that begin where a minimiser does."""
    o, _ = buffers(block.column("packed"))
    at = 0
    while at < len(key):
        end = min(len(key), max(at + 1, int(np.searchsorted(o, o[at] + part, "right")) - 1))
        end = int(np.searchsorted(key, key[end - 1], "right"))
        out = _count_block(block.slice(at, end - at).combine_chunks(), k, part)
        if out is not None:
            yield out
        at = end


def _spans(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(doc_id, h, start_word, end_word, first, copies), the runs of each text put together."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    counts = d.mapInArrow(_count_minimisers(k, m), "minimiser bigint, n bigint").groupBy("minimiser").agg(F.sum("n").alias("n"))
    # there are at most 1 / HOT as many as super-k-mers
    hot = np.sort(counts.where(F.col("n") > HOT).select("minimiser").toArrow().column(0).to_numpy())
    packed = d.mapInArrow(_pack(k, m, hot), _PACKED)
    spans = packed.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(_count(k, BLOCK), _SPAN)
    if len(hot):
        each = d.mapInArrow(_windows(k, m, hot), _WINDOW)
        total = each.groupBy("one", "two").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "h", "pos")).alias("lead")).where("copies > 1")
        each = each.join(total, ["one", "two"]).withColumn("first", F.struct("doc_id", "h", "pos") == F.col("lead"))
        spans = spans.unionByName(each.select("doc_id", "h", F.col("pos").alias("start_word"), (F.col("pos") + k).alias("end_word"), "first", "copies"))
    # spans of neighbouring super-k-mers meet: their windows follow one another
    w = Window.partitionBy("doc_id", "h", "first").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start_word") + (k - 1) > reach, 1).when(reach.isNull(), 1).otherwise(0)
    run = F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        spans.withColumn("opens", opens).withColumn("run", run)
        .groupBy("doc_id", "h", "first", "run")
        .agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.max("copies").alias("copies"))
    )


def repeated_spans(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(doc_id, start_word, end_word, first, copies): maximal runs of windows of k words that occur
    at least twice in the corpus.

    ``first`` tells the windows that are their text's first occurrence (by doc_id, then position) from
    the others; a run holds windows with the same answer.  Words count from 0, ``end_word`` is
    exclusive, ``copies`` is the highest number of occurrences among the run's windows.  Rows with a
    null doc_id or text, and texts of under k words, have no windows.  Texts of any length are read whole.
    Rows that share a doc_id but not their text have their spans each, in the order of their texts' hashes;
    rows that repeat both count as separate occurrences at the same place and have one set of spans.  An
    empty table gives no rows; columns other than doc_id and text are not read.
    """
    return _spans(docs, k, m).select("doc_id", "start_word", "end_word", "first", "copies")


def cut_words(offsets: np.ndarray, data: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray):
    """The texts without the words first..last-1 of their doc (sorted), and what follows up to the next word."""
    start, end, owner, _ = words(offsets, data, hashes=False)
    begin = np.searchsorted(owner, np.arange(len(offsets) - 1), "left")
    count = np.bincount(owner, minlength=len(offsets) - 1)
    a, b = begin[doc] + first, begin[doc] + np.minimum(last, count[doc])
    delta = np.zeros(len(data) + 1, np.int64)
    till = np.where(b < begin[doc] + count[doc], start[np.minimum(b, len(start) - 1)], offsets[doc + 1])
    np.add.at(delta, start[a], 1)
    np.add.at(delta, till, -1)
    keep = np.cumsum(delta[:-1]) == 0
    o = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=o[1:])
    return o[offsets], data[keep]


def drop_repeats(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """The documents without the words of any window that is not its first occurrence.

    Occurrences are in the order of doc_id, then of the text's hash where rows share a doc_id, then of
    position.  ``n_chars``, if there, is set to the new length of the texts that change; a text of which
    nothing is left goes.  Of rows that repeat a doc_id and a text of at least k words one stays (the
    others are repeats from end to end).  Rows with a null doc_id or text stay as they are, as do texts
    without repeats and those of under k words.  Texts of any length are read whole.  All columns are
    kept; an empty table gives no rows.
    """
    enough = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")) >= k
    docs = one_of_equal(docs, docs, enough)
    spans = (
        _spans(docs, k, m).where("NOT first").groupBy("doc_id", "h")
        .agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("__tl_spans")).withColumnsRenamed({"doc_id": "__tl_id", "h": "__tl_h"})
    )
    own = F.when(F.col("text").isNotNull(), F.xxhash64(F.col("text").cast("string")))
    joined = docs.join(spans, (docs["doc_id"] == F.col("__tl_id")) & (own == F.col("__tl_h")), "left").drop("__tl_id", "__tl_h")
    names = docs.columns
    text = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for piece in pieces(batches):
            spans = piece.column(len(names))
            has = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            cols = piece.columns[: len(names)]
            if len(has) and piece.column(text).null_count < piece.num_rows:
                part = spans.take(pa.array(has))
                doc = np.repeat(has, np.diff(part.offsets.to_numpy()))
                flat = part.flatten()
                a, b = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                valid = piece.column(text).is_valid()
                o, data = cut_words(*buffers(piece.column(text)), doc, a, b)
                fresh = binary(data, o, pa.string())
                changed = np.zeros(piece.num_rows, bool)
                changed[has] = True
                changed &= valid.to_numpy(zero_copy_only=False)
                flag = pa.array(changed)
                cols[text] = pc.if_else(flag, fresh, piece.column(text))
                if chars is not None:
                    cols[chars] = pc.if_else(flag, pc.utf8_length(fresh).cast(piece.column(chars).type), piece.column(chars))
                left = ~changed | (np.diff(o) > 0)
                yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(left))
            else:
                yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, docs.schema)
