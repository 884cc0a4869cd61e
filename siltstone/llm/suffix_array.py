"""Substring dedup by the interval tree of an enhanced suffix array.

Strings of WIDTH bytes that documents share have a shared anchor (see repeats), so all suffixes that begin with such a
string meet in their anchor's partition, as the segments around that anchor. Equal texts are one text of their least
document, and equal segments one segment with its
least and greatest document before they are dealt out, so copies don't crowd a partition. There the suffixes are
sorted, neighbours' common prefixes are measured, and one scan with a stack visits the common-prefix intervals: an
interval of WIDTH or more bytes whose suffixes are preceded by different bytes (or begin a segment) is a maximal repeat,
and all its suffixes are its occurrences. A longer repeat is a chain of overlapping segments.

A byte is removed where a repeat covers it that also lies in a document of a smaller id. Null and empty texts have no
bytes. Rows of one id count as one document, which never has a smaller id than itself; a null id comes last. Repeated
rows repeat their results. Extra columns are dropped. A text must fit into a task's memory about a hundredfold.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .repeats import Unit, _longs, by_anchor, candidates, distinct_segments, keyed, originals, segments

WIDTH, GRAM = 50, 20
_BORDER = 256  # what stands before a segment's first byte: differs from every byte and from itself


def suffix_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes [start, end) in order, and the common prefix of each with the one before."""
    size = end - start
    deep = -(-int(size.max()) // 8)
    padded = np.concatenate([data, np.zeros(8 * deep + 8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    keys = []
    for j in range(deep):
        have = np.clip(size - 8 * j, 0, 8)
        mask = np.where(have > 0, ~np.uint64(0) << (np.uint64(8) * (8 - np.maximum(have, 1)).astype(np.uint64)), np.uint64(0))
        keys.append(eight[start + 8 * j].astype(np.uint64) & mask)
    order = np.lexsort((size, *keys[::-1]))
    common = np.zeros(len(order), np.int64)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        k = k[order]
        differ = k[1:] ^ k[:-1]
        equal = np.zeros(len(differ), np.int64)
        for b in range(1, 9):
            equal += differ < (np.uint64(1) << np.uint64(8 * (8 - b))) if b < 8 else differ == 0
        common[1:] += np.where(same, equal, 0)
        same &= differ == 0
    size = size[order]
    common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    return order, common


def intervals(common: list[int], left: list[int], least: int):
    """(first, end, length) of maximal repeats among sorted suffixes: common-prefix intervals of diverse left extension.

    left: the byte before each suffix, _BORDER where there is none.
    """
    stack: list[list[int]] = []  # length, first, a left byte, or -1 once two differ
    n = len(common)
    for i in range(1, n + 1):
        now = common[i] if i < n else 0
        first = i - 1
        mark = left[first] if left[first] != _BORDER else -1
        while stack and stack[-1][0] > now:
            length, first, own = stack.pop()
            own = own if own == mark else -1
            if own < 0:
                yield first, i, length
            mark = own
        if now < least:
            stack.clear()
        elif stack and stack[-1][0] == now:
            if stack[-1][2] != mark:
                stack[-1][2] = -1
        else:
            stack.append([now, first, mark])


def _groups(t: pa.Table, all_occurrences: bool):
    """(h, seg, skip, length, owner) for each occurrence of each maximal repeat of several documents in the segments of some anchors.

    Without all_occurrences only what removal needs: the spans of a segment that lie in a document before all of its
    own, united, and the whole segment as a repeat of its first document.
    """
    h, seg, lo, hi = (t.column(c).to_numpy() for c in ("h", "seg", "lo", "hi"))
    payload = t.column("payload").combine_chunks()
    payload = payload.chunk(0) if isinstance(payload, pa.ChunkedArray) else payload
    at = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + len(payload) + 1].astype(np.int64)
    data = np.frombuffer(payload.buffers()[2], np.uint8)
    out = [[], [], [], []]  # segment, skip, length, owner

    def add(segs, skip, length, owner):
        for o, x in zip(out, (segs, skip, length, owner), strict=True):
            o.append(x)

    whole = np.flatnonzero(lo < hi)
    add(whole, np.zeros(len(whole), np.int64), np.diff(at)[whole], lo[whole])
    head = np.r_[True, h[1:] != h[:-1]]
    several = np.flatnonzero(~(head & np.r_[head[1:], True]))  # segments that are not alone with their anchor
    many = np.diff(at)[several] - WIDTH + 1
    for a in range(0, len(several), 20_000):  # anchors' segments lie together; a block takes on those that go on
        b = a + 20_000
        while b < len(several) and h[several[b]] == h[several[b - 1]]:
            b += 1
        a = a if a == 0 else next((x for x in range(a, len(several)) if h[several[x]] != h[several[x - 1]]), len(several))
        s, m = several[a:b], many[a:b]
        if not len(s):
            continue
        of = np.repeat(s, m)
        skip = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(m)[:-1]], m)
        start = at[of] + skip
        order, common = suffix_array(data, start, at[of + 1])
        of, skip, start = of[order], skip[order], start[order]
        left = np.where(skip > 0, data[np.maximum(start - 1, 0)].astype(np.int64), _BORDER)
        low, high = lo[of], hi[of]
        # Only runs with a common prefix of WIDTH are scanned.
        near = np.r_[common[1:] >= WIDTH, False] | (common >= WIDTH)
        rows = np.flatnonzero(near)
        if not len(rows):
            continue
        c = np.where(np.r_[True, rows[1:] != rows[:-1] + 1], 0, common[rows])
        low, high, of, skip = low[rows], high[rows], of[rows], skip[rows]
        found = np.array(list(intervals(np.where(c >= WIDTH, c, 0).tolist(), left[rows].tolist(), WIDTH)), np.int64).reshape(-1, 3)
        if not len(found):
            continue
        n = found[:, 1] - found[:, 0]
        ends = np.cumsum(n)
        member = np.arange(ends[-1]) + np.repeat(found[:, 0] - np.r_[0, ends[:-1]], n)
        first = np.r_[0, ends[:-1]]
        owner, most = np.minimum.reduceat(low[member], first), np.maximum.reduceat(high[member], first)
        shared = np.repeat(owner < most, n)
        add(of[member][shared], skip[member][shared], np.repeat(found[:, 2], n)[shared], np.repeat(owner, n)[shared])
    segs, skip, length, owner = (np.concatenate(x) for x in out)
    if not all_occurrences:
        early = np.flatnonzero(owner < lo[segs])
        early = early[np.lexsort((skip[early], segs[early]))]
        base = segs[early] * (int(np.diff(at).max()) + 2)
        begin, reach = base + skip[early], np.maximum.accumulate(base + skip[early] + length[early]) if len(early) else base
        head = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]]) if len(early) else early
        last = np.r_[head[1:], len(early)] - 1 if len(early) else head
        n = len(whole)
        segs, skip, length, owner = (np.r_[a[:n], b] for a, b in ((segs, segs[early][head]), (skip, skip[early][head]), (length, reach[last] - begin[head]), (owner, owner[early][head])))
    yield pa.RecordBatch.from_arrays([_longs(h[segs]), _longs(seg[segs]), _longs(skip), _longs(length), _longs(owner)], ["h", "seg", "skip", "length", "owner"])


def maximal_repeats(docs: DataFrame, firsts: DataFrame, all_occurrences: bool = True) -> DataFrame:
    """(rk, doc, start, length, owner): occurrences of maximal repeats of several texts; owner is their first document.

    Without all_occurrences only those that removal needs, united where they overlap in a segment.
    """
    unit = Unit(WIDTH, GRAM, False)
    found = materialise(candidates(docs, firsts, unit), "suffixes-anchors")
    cut = materialise(segments(docs, found, unit), "suffixes-segments")
    discard(found)
    groups = materialise(by_anchor(distinct_segments(cut), partial(_groups, all_occurrences=all_occurrences), "h long, seg long, skip long, length long, owner long"), "suffixes-groups")
    out = materialise(cut.select("h", "seg", "rk", "doc", "start").join(groups, ["h", "seg"]).select("rk", "doc", (F.col("start") + F.col("skip")).alias("start"), "length", "owner"), "suffixes-repeats")
    discard(cut, groups)
    return out


def _apply(text: bytes, copy: bool, starts: list[int], ends: list[int]) -> tuple[int, int, int, bytes]:
    """(bytes, bytes removed, runs removed, what is left) for spans in order of their starts; a copy is one repeat from end to end."""
    if copy and len(text) >= WIDTH:
        return len(text), len(text), 1, b""
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for s, e in zip(starts, ends, strict=True):
        if s > end:
            runs += 1
            kept.append(text[at:s])
            at = s
        if e > at:
            removed += e - at
            at = e
        end = max(end, e)
    kept.append(text[at:])
    return len(text), removed, runs, b"".join(kept)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): kept is what is left, as bytes, since cuts may split characters."""
    docs = keyed(df, key, text)
    firsts = materialise(originals(docs), "suffixes-firsts")
    repeats = maximal_repeats(docs, firsts, all_occurrences=False)
    listed = repeats.where("owner < doc").groupBy("rk").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    listed = listed.select("rk", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    spans = materialise(firsts.select("rk", F.lit(True).alias("first")).join(listed, "rk", "left"), "suffixes-spans")
    discard(repeats)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_bytes]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [_apply(t.as_py() or b"", c, s or [], e or []) for t, c, s, e in zip(part.column(1).cast(pa.binary()), *(x.to_pylist() for x in part.columns[2:]), strict=True)]
                cols = [part.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())]
                if with_bytes:
                    cols.append(pa.array([r[3] for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    both = docs.join(spans.hint("shuffle_hash"), "rk", "left").select("doc_id", "text", F.col("first").isNull().alias("copy"), "starts", "ends")
    return both.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', kept binary' * with_bytes}")
