"""Where two documents may share a window of `width` units (words or bytes): common first steps of substring dedup.

A window's anchor is the least hash of its `gram`-unit substrings, so equal windows have equal anchors. Only the first of equal texts takes part.
candidates() finds the anchors that more than one text has: a row for each text and distinct anchor goes to the
anchor's partition, but an anchor that several texts of one chunk share is settled there, so a crowded anchor sends
one row a chunk. segments() cuts the documents that have such anchors into runs of windows that share one anchor; equal windows lie in segments with equal anchors, which therefore meet by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, doc_key
from .textkernel import BYTE_VALUES, mix, prefix_hash, range_hash, sliding_hash, sliding_min, text_chunks, word_hashes, words

CHUNK = 1 << 19


@dataclass(frozen=True)
class Unit:
    width: int
    gram: int
    of_words: bool
    seed: int = 0

    def values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each unit, units before each text)."""
        if self.of_words:
            starts, ends, before = words(data, offsets)
            values = word_hashes(data, starts, ends)
        else:
            values, before = BYTE_VALUES[data], offsets
        return (mix(values + np.uint64(self.seed)) if self.seed else values), before

    def runs(self, prefix: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of consecutive windows of one text with one anchor: (first window, windows, text, anchor)."""
        n = len(prefix) - 1
        if n < self.width:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, np.uint64)
        span = self.width - self.gram + 1
        anchor = sliding_min(sliding_hash(prefix, self.gram), span)
        new = np.ones(len(anchor) + 1, bool)
        np.not_equal(anchor[1:], anchor[:-1], out=new[1:-1])
        # The windows of a text end `width` units before its end; those across texts make runs that are left out.
        last = np.maximum(before[1:] - self.width + 1, before[:-1])
        new[before[before <= len(anchor)]] = True
        new[last[last <= len(anchor)]] = True
        heads = np.flatnonzero(new)
        first, size = heads[:-1], np.diff(heads)
        text = np.searchsorted(before, first, "right") - 1
        inside = first < last[text]
        first, size, text = first[inside], size[inside], text[inside]
        # Runs of periodic texts have no end of their own: cut them where no other run could be longer.
        parts = -(-size // span)
        if len(parts) and parts.max() > 1:
            at = np.repeat(np.arange(len(first)), parts)
            k = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            first, size, text = first[at] + span * k, np.minimum(span, size[at] - span * k), text[at]
        return first, size, text, anchor[first]


def keyed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rk, tk, doc_id, doc, text): rk names a row by id and text, tk a text; doc orders documents (a null id comes last)."""
    df = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return df.select(doc_key().alias("rk"), F.xxhash64("text").alias("tk"), "doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), "text")


def originals(docs: DataFrame) -> DataFrame:
    """(tk, rk): the row of each text with the least document. Every other row of the text is a whole copy of it."""
    return docs.groupBy("tk").agg(F.min("doc").alias("doc"), F.min_by("rk", "doc").alias("rk")).select("tk", "rk")


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def candidates(docs: DataFrame, firsts: DataFrame, unit: Unit) -> DataFrame:
    """(rk, ks): the anchors of each text that others may have too, by the row of firsts (see originals()) that stands for it."""

    def spread(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            for a, b, data, offsets in text_chunks(batch.column(1), CHUNK):
                values, before = unit.values(data, offsets)
                _, _, text, k = unit.runs(prefix_hash(values), before)
                if not len(k):
                    continue
                tk = keys[a:b][text]
                order = np.lexsort((tk, k))
                k, tk = k[order], tk[order]
                new = np.r_[True, (k[1:] != k[:-1]) | (tk[1:] != tk[:-1])]
                k, tk = k[new], tk[new]
                head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                size = np.diff(np.r_[head, len(k)])
                shared = np.repeat(size > 1, size)
                witness = k[head[size > 1]]
                # kind 0: to be settled by others' rows with the anchor; 1: settled, dealt by text; 2: says that the anchor is shared
                kind = np.r_[shared.astype(np.int8), np.full(len(witness), 2, np.int8)]
                yield pa.RecordBatch.from_arrays([_longs(np.r_[np.where(shared, mix(tk), k), witness]), _longs(np.r_[k, witness]), _longs(np.r_[tk, np.zeros(len(witness), np.uint64)]), pa.array(kind)], ["key", "k", "tk", "kind"])

    def settle(batches):
        """Rows in order of key, kind and text: an open row counts if its anchor has a witness or another text."""
        held = None  # the last row so far, which the next may confirm
        for batch in batches:
            key, k, tk, kind = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            before = np.zeros(len(key), bool)  # a row before says that the anchor is shared
            if held is not None:
                key, k, tk, kind = (np.r_[h, x] for h, x in zip(held[0], (key, k, tk, kind), strict=True))
                before = np.r_[held[1], before]
            run = np.r_[0, np.cumsum((key[1:] != key[:-1]) | (kind[1:] == 1) | (kind[:-1] == 1))]
            other = np.r_[False, (run[1:] == run[:-1]) & ((tk[1:] != tk[:-1]) | (kind[:-1] == 2))]
            # What is said once in a run holds for all of it that comes later.
            heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            said = np.cumsum(before | other)
            since = said - np.repeat(said[heads] - (before | other)[heads], np.diff(np.r_[heads, len(run)]))
            told = since > 0
            ahead = np.r_[(run[1:] == run[:-1]) & (tk[1:] != tk[:-1]), False]
            take = (kind == 1) | ((kind == 0) & (told | ahead))
            held = ((key[-1:], k[-1:], tk[-1:], kind[-1:]), told[-1:] | (kind[-1:] == 2))
            take[-1] = False
            yield pa.RecordBatch.from_arrays([_longs(tk[take]), _longs(k[take])], ["tk", "k"])
        if held is not None:
            (_, k, tk, kind), told = held
            take = (kind == 1) | ((kind == 0) & told)
            yield pa.RecordBatch.from_arrays([_longs(tk[take]), _longs(k[take])], ["tk", "k"])

    rows = docs.select("tk", "text").mapInArrow(spread, "key long, k long, tk long, kind byte")
    # Witnesses come first, then the open rows of an anchor by text; settled rows lie apart.
    settled = rows.repartition("key").sortWithinPartitions("key", F.expr("CASE kind WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END"), "tk").mapInArrow(settle, "tk long, k long")
    return settled.groupBy("tk").agg(F.collect_set("k").alias("ks")).join(firsts, "tk").select("rk", "ks")


def segments(docs: DataFrame, found: DataFrame, unit: Unit) -> DataFrame:
    """(h, seg, rk, doc, start, payload): runs of windows with the shared anchor h; equal runs have equal payloads and seg.

    payload: for words the 64-bit hash of each window, for bytes the bytes themselves.
    """

    def run(batches):
        for batch in batches:
            rk, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            ends, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for a, b, data, offsets in text_chunks(batch.column(2), CHUNK):
                values, before = unit.values(data, offsets)
                prefix = prefix_hash(values)
                begin, n, text, k = unit.runs(prefix, before)
                named = lambda key, row: mix(key ^ mix(row.astype(np.uint64) + np.uint64(1)))
                known = named(flat[ends[a] : ends[b]], np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])))
                keep = np.isin(named(k, text), known)
                begin, n, text, k = begin[keep], n[keep], text[keep], k[keep]
                if not len(begin):
                    continue
                long = n + unit.width - 1
                seg = range_hash(prefix, begin, begin + long)
                at = np.r_[0, np.cumsum(n if unit.of_words else long)]
                where = np.arange(at[-1]) + np.repeat(begin - at[:-1], np.diff(at))
                if unit.of_words:
                    raw, sizes = range_hash(prefix, where, where + unit.width).tobytes(), 8 * n
                else:
                    raw, sizes = data[where].tobytes(), long
                payload = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32).tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([_longs(k), _longs(seg), _longs(rk[a:b][text]), _longs(doc[a:b][text]), _longs(begin - before[text]), payload], ["h", "seg", "rk", "doc", "start", "payload"])

    both = docs.select("rk", "doc", "text").join(found.hint("shuffle_hash"), "rk").select("rk", "doc", "text", "ks")
    return both.mapInArrow(run, "h long, seg long, rk long, doc long, start long, payload binary")


def distinct_segments(cut: DataFrame) -> DataFrame:
    """(h, seg, payload, lo, hi, n): each different segment with its least and greatest document and its occurrences."""
    return cut.groupBy("h", "seg", "payload").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n"))


def by_anchor(distinct: DataFrame, work, schema: str) -> DataFrame:
    """Apply work(columns as numpy arrays, payloads as a pyarrow array) to blocks of whole anchors."""

    def run(batches):
        held = None

        def flush(t):
            for out in work(t):
                if out.num_rows:
                    yield out

        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            h = t.column("h").to_numpy()
            last = int(np.searchsorted(h, h[-1], "left")) if len(h) else 0
            held = t.slice(last)
            if last:
                yield from flush(t.slice(0, last).combine_chunks())
        if held is not None and held.num_rows:
            yield from flush(held.combine_chunks())

    return distinct.repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)
