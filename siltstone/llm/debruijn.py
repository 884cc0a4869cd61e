"""Substring dedup by De Bruijn compaction of repeated token windows.

Edges are windows of WIDTH words. Equal texts are one text of their least document. Only windows whose anchor several documents have are looked at (see repeats). Within
one anchor's partition edges that always follow each other are compacted at once into nonbranching pieces; pieces are
glued into longer paths by Spark joins wherever a piece and its successor have each other as their only neighbours.
An anchor with more than CROWD different segments is no one task's work: its edges are counted and its pieces are single edges, which
the same joins glue.
Source coordinates verify the paths: every occurrence's words are digested from its document and must agree with those
of the path's other occurrences; otherwise hashes collided and all is done again with other ones.

A word is removed where a path covers it that also lies in a document of a smaller id. Null and empty texts have no
words. Rows of one id count as one document, which never has a smaller id than itself; a null id comes last. Repeated
rows repeat their results. Extra columns are dropped. A text must fit into a task's memory about a hundredfold.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .repeats import Unit, _longs, by_anchor, candidates, distinct_segments, keyed, originals, segments

WIDTH, GRAM = 13, 7
CROWD, SALTS = 1_000, 8
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _compact(t: pa.Table):
    """Pieces of the distinct segments of some anchors: maximal runs of edges without a branch, if documents share them."""
    h, seg, lo, hi, n = (t.column(c).to_numpy() for c in ("h", "seg", "lo", "hi", "n"))
    payload = t.column("payload").combine_chunks()
    payload = payload.chunk(0) if isinstance(payload, pa.ChunkedArray) else payload
    sizes = np.diff(np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + len(payload) + 1]) // 8
    base = int(np.frombuffer(payload.buffers()[1], np.int32)[payload.offset])
    edge = np.frombuffer(payload.buffers()[2], np.uint64, int(sizes.sum()), base)
    of = np.repeat(np.arange(len(h)), sizes)
    _, name = np.unique(edge, return_inverse=True)
    order = np.argsort(name, kind="stable")
    heads = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
    least, most = np.minimum.reduceat(lo[of][order], heads), np.maximum.reduceat(hi[of][order], heads)
    total = np.bincount(name, n[of])
    inner = np.flatnonzero(of[1:] == of[:-1])
    pair = name[inner].astype(np.int64) * len(heads) + name[inner + 1]
    _, which = np.unique(pair, return_inverse=True)
    both = np.bincount(which, n[of[inner]])[which] if len(inner) else np.zeros(0)
    linked = np.zeros(len(edge), bool)  # to the edge before
    linked[inner + 1] = (both == total[name[inner]]) & (both == total[name[inner + 1]])
    start = np.flatnonzero(~linked)
    length = np.diff(np.r_[start, len(edge)])
    shared = least[name[start]] < most[name[start]]
    start, length = start[shared], length[shared]
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    yield pa.RecordBatch.from_arrays([_longs(h[of[start]]), _longs(seg[of[start]]), _longs(start - first[of[start]]), _longs(length), _longs(least[name[start]]), _longs(edge[start])], ["h", "seg", "skip", "n", "owner", "edge"])


_LOCAL = "h long, seg long, skip long, n long, owner long, edge long"


def _edges(batches):
    """(h, seg, skip, edge, lo, hi) of every edge of segments."""
    for batch in batches:
        payload = batch.column(2)
        at = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + len(payload) + 1].astype(np.int64)
        sizes = np.diff(at) // 8
        of = np.repeat(np.arange(len(sizes)), sizes)
        skip = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        edge = np.frombuffer(payload.buffers()[2], np.uint8)[at[0] : at[-1]].copy().view(np.uint64) if len(of) else np.zeros(0, np.uint64)
        h, seg, lo, hi = (batch.column(c).to_numpy()[of] for c in (0, 1, 3, 4))
        yield pa.RecordBatch.from_arrays([_longs(x) for x in (h, seg, skip, edge, lo, hi)], ["h", "seg", "skip", "edge", "lo", "hi"])


def crowded(distinct: DataFrame) -> DataFrame:
    """The pieces, one edge each, of distinct segments of crowded anchors: edges are counted before the shuffle, and their rows join the counts by salts."""
    edges = materialise(distinct.select("h", "seg", "payload", "lo", "hi").mapInArrow(_edges, "h long, seg long, skip long, edge long, lo long, hi long"), "debruijn-crowd")
    shared = edges.groupBy("h", "edge").agg(F.min("lo").alias("owner"), F.max("hi").alias("most")).where("owner < most")
    shared = shared.select("h", "edge", "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    rows = edges.withColumn("salt", F.pmod("seg", F.lit(SALTS)).cast("long")).join(shared, ["h", "edge", "salt"])
    out = materialise(rows.select("h", "seg", "skip", F.lit(1).cast("long").alias("n"), "owner", "edge"), "debruijn-crowd-pieces")
    discard(edges)
    return out


def pieces(docs: DataFrame, firsts: DataFrame, unit: Unit, crowd: int = CROWD) -> DataFrame:
    """(rk, doc, start, n, owner, edge): occurrences of nonbranching pieces that several texts have."""
    found = materialise(candidates(docs, firsts, unit), "debruijn-anchors")
    cut = materialise(segments(docs, found, unit), "debruijn-segments")
    discard(found)
    distinct = materialise(distinct_segments(cut), "debruijn-distinct")
    many = materialise(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > crowd).select("h"), "debruijn-crowded")
    local = materialise(by_anchor(distinct.join(many, "h", "left_anti"), _compact, _LOCAL), "debruijn-local")
    beside = crowded(distinct.join(many, "h", "left_semi"))
    discard(distinct)
    both, local = (local, beside), local.unionByName(beside)
    out = materialise(cut.select("h", "seg", "rk", "doc", "start").join(local, ["h", "seg"]).select("rk", "doc", (F.col("start") + F.col("skip")).alias("start"), "n", "owner", "edge"), "debruijn-pieces")
    discard(cut, many, *both)
    return out


_FIELDS = ("start", "n", "owner", "edge", "glued")


def glue(parts: DataFrame) -> DataFrame:
    """(rk, start, n, owner, edge, glued): each document's pieces in order as lists; glued is 1 where the next one continues the path.

    A piece and its successor are one path if each occurrence of either is next to one of the other.
    """
    order = Window.partitionBy("rk").orderBy("start", "edge")
    follows = F.lead("start").over(order) == F.col("start") + F.col("n")
    chain = materialise(parts.select("rk", "start", "n", "owner", "edge", F.when(follows, F.lead("edge").over(order)).alias("next")), "debruijn-chain")
    counts = chain.groupBy("edge").agg(F.count(F.lit(1)).alias("c"))
    pairs = chain.where("next IS NOT NULL").groupBy("edge", "next").agg(F.count(F.lit(1)).alias("c"))
    links = pairs.join(counts, ["edge", "c"], "left_semi").join(counts.withColumnRenamed("edge", "next"), ["next", "c"], "left_semi").select("edge", "next", F.lit(True).alias("glued"))
    joined = chain.join(links, ["edge", "next"], "left")
    listed = joined.groupBy("rk").agg(F.array_sort(F.collect_list(F.struct("start", "n", "owner", "edge", F.coalesce("glued", F.lit(False)).cast("long").alias("glued")))).alias("spans"))
    return listed.select("rk", *[F.col(f"spans.{f}").alias(f) for f in _FIELDS])


_PATHS_SQL = "array<struct<path bigint, start bigint, n_words bigint, first_doc bigint, digest bigint>>"


def _paths(start, n, owner, edge, glued) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(path, first word, end word, first document) of a document's paths from its pieces in order."""
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    goes_on = np.r_[False, (glued[:-1] > 0) & (start[1:] == start[:-1] + n[:-1])]
    head = np.flatnonzero(~goes_on)
    last = np.r_[head[1:], len(start)] - 1
    return edge[head], start[head], start[last] + n[last] + WIDTH - 1, owner[head]


def _apply(text: bytes, doc: int, copy: bool, paths: tuple) -> tuple[int, int, bytes, list[int]]:
    """(words, words removed, what is left, digest of each path's words); a copy is one path from end to end."""
    found = _WORD.findall(text)
    if copy:
        return len(found), len(found) if len(found) >= WIDTH else 0, b"" if len(found) >= WIDTH else b" ".join(found), []
    _, start, end, owner = paths
    if not len(start):
        return len(found), 0, b" ".join(found), []
    gone = np.zeros(len(found) + 1, np.int64)
    mine = owner < doc
    np.add.at(gone, start[mine], 1)
    np.add.at(gone, end[mine], -1)
    removed = np.cumsum(gone[:-1]) > 0
    digest = hashlib.blake2b
    marks = [int.from_bytes(digest(b" ".join(found[i:j]), digest_size=8).digest(), "big", signed=True) for i, j in zip(start.tolist(), end.tolist(), strict=True)]
    return len(found), int(removed.sum()), b" ".join([w for w, r in zip(found, removed.tolist(), strict=True) if not r]), marks


def _results(docs: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """spans: rk of every text's first row, with its pieces if it has any."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [c.fill_null([]) for c in part.columns[4:]]
                cuts = lists[0].offsets.to_numpy().astype(np.int64)
                flat = [c.values.to_numpy(zero_copy_only=False) for c in lists]
                rows, paths, sizes = [], [], []
                for i, (t, d, copy) in enumerate(zip(part.column(2).cast(pa.binary()), part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    p = _paths(*(x[cuts[i] : cuts[i + 1]] for x in flat))
                    words, removed, kept, marks = _apply(t.as_py() or b"", d, copy, p)
                    rows.append((words, removed, hashlib.sha256(kept).hexdigest(), kept))
                    sizes.append(len(marks))
                    paths.append((p[0], p[1], p[2] - p[1], p[3], np.array(marks, np.int64)))
                inner = pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in paths]), pa.int64()) for k in range(5)], ["path", "start", "n_words", "first_doc", "digest"])
                cols = [part.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), inner)]
                if with_text:
                    cols.append(pa.array([r[3].decode() for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "paths", *["kept_text"] * with_text])

    both = docs.join(spans.hint("shuffle_hash"), "rk", "left").select("doc_id", "doc", "text", F.col("first").isNull().alias("copy"), *_FIELDS)
    return both.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, paths {_PATHS_SQL}{', kept_text string' * with_text}")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, paths, kept_text): paths are the document's repeated paths with coordinates."""
    docs = keyed(df, key, text)
    firsts = materialise(originals(docs), "debruijn-firsts")
    for seed in range(4):
        parts = pieces(docs, firsts, Unit(WIDTH, GRAM, True, seed), crowd)
        spans = materialise(firsts.select("rk", F.lit(True).alias("first")).join(glue(parts), "rk", "left"), "debruijn-spans")
        out = materialise(_results(docs, spans, with_text), "debruijn-results")
        discard(parts, spans)
        told = out.select(F.explode("paths").alias("p")).groupBy("p.path", "p.n_words").agg(F.min("p.digest").alias("a"), F.max("p.digest").alias("b"))
        if told.where("a <> b").isEmpty():
            return out
        discard(out)
    raise RuntimeError("hashes of windows collided under every seed")
