"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; two link at RADIUS or fewer differing bits. It is cut into SEGMENTS equal segments, so
linked fingerprints differ by at most RADIUS // SEGMENTS bits in one of them: each fingerprint probes the table of that
segment with every value of that small Hamming ball, and whole distances are verified. Only distinct fingerprints take
part, so copies cost nothing. Those with an equal segment are first linked to the least of them; the balls then make
links only between fingerprints that nothing joins yet, so a crowd doesn't pair off with itself. Distances are
verified inside the join, so a crowded table value makes comparisons but only links as rows.

Texts: null and empty have fingerprint zero; rows of one id count as one document's versions and each keeps its own
row. A null doc_id keeps its fingerprint and takes part under the largest id. Extra columns are dropped.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, materialise
from .graph import components

SHINGLE, SEED, RADIUS, SEGMENTS = 3, 42, 3, 2
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes) -> int:
    """Majority of the bits of XXH64 over three-word shingles of the text with A-Z lowered; 0 for no words."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(s, SEED) for s in shingles])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    set_bits = bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)
    return int.from_bytes(np.packbits(set_bits).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            marks = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], [key, "fp"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, fp long")


def _values(segment: int, ball: bool) -> list:
    """Keys of a fingerprint in the table of one segment: its own value, or every value of the Hamming ball around it."""
    width = 64 // SEGMENTS
    own = F.shiftrightunsigned(F.col("fp"), segment * width).bitwiseAND(F.lit((1 << width) - 1))
    tag = F.lit(segment << (width + 1) if width < 60 else 0).cast("long")
    if not ball:
        return [own.bitwiseOR(tag)]
    if RADIUS // SEGMENTS != 1:
        raise ValueError("balls of radius 1 are enumerated")
    return [own.bitwiseXOR(F.lit(1 << b if b >= 0 else 0).cast("long")).bitwiseOR(tag) for b in range(-1, width)]


def _near(x: str, y: str):
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= RADIUS


def star_links(marks: DataFrame) -> DataFrame:
    """(a, b): documents of each fingerprint and of the least one with an equal segment, if near: n links for a crowd of n."""
    own = marks.select("fp", "first", F.explode(F.array(*[v for s in range(SEGMENTS) for v in _values(s, False)])).alias("k"))
    least = own.withColumn("m", F.min(F.struct("fp", "first")).over(Window.partitionBy("k"))).select("fp", "first", F.col("m.fp").alias("other"), F.col("m.first").alias("least"))
    return least.where((F.col("fp") != F.col("other")) & _near("fp", "other")).select(F.col("first").alias("a"), F.col("least").alias("b"))


def links(marks: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): documents of fingerprints within RADIUS bits that groups (id, root) doesn't join yet."""
    named = marks.join(groups, marks["first"] == groups["id"], "left").select("fp", "first", F.coalesce("root", "first").alias("g"))
    probe = named.select("fp", F.col("first").alias("a"), F.col("g").alias("ga"), F.explode(F.array(*[v for s in range(SEGMENTS) for v in _values(s, True)])).alias("k"))
    table = named.select(F.col("fp").alias("other"), F.col("first").alias("b"), F.col("g").alias("gb"), F.explode(F.array(*[v for s in range(SEGMENTS) for v in _values(s, False)])).alias("k"))
    return probe.join(table, (probe.k == table.k) & (F.col("fp") < F.col("other")) & (F.col("ga") != F.col("gb")) & _near("fp", "other")).select("a", "b")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): component is the least key reachable over links, the row's own included."""
    marked = materialise(fingerprints(df, key, text), "simhash-marks")
    marks = materialise(marked.groupBy("fp").agg(F.min(F.coalesce(key, F.lit(LAST_ID))).alias("first")), "simhash-distinct")
    stars = materialise(star_links(marks).distinct(), "simhash-stars")
    edges = stars.unionByName(links(marks, components(stars, "simhash-star-components")))
    roots = components(edges, "simhash-components")
    named = marks.join(roots, marks["first"] == roots["id"], "left").select("fp", F.coalesce("root", "first").alias("component"))
    return marked.join(named, "fp").select(key, "fp", "component")
