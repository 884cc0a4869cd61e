"""Benchmark decontamination by template canonicalisation.

Texts become tokens. In the plain channel a token is its lower-case form. In the template channel numbers, units after
numbers and names (capitalised inside a sentence; neighbours make one name) become typed placeholders. Windows of WINDOW
tokens of both channels are hash-joined with those of the benchmark; template windows need LITERALS words besides their
placeholders. Where a template window matches, benchmark and document values of its placeholders are paired: along one
alignment each benchmark value must stand for one document value and the other way round, else the alignment does not
count. A document is contaminated by an item if windows that count cover COVER of the item's tokens in one channel.

The benchmark's windows are counted first. Up to INDEX_ROWS of them their hashes go to every executor and documents
send only windows that occur there; above that all windows meet in the join. Both ways give the same rows.

Items of fewer than LEAST tokens are not looked for; items shorter than a window are windows of their own. Null and
empty texts have no windows, an empty benchmark no hits. Rows of one id count together; equal rows give one hit. Null
ids of documents or items are kept as nulls. Extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, materialise
from .repeats import _longs
from .textkernel import BYTE_VALUES, mix, prefix_hash, range_hash, text_chunks

WINDOW, LITERALS, LEAST, COVER = 8, 5, 5, 0.4
#: Benchmark windows (8 bytes each) that are sent to every executor, at most.
INDEX_ROWS = 2_000_000
CHUNK = 1 << 18

# Units that may follow a number.
UNITS = """m cm mm km nm g kg mg t lb lbs oz l ml s sec second seconds ms min minute minutes h hr hour hours day days week weeks
month months year years mile miles foot feet inch inches yard yards mph kmh hz khz mhz ghz b kb mb gb tb v w kw mw kwh a j kj pa
k c f usd eur gbp dollar dollars cent cents euro euros pound pounds percent meter meters metre metres kilometer kilometers
kilometre kilometres gram grams kilogram kilograms liter liters litre litres degree degrees""".split()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.array([1 if c >= 128 or chr(c).isalpha() else 2 if chr(c).isdigit() else 0 for c in range(256)], np.int8)
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in '.!?:;"\n\r()[]{}|*#']] = True
_SLOT = mix(np.array([101, 102, 103], np.uint64))  # number, unit, name


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return range_hash(prefix_hash(BYTE_VALUES[data]), np.array([0]), np.array([len(data)]))[0]


_UNIT_HASHES = np.array([_hash_of(u) for u in UNITS], np.uint64)


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Both channels of texts: ((hashes, None, tokens before each text), (hashes, slot values or 0, tokens before each text))."""
    n = len(data)
    kind = _KIND[data]
    if n > 2:
        inner = np.flatnonzero(((data[1:-1] == 46) | (data[1:-1] == 44)) & (kind[:-2] == 2) & (kind[2:] == 2)) + 1
        kind[inner] = 2
    low = _LOWER[data]
    accent = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1 if n > 1 else np.zeros(0, np.int64)
    low[accent] += 32
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    some = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[some], ends[some]
    before = np.searchsorted(starts, offsets)
    plain = range_hash(prefix_hash(BYTE_VALUES[low]), starts, ends)
    number = kind[starts] == 2
    breaks = np.r_[0, np.cumsum(_BREAK[data])]
    fresh = np.ones(len(starts), bool)  # begins a sentence or a text
    fresh[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
    fresh[before[:-1][before[:-1] < len(starts)]] = True
    upper = np.zeros(n + 1, bool)
    upper[:n] = (data >= 65) & (data <= 90)
    upper[accent - 1] = True
    name = upper[starts] & ~fresh & (ends - starts > 1) & ~number
    after = np.r_[False, number[:-1]] if len(starts) else number
    unit = after & ~fresh & ~number & np.isin(plain, _UNIT_HASHES)
    name &= ~unit
    sort = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))
    goes_on = name & np.r_[False, name[:-1]] if len(starts) else name  # joins the name before
    heads = np.flatnonzero(~goes_on)
    value = range_hash(prefix_hash(plain), heads, np.r_[heads[1:], len(starts)]) if len(heads) else np.zeros(0, np.uint64)
    sort = sort[heads]
    template = np.where(sort > 0, _SLOT[np.maximum(sort, 1) - 1], plain[heads])
    return (plain, None, before), (template, np.where(sort > 0, value, np.uint64(0)), np.searchsorted(heads, before))


def _windows(channel: int, hashes, slots, before, w: int):
    """(text, place, hash, slot rows) of windows of w tokens that may count."""
    n = len(hashes) - w + 1
    if n <= 0:
        return None
    at = np.arange(n)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))[:n]
    ok = at + w <= before[1:][text]
    if channel:
        filled = np.r_[0, np.cumsum(slots != 0)]
        k = filled[w:] - filled[:-w]
        ok &= (k > 0) & (w - k >= min(LITERALS, w - 1))
    at, text = at[ok], text[ok]
    h = mix(range_hash(prefix_hash(hashes), at, at + w) + np.uint64(2 * w + channel))
    return text, at, h


COLUMNS = "h long, key long, channel int, w int, place int, slots array<bigint>"


def _rows(key, channel, w, at, before, text, h, slots):
    if channel:
        flat = slots[at[:, None] + np.arange(w)].ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * w, pa.int32()), _longs(flat))
    else:
        lists = pa.array([None] * len(at), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([_longs(h), key, pa.array(np.full(len(at), channel, np.int32)), pa.array(np.full(len(at), w, np.int32)), pa.array((at - before[text]).astype(np.int32)), lists], ["h", "key", "channel", "w", "place", "slots"])


def benchmark_windows(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(h, key, channel, w, place, slots, n): windows of items; n is the item's tokens in the channel."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1), CHUNK):
                for channel, (hashes, slots, before) in enumerate(tokens(data, offsets)):
                    size = np.diff(before)
                    for w in range(LEAST, WINDOW + 1):
                        found = _windows(channel, hashes, slots, before, w)
                        if found is None:
                            continue
                        text_, at, h = found
                        own = size[text_] == w if w < WINDOW else size[text_] >= w
                        text_, at, h = text_[own], at[own], h[own]
                        r = _rows(batch.column(0).slice(a, b - a).take(pa.array(text_)), channel, w, at, before, text_, h, slots)
                        yield pa.RecordBatch.from_arrays([*r.columns, pa.array(size[text_].astype(np.int32))], [*r.schema.names, "n"])

    return benchmark.select(F.col(key).cast("long"), text).mapInArrow(run, f"{COLUMNS}, n int").distinct()


def document_windows(docs: DataFrame, lengths: list[int], index: np.ndarray | None) -> DataFrame:
    """(h, key, ...): windows of documents of these lengths; with an index only those it has. docs: rk, text."""

    def run(batches):
        for batch in batches:
            rk = batch.column(0).to_numpy()
            for a, b, data, offsets in text_chunks(batch.column(1), CHUNK):
                for channel, (hashes, slots, before) in enumerate(tokens(data, offsets)):
                    for w in lengths:
                        found = _windows(channel, hashes, slots, before, w)
                        if found is None:
                            continue
                        text, at, h = found
                        if index is not None:
                            place = np.minimum(np.searchsorted(index, h), len(index) - 1)
                            hit = index[place] == h
                            text, at, h = text[hit], at[hit], h[hit]
                        if len(h):
                            yield _rows(_longs(rk[a:b][text]), channel, w, at, before, text, h, slots)

    return docs.select("rk", "text").mapInArrow(run, COLUMNS)


def hits(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(rk, doc_id, item_id, n_windows, plain_cover, template_cover, kind): documents by the items that contaminate them."""
    spark = df.sparkSession
    theirs = materialise(benchmark_windows(benchmark, item, item_text), "decontam-benchmark")
    sizes = {r["w"]: r["c"] for r in theirs.groupBy("w").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most four rows
    index = None
    if sum(sizes.values()) <= INDEX_ROWS:
        index = np.unique(theirs.select("h").toArrow().column(0).to_numpy().view(np.uint64))
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn("rk", doc_key())
    if not sizes:
        return spark.createDataFrame([], f"rk long, doc_id {df.schema[key].dataType.simpleString()}, item_id long, n_windows long, plain_cover double, template_cover double, kind string")
    ours = document_windows(docs, sorted(sizes), index)
    m = ours.join(theirs.select("h", F.col("key").alias("item_id"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "n", F.col("w").alias("item_w"), F.col("channel").alias("item_channel")), "h").where("w = item_w AND channel = item_channel")
    pairs = F.expr("filter(arrays_zip(item_slots, slots), p -> p.item_slots <> 0)")
    m = m.select(F.col("key").alias("rk"), "item_id", "channel", "w", "n", "item_place", (F.col("place") - F.col("item_place")).alias("line"), F.coalesce(pairs, F.expr("CAST(array() AS array<struct<item_slots: bigint, slots: bigint>>)")).alias("pairs"))
    aligned = m.groupBy("rk", "item_id", "channel", "w", "n", "line").agg(F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    one_to_one = "size(pairs) = size(array_distinct(pairs.item_slots)) AND size(pairs) = size(array_distinct(pairs.slots))"
    counted = aligned.where(one_to_one).groupBy("rk", "item_id", "channel", "w", "n").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.bool_or(F.expr("exists(pairs, p -> p.item_slots <> p.slots)")).alias("changed"))
    cover = F.expr("size(array_distinct(flatten(transform(places, p -> sequence(p, p + w - 1))))) / n")
    shares = counted.withColumn("cover", cover).groupBy("rk", "item_id").agg(
        F.sum(F.size("places").cast("long")).alias("n_windows"),
        F.coalesce(F.max(F.when(F.col("channel") == 0, F.col("cover"))), F.lit(0.0)).alias("plain_cover"),
        F.coalesce(F.max(F.when(F.col("channel") == 1, F.col("cover"))), F.lit(0.0)).alias("template_cover"),
        F.coalesce(F.bool_or("changed"), F.lit(False)).alias("changed"),
    )
    found = shares.where(F.greatest("plain_cover", "template_cover") >= COVER)
    kind = F.when(F.col("plain_cover") >= COVER, "verbatim").when(F.col("changed"), "reparameterised").otherwise("template")
    ids = docs.select("rk", "doc_id")
    return found.join(ids, "rk").select("rk", "doc_id", "item_id", "n_windows", "plain_cover", "template_cover", kind.alias("kind")).distinct()


def without_contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of df whose text no benchmark item contaminates, all columns as they were."""
    bad = hits(df, benchmark).select("rk").distinct()
    return df.withColumn("__rk", doc_key()).join(bad.withColumnRenamed("rk", "__rk").hint("shuffle_hash"), "__rk", "left_anti").drop("__rk")
