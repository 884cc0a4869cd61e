"""Fuzzy line dedup: pigeonhole blocks of normalised lines, edit similarity, one occurrence per connected group.

A line is normalised to lower-case words with digits as 0 and marks as space. Lines with equal words are one node, of
any length; lines without words are never touched. Lines of MIN_WORDS words or more are also joined fuzzily. The bits
of a SimHash are no help there: a line with one word in five changed differs in about 13 of 64 bits, so no block that is
long enough to tell lines apart stays whole. Blocks are therefore words: of each line the RARE rarest (by counts over
all texts), and lines that keep two of them share a block of two. Alike lines keep two of three of them on average at the least similarity; the tests
measure what share of all alike pairs that finds. A block of common words alone takes three.

Each node is first paired with one node of each of its blocks alone, which joins crowds of near lines by few checks; then nodes of one block and different groups. Lengths and parities of words bound the distance of a pair before
texts are fetched, then word edit similarity (1 - insertions and deletions over both lengths) of SIMILARITY or more
decides. Groups are connected components. Of each group the occurrence of the smallest document and line stays; the
other lines go, and what is left is joined by line feeds as before.

Null texts stay null and empty ones empty: they have no lines to lose. Texts of one id count as separate rows of one
document; repeated rows lose their repeated lines like any other, except that rows equal in id and text keep the same
lines. A null doc_id comes last. Other columns are kept, but n_lines and n_removed are replaced.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, discard, doc_key, materialise
from .graph import components
from .repeats import _longs
from .textkernel import mix, prefix_hash, range_hash, text_chunks, word_hashes, words

MIN_WORDS, SIMILARITY = 5, 0.8
CHUNK = 1 << 18
#: Words of a line that make its blocks.
RARE = 6
#: Counters of words, and how many are sent at once.
BUCKETS, SLICE = 1 << 20, 1 << 12
#: A word is common if it is one of so many words, and occurs so often at least.
COMMON_SHARE, COMMON_LEAST, FREQUENT = 1 << 14, 64, 128
#: Nodes whose blocks are made and compared at once, and about how many blocks meet in one bucket.
BLOCK_ROWS, BUCKET_BLOCKS = 1 << 16, 100_000
NONE, _NO_WORD = np.uint64((1 << 64) - 1), -1

#: What a byte becomes: ASCII letters lower-case, digits 0, other ASCII a space; bytes of other characters stay.
_PLAIN = np.array([c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 48 if chr(c).isdigit() else 32 for c in range(256)], np.uint8)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of lines, lines before each text): a text of n line feeds has n + 1 lines; the line feed begins the next one."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    before = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
    return np.r_[starts, len(data)], before


def word_classes(docs: DataFrame) -> np.ndarray:
    """A byte for each of BUCKETS buckets of words: twice the logarithm of how often they occur, and FREQUENT for common ones.

    All texts are counted. Every task adds up its own counters and sends them in slices; the driver gets one sum a slice.
    """

    def count(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), CHUNK):
                plain = _PLAIN[data]
                starts, ends, _ = words(plain, offsets)
                np.add.at(counts, _bucket(word_hashes(plain, starts, ends)), 1)
        for i in np.flatnonzero(counts.reshape(-1, SLICE).any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([counts[i * SLICE : (i + 1) * SLICE].tobytes()], pa.binary())], ["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(raw, np.int64)
        for i, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    found = docs.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).toArrow()
    counts = np.zeros((BUCKETS // SLICE, SLICE), np.int64)
    for i, raw in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        counts[i] = np.frombuffer(raw, np.int64)
    counts = counts.ravel()
    common = counts > max(int(counts.sum()) // COMMON_SHARE, COMMON_LEAST)
    return (np.log2(counts + 1) * 2).astype(np.uint8) + np.where(common, FREQUENT, 0).astype(np.uint8)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def _rarest(keys: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The RARE least different keys of each line in order, NONE where a line has fewer. heads: first key of each line."""
    left, out = keys.copy(), []
    for _ in range(RARE):
        out.append(np.minimum.reduceat(left, heads) if len(heads) else left)
        left[left == np.repeat(out[-1], sizes)] = NONE
    return out


_COLUMNS = ["rk", "doc", "line", "node"]
_RARE_COLUMNS = [f"w{i}" for i in range(RARE)]


def marked_lines(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """(rk, doc, line, node, w0, ...) of all lines with words; docs: rk, doc, text.

    node: a hash of the words. w0, ...: the rarest words, negative if common; none for lines of fewer than MIN_WORDS words.
    """

    def run(batches):
        for batch in batches:
            rk, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, data, offsets in text_chunks(batch.column(2), CHUNK):
                edges, before = _lines(data, offsets)
                plain = _PLAIN[data]
                starts, ends, first = words(plain, edges)
                hashes = word_hashes(plain, starts, ends)
                size = np.diff(first)
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                node, n = range_hash(prefix_hash(hashes), first[:-1], first[1:])[some], size[some]
                text = np.searchsorted(before, some, "right") - 1
                keys = (classes[_bucket(hashes)].astype(np.uint64) << np.uint64(56)) | (mix(hashes) >> np.uint64(8))
                rarest = _rarest(keys, first[:-1][some], n)
                # One word in another's place leaves two of the four rarest: so many are enough below ten words.
                enough = (n < 2 * MIN_WORDS) & (rarest[3] >> np.uint64(63) == 0)
                rare = [pa.array(w.view(np.int64), pa.int64(), mask=(n < MIN_WORDS) | (w == NONE) | (enough & (i > 3))) for i, w in enumerate(rarest)]
                yield pa.RecordBatch.from_arrays([_longs(rk[a:b][text]), _longs(doc[a:b][text]), _longs(some - before[text]), _longs(node), *rare], _COLUMNS + _RARE_COLUMNS)

    return docs.select("rk", "doc", "text").mapInArrow(run, ", ".join(f"{c} long" for c in _COLUMNS + _RARE_COLUMNS))


def _keys(node: np.ndarray, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(k, node): the blocks of nodes, two of their rarest words w each; three where all of them are common words.

    Lines of few different words also have their single words and pairs as blocks.
    """
    ks, of = [], []

    def put(rows, i, *others):
        k = w[i][rows].view(np.uint64)
        for j in others:
            k = mix(k ^ mix(w[j][rows].view(np.uint64) + np.uint64(len(others))))
        ks.append(k if others else mix(k))
        of.append(node[rows])

    for i, j in combinations(range(RARE), 2):  # the rarer of two comes first
        put(np.flatnonzero((w[i] >= 0) & (w[j] != _NO_WORD)), i, j)
    common = [(x < 0) & (x != _NO_WORD) for x in w]
    for i, j, k in combinations(range(RARE), 3):
        put(np.flatnonzero(common[i] & (w[k] != _NO_WORD)), i, j, k)
    few = w[3] == _NO_WORD
    for i in range(3):
        put(np.flatnonzero(few & (w[i] != _NO_WORD)), i)
    for i, j in combinations(range(3), 2):
        put(np.flatnonzero(few & common[i] & (w[j] != _NO_WORD)), i, j)
    return np.concatenate(ks), np.concatenate(of)


def _cells(batches, buckets: int):
    """(bucket, open, settled): blocks of BLOCK_ROWS nodes at once by bucket, as packed (k, node) and (k, node, lo).

    A block that several of these nodes have is settled: lo is one of them, and it alone is open, twice, which says that the block is shared.
    """

    def pack(parts):
        node, *w = (np.concatenate(x) for x in zip(*parts, strict=True))
        k, node = _keys(node, w)
        if not len(k):
            return
        order = np.argsort(k)
        k, node = k[order], node[order]
        head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[head, len(k)])
        lo, first = np.repeat(node[head], size), np.zeros(len(k), bool)
        first[head] = True
        done, twice = np.flatnonzero(~first), head[size > 1]
        sent = np.r_[head, twice]
        columns = []
        # Settled blocks may lie anywhere: by node, so that none is crowded.
        for key, cols in ((k[sent], (k[sent], node[sent].view(np.uint64))), (mix(node[done].view(np.uint64)), tuple(x.view(np.uint64) for x in (k[done], node[done], lo[done])))):
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            packed = np.stack([x[order] for x in cols], axis=1)
            ends = np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets))] * 8 * len(cols)
            columns.append(pa.Array.from_buffers(pa.large_binary(), buckets, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(packed.tobytes())]).cast(pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets), pa.int64()), *columns], ["bucket", "open", "settled"])

    held, n = [], 0
    for batch in batches:
        held.append([batch.column(0).to_numpy(), *(c.fill_null(_NO_WORD).to_numpy() for c in batch.columns[1:])])
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield from pack(held)
            held, n = [], 0
    if held:
        yield from pack(held)


def _settle(batches):
    """(k, node, lo) of the blocks of several nodes; rows come by bucket."""

    def flush(cells):
        settled = np.frombuffer(b"".join(c[1] for c in cells), np.int64).reshape(-1, 3)
        k, node = np.frombuffer(b"".join(c[0] for c in cells), np.int64).reshape(-1, 2).T
        order = np.argsort(k)
        same = k[order][1:] == k[order][:-1]
        some = order[np.r_[same, False] | np.r_[False, same]] if len(k) else order
        k, node = k[some], node[some]
        order = np.lexsort((node, k))
        k, node = k[order], node[order]
        new = np.r_[True, k[1:] != k[:-1]][: len(k)]
        lo = np.repeat(node[new], np.diff(np.r_[np.flatnonzero(new), len(k)]))
        once = new | np.r_[True, node[1:] != node[:-1]][: len(k)]
        return pa.RecordBatch.from_arrays([pa.array(np.r_[x[once], settled[:, i]]) for i, x in enumerate((k, node, lo))], ["k", "node", "lo"])

    now, held = None, []
    for batch in batches:
        for bucket, *cell in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and held:
                yield flush(held)
                held = []
            now = bucket
            held.append(cell)
    if held:
        yield flush(held)


def blocks(nodes: DataFrame) -> DataFrame:
    """(k, node, lo): the blocks that several nodes have, each node with a node lo of the same block.

    Blocks meet by buckets, whose number grows with that of nodes. A block that several nodes of one batch have is settled
    there, so a crowded one sends one row a batch to its bucket.
    """
    buckets = 1 + nodes.count() * len(list(combinations(range(RARE), 2))) // BUCKET_BLOCKS
    rows = nodes.select("node", *_RARE_COLUMNS).mapInArrow(lambda batches: _cells(batches, buckets), "bucket long, open binary, settled binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_settle, "k long, node long, lo long")


def _may_be_alike():
    """Whether lengths and parities of a and b allow SIMILARITY: every insertion or deletion changes both by one."""
    most = F.floor((F.col("na") + F.col("nb")) * F.lit(1 - SIMILARITY) + F.lit(1e-9))
    far = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    return (F.abs(F.col("na") - F.col("nb")) <= most) & (far <= most)


def _sketch(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(F.col("node").alias(side), F.col("words").alias(f"n{side}"), F.col("p0").alias(f"{side}0"), F.col("p1").alias(f"{side}1"))


def star_pairs(met: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): each node with one node of each of its blocks, if they may be alike."""
    ends = met.where("lo <> node").select(F.least("lo", "node").alias("a"), F.greatest("lo", "node").alias("b")).distinct()
    return ends.join(_sketch(sketches, "a"), "a").join(_sketch(sketches, "b"), "b").where(_may_be_alike()).select("a", "b")


def cross_pairs(met: DataFrame, sketches: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): nodes of one block and different groups that may be alike; groups: (id, root) of what stars have joined."""
    rows = met.select("k", "node").join(groups.select(F.col("id").alias("node"), "root").hint("shuffle_hash"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("k")
    rows = materialise(rows.join(mixed.hint("shuffle_hash"), "k").join(sketches.select("node", "words", "p0", "p1").hint("shuffle_hash"), "node"), "line-mixed")
    side = lambda s: rows.select("k", F.col("node").alias(s), F.col("root").alias(f"g{s}"), F.col("words").alias(f"n{s}"), F.col("p0").alias(f"{s}0"), F.col("p1").alias(f"{s}1"))
    found = side("a").join(side("b"), "k").where((F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & _may_be_alike()).select("a", "b").distinct()
    found = materialise(found, "line-cross")
    discard(rows)
    return found


def edit_similar(x: list, y: list, least: float) -> bool:
    """Whether 1 - (insertions + deletions) / (len(x) + len(y)) reaches least, by the longest common subsequence in bits.

    The bits of row tell at which words of x the longest subsequence that x so far shares with y so far doesn't grow.
    """
    total = len(x) + len(y)
    most = int((1 - least) * total + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    places: dict = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    whole = row = (1 << len(x)) - 1
    for w in y:
        if at := places.get(w):
            grown = row & at
            row = (row + grown) | (row - grown)
    return total - 2 * (len(x) - (row & whole).bit_count()) <= most


def _plain_words(line: bytes) -> list[bytes]:
    return line.translate(_PLAIN.tobytes()).split()


def _parities(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words of each line, parities of its words in 128 buckets as two numbers)."""
    data = _PLAIN[np.frombuffer(b"".join(lines), np.uint8)]
    starts, ends, first = words(data, np.r_[0, np.cumsum([len(x) for x in lines])])
    n = np.diff(first)
    place = np.repeat(np.arange(len(n)) * 128, n) + (word_hashes(data, starts, ends) >> np.uint64(57)).astype(np.int64)
    odd = (np.bincount(place, minlength=128 * len(n)) & 1).astype(np.uint8)
    return n, np.packbits(odd.reshape(-1, 128), axis=1, bitorder="little").view(np.uint64)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words, p0, p1, line_text) for wanted: (rk, line, node)."""
    names = ["node", "words", "p0", "p1", "line_text"]

    def run(batches):
        for batch in batches:
            nodes, lines = [], []
            for text, some in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                cut = text.as_py().split(b"\n")
                nodes += [w["node"] for w in some]
                lines += [cut[w["line"]] for w in some]
            for at in range(0, len(lines), 1000):
                part = lines[at : at + 1000]
                n, parity = _parities([x + b"\n" for x in part])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 1000], pa.int64()), _longs(n), *(_longs(np.ascontiguousarray(parity[:, i])) for i in (0, 1)), pa.array(part, pa.binary())], names)

    lists = wanted.groupBy("rk").agg(F.collect_list(F.struct("line", "node")).alias("some"))
    return docs.join(lists.hint("shuffle_hash"), "rk").select("text", "some").mapInArrow(run, "node long, words long, p0 long, p1 long, line_text binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            good = [edit_similar(_plain_words(p), _plain_words(q), SIMILARITY) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("line_text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("line_text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _joined_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (id, root) after further links (a, b): only roots are linked anew."""
    known = groups.select("id", "root").hint("shuffle_hash")
    ends = links
    for c in ("a", "b"):
        ends = ends.join(known.select(F.col("id").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    above = components(ends.select("a", "b"), "line-root-groups")
    to = above.select(F.col("id").alias("root"), F.col("root").alias("top"))
    out = materialise(groups.join(to, "root", "left").select("id", F.coalesce("top", "root").alias("root")).unionByName(above.select("id", "root")), "line-groups")
    discard(above)
    return out


def lines_to_drop(docs: DataFrame) -> DataFrame:
    """(rk, drop): the numbers of the lines that each row loses; docs: rk, doc, text."""
    lines = materialise(marked_lines(docs, word_classes(docs)), "lines")
    same = [F.first(c).alias(c) for c in ("rk", "line", *_RARE_COLUMNS)]  # any occurrence will do
    nodes = materialise(lines.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *same), "line-nodes")
    met = materialise(blocks(nodes), "line-blocks")
    wanted = nodes.join(met.select("node").distinct().hint("shuffle_hash"), "node", "left_semi")
    texts = materialise(_texts_of(docs, wanted.select("node", "rk", "line")), "line-texts")
    # A crowd of near lines is joined through one of its lines, by a check a line; other pairs are made only between groups.
    stars = materialise(_verified(star_pairs(met, texts), texts), "line-stars")
    groups = components(stars, "line-stars-groups")
    cross = cross_pairs(met, texts, groups)
    discard(met, stars)
    if not cross.isEmpty():
        links = materialise(_verified(cross, texts), "line-links")
        before, groups = groups, _joined_groups(groups, links)
        discard(before, links)
    # Nodes of a group, and those of several lines; a root is the least of its group.
    some = groups.select(F.col("id").alias("node"), "root").unionByName(groups.select(F.col("root").alias("node"), "root")).unionByName(nodes.where("n > 1").select("node", F.col("node").alias("root")))
    targets = some.groupBy("node").agg(F.min("root").alias("root"))
    marked = materialise(lines.select("rk", "doc", "line", "node").join(targets.hint("shuffle_hash"), "node").select("rk", "doc", "line", "root"), "line-marked")
    kept = marked.groupBy("root").agg(F.min(F.struct("doc", "rk", "line")).alias("keep")).select("keep.rk", "keep.line", F.lit(True).alias("stays"))
    both = marked.select("rk", "line", F.lit(False).alias("stays")).unionByName(kept)
    listed = both.groupBy("rk").agg(F.collect_set("line").alias("all"), F.collect_set(F.when(F.col("stays"), F.col("line"))).alias("keep"))
    out = materialise(listed.select("rk", F.array_sort(F.array_except("all", "keep")).alias("drop")).where("size(drop) > 0"), "line-drops")
    discard(lines, nodes, texts, cross, groups, marked)
    return out


def _without(text: str | None, drop: list[int] | None) -> tuple[str | None, int, int]:
    """(text, lines, lines gone)."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if not drop:
        return text, len(lines), 0
    gone = set(drop)
    return "\n".join([x for i, x in enumerate(lines) if i not in gone]), len(lines), len(gone)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with repeated lines gone from its text, and n_lines, n_removed (in place of columns of these names)."""
    df = df.drop("n_lines", "n_removed")
    names = [c for c in df.columns if c != text]
    plain = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(text).alias("text"), F.col(key).alias("doc_id")).withColumn("rk", doc_key()).withColumn("doc", F.coalesce("doc_id", F.lit(LAST_ID))).drop("doc_id")
    drops = lines_to_drop(plain.select("rk", "doc", "text"))
    both = plain.join(drops.hint("shuffle_hash"), "rk", "left").drop("rk", "doc")
    wide = both.select(*[f"c{i}" for i in range(len(names))], "text", "drop")

    def run(batches):
        for batch in batches:
            made = [_without(t, d) for t, d in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([m[0] for m in made], pa.string()), *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2))], [*(f"c{i}" for i in range(len(names))), "text", "n_lines", "n_removed"])

    schema = ", ".join([*(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(names)), "text string", "n_lines long", "n_removed long"])
    out = wide.mapInArrow(run, schema)
    back = {f"c{i}": c for i, c in enumerate(names)}
    return out.select(*[F.col(next(k for k, v in back.items() if v == c)).alias(c) if c != text else F.col("text").alias(text) for c in df.columns], "n_lines", "n_removed")


def digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
