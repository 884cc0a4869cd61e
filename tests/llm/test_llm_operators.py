"""Each operator against brute force, exact round trips or held-out labels, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("siltstone.llm.queries")
from siltstone.llm import chat_format, debruijn, decontam, graph, licenses, line_dedup, media_gif, packing, simhash, suffix_array, textkernel, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


def awkward(spark):
    """Nulls, empties, repeated rows, one id with two texts, a long text, and columns with names that operators use."""
    rng = random.Random(7)
    words = [f"w{rng.randrange(60)}" for _ in range(30_000)]
    long = " ".join(words)
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long), (5, "a b"), (5, "c d e f g h i j k l m n o p"), (None, "x y z " * 20), (None, None), (6, "\n\n \t"), (7, "x y z " * 20), (8, "é" * 200 + "\n" + "é" * 200)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit(1) for c in ("rk", "tk", "k", "doc", "start", "fp", "text_", "node", "score")})


def corpus(rng, n=40):
    """Texts that share sentences, passages and whole texts."""
    vocab = [f"{c}{v}{d}" for c in "bdkl" for v in "aeo" for d in ("n", "r", "st", "")]
    sentence = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 30))) + "."
    pool = [sentence() for _ in range(12)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and out:
            out.append(rng.choice(out))
        elif kind < 0.3 and out:
            w = rng.choice(out).split(" ")
            w[rng.randrange(len(w))] = "zzz"
            out.append(" ".join(w))
        else:
            out.append(rng.choice([" ", "\n", "  \t"]).join(rng.choice(pool) if rng.random() < 0.4 else sentence() for _ in range(rng.randrange(1, 8))))
    return out


def brute_words(texts, ids, k=13):
    split = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in zip(ids, split, strict=True):
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, w in zip(ids, split, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < i:
                gone[a : a + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_bytes(texts, ids, k=50):
    raw = [(t or "").encode() for t in texts]
    first = {}
    for i, w in zip(ids, raw, strict=True):
        for a in range(len(w) - k + 1):
            first[w[a : a + k]] = min(i, first.get(w[a : a + k], i))
    out = {}
    for i, w in zip(ids, raw, strict=True):
        gone = bytearray(len(w))
        for a in range(len(w) - k + 1):
            if first[w[a : a + k]] < i:
                gone[a : a + k] = b"\1" * k
        runs = sum(1 for a in range(len(w)) if gone[a] and (a == 0 or not gone[a - 1]))
        out[i] = (len(w), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup_against_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = corpus(rng) + [None, "", "ab " * 40, "ab " * 30]
    ids = rng.sample(range(1000), len(texts))
    df = docs(spark, texts, ids)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in debruijn.dedup(df).collect()}
    assert got == brute_words(texts, ids)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in debruijn.dedup(df, crowd=seed).collect()}
    assert got == brute_words(texts, ids)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_array.dedup(df).collect()}
    assert got == brute_bytes(texts, ids)


@pytest.mark.parametrize("crowd", [0, debruijn.CROWD])
def test_paths_name_repeats_with_coordinates(spark, crowd):
    shared = " ".join(f"s{i}" for i in range(40))
    out = debruijn.dedup(docs(spark, [f"a b c {shared} d e", f"x {shared} y", "q " * 30]), crowd=crowd).collect()
    by = {r["doc_id"]: r for r in out}
    assert [(p["start"], p["n_words"], p["first_doc"]) for p in by[1]["paths"]] == [(1, 40, 0)]
    assert [(p["start"], p["n_words"]) for p in by[0]["paths"]] == [(3, 40)] and by[0]["paths"][0]["path"] == by[1]["paths"][0]["path"]
    assert by[1]["kept_text"] == "x y"


def test_crowded_anchors_are_those_of_many_different_segments(spark, monkeypatch):
    """Copies of one segment are one before anchors are told apart, so a common passage alone crowds none but those at its ends."""
    seen = []
    crowded = debruijn.crowded
    monkeypatch.setattr(debruijn, "crowded", lambda df: seen.extend((r["h"], r["seg"]) for r in df.select("h", "seg").collect()) or crowded(df))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{' '.join(f'a{d}x{i}' for i in range(15))} {passage} {' '.join(f'b{d}x{i}' for i in range(15))}" for d in range(30)]
    rows = debruijn.dedup(docs(spark, texts), crowd=5).collect()
    sizes = {}
    for h, _ in seen:
        sizes[h] = sizes.get(h, 0) + 1
    assert len(set(seen)) == len(seen) and sizes and min(sizes.values()) > 5
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {d: 60 * (d > 0) for d in range(30)}


def test_intervals_are_maximal_repeats():
    import numpy as np

    rng = random.Random(3)
    for _ in range(100):
        segs = [bytes(rng.choices(b"ab", k=rng.randint(3, 9))) for _ in range(4)]
        data, at = np.frombuffer(b"".join(segs), np.uint8), np.cumsum([0] + [len(s) for s in segs])
        start = np.concatenate([np.arange(at[i], at[i + 1] - 2) for i in range(4)])
        of = np.concatenate([np.full(len(s) - 2, i) for i, s in enumerate(segs)])
        order, common = suffix_array.suffix_array(data, start, at[of + 1])
        suffixes = [bytes(data[start[k] : at[of[k] + 1]]) for k in order]
        assert suffixes == sorted(suffixes)
        left = [int(data[start[k] - 1]) if start[k] > at[of[k]] else 256 for k in order]
        got = set(suffix_array.intervals([c if c >= 3 else 0 for c in common.tolist()], left, 3))
        want = set()
        for x in {s[:n] for s in suffixes for n in range(3, len(s) + 1)}:
            at_ = [i for i, s in enumerate(suffixes) if s.startswith(x)]
            before = [left[i] for i in at_]
            if len(at_) > 1 and min(common[at_[0] + 1 : at_[-1] + 1]) == len(x) and (len(set(before)) > 1 or 256 in before):
                want.add((at_[0], at_[-1] + 1, len(x)))
        assert got == want


def brute_fingerprint(text):
    import xxhash

    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components_against_brute_force(spark):
    rng = random.Random(5)
    base = " ".join(f"t{rng.randrange(500)}" for _ in range(400))
    texts = []
    for _ in range(60):
        w = base.split()
        for _ in range(rng.randrange(0, 40)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(900)}"
        texts.append(" ".join(w))
    texts += [None, "", "One", "one", "A b", *corpus(rng, 20)]
    ids = rng.sample(range(5000), len(texts))
    marks = {i: brute_fingerprint(t) for i, t in zip(ids, texts, strict=True)}
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (marks[i] ^ marks[j]).bit_count() <= 3 and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(docs(spark, texts, ids)).collect()}
    assert got == {i: (marks[i], root(i)) for i in ids}


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(200, 260)] + [(7, 7), (300, 301), (301, 300)]
    got = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 1 for i in range(200, 260)}, 301: 300}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the lazy dog while seven wise men look on from the hill"
    changed = line.replace("seven", "eight")
    texts = [f"{line}\nshort\nown line of document zero is here", f"{changed}\nShort!", f"other words that stand alone in here\n{line.upper()}!", None, "", "short", "--\n\n--", "--"]
    rows = {r["doc_id"]: r for r in line_dedup.dedup(docs(spark, texts)).collect()}
    assert rows[0]["text"] == texts[0] and rows[0]["n_removed"] == 0
    assert rows[1]["text"] == "" and rows[1]["n_removed"] == 2
    assert rows[2]["text"] == "other words that stand alone in here" and rows[2]["n_removed"] == 1
    assert rows[3]["text"] is None and rows[4]["text"] == "" and rows[5]["text"] == ""
    assert rows[6]["text"] == texts[6] and rows[7]["text"] == texts[7]  # lines without words stay
    assert rows[0]["n_lines"] == 3


def test_line_dedup_replaces_its_own_columns(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f"]).withColumns({"n_lines": F.lit("x"), "n_removed": F.lit(9)})
    rows = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup(df).select(df.columns).collect()}
    assert rows == {0: ("a b c d e f", 1, 0), 1: ("", 1, 1)}


def test_line_groups_join_fuzzy_crowds(spark):
    """Lines one edit away from each other form one group, however many; one occurrence stays."""
    rng = random.Random(1)
    base = [f"word{i}" for i in range(150)]
    texts = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(150)] = f"new{i}"
        texts.append(" ".join(w))
    rows = line_dedup.dedup(docs(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in rows if r["text"]) == [0]


def alike_pairs(lines):
    """All pairs of lines (word lists) of five words or more that edit similarity links, by a list of shared words and the rule itself."""
    found, by_word = set(), {}
    for j, w in enumerate(lines):
        if len(w) < 5:
            continue
        tries = {}
        for x in set(w):
            for i in by_word.setdefault(x, []):
                tries[i] = tries.get(i, 0) + 1
            by_word[x].append(j)
        for i, shared in tries.items():
            if shared >= 0.25 * min(len(set(w)), len(set(lines[i]))) and line_dedup.edit_similar(lines[i], w, 0.8):
                found.add((i, j))
    return found


def grouped(n, pairs):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("sf, texts", [("sf0.001", 200), ("sf0.01", 500)])
def test_line_links_of_real_texts_against_brute_force(spark, sf, texts):
    """At least 0.98 of the lines that brute force removes go, and no other."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").orderBy("doc_id").limit(texts).collect()
    nodes, first = [], {}
    for r in rows:
        for x in (r["text"] or "").encode().split(b"\n"):
            w = tuple(line_dedup._plain_words(x))
            if w and w not in first:
                first[w] = len(nodes)
                nodes.append((list(w), x.decode()))
    pairs = alike_pairs([w for w, _ in nodes])
    want = grouped(len(nodes), pairs)
    got = line_dedup.dedup(docs(spark, [t for _, t in nodes])).collect()
    gone = {r["doc_id"] for r in got if r["n_removed"]}
    should = {i for i, r in enumerate(want) if r != i}
    assert len(pairs) > 30 and gone <= should and len(gone) >= 0.98 * len(should)


def test_line_groups_against_brute_force(spark):
    """At 5 to 120 words, with repeated words and with edits of all kinds, down to the least similarity."""
    rng = random.Random(11)
    lines = []
    for size in [5, 6, 7, 9, 10, 15, 20, 30, 50, 80, 120] * 4:
        base = [f"w{rng.choice('abcdefghij')}{rng.choice('abcdefghij')}{rng.choice('klm' * 4 + 'nopq')}" for _ in range(size)]
        lines.append(base)
        for edits in (1, size // 10, size // 5, size // 4):
            w = list(base)
            for _ in range(edits):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice(base)], [f"x{rng.choice('abc')}"]])
            lines.append(w)
    rng.shuffle(lines)
    raw = [[x.encode() for x in w] for w in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if raw[i] == raw[j] or (min(len(raw[i]), len(raw[j])) >= 5 and line_dedup.edit_similar(raw[i], raw[j], 0.8))]
    should = {i for i, r in enumerate(grouped(len(lines), pairs)) if r != i}
    gone = {r["doc_id"] for r in line_dedup.dedup(docs(spark, [" ".join(w) for w in lines])).collect() if r["n_removed"]}
    assert gone <= should and len(gone) >= 0.97 * len(should)


def test_lines_of_common_words_meet_in_threes(spark):
    """Short lines of words that all lines use are found too."""
    rng = random.Random(3)
    common = "the of and to in is that it".split()
    lines = list({tuple(rng.choice(common) for _ in range(rng.randrange(5, 8))): 0 for _ in range(450)})
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if line_dedup.edit_similar(list(lines[i]), list(lines[j]), 0.8)]
    should = {i for i, r in enumerate(grouped(len(lines), pairs)) if r != i}
    gone = {r["doc_id"] for r in line_dedup.dedup(docs(spark, [" ".join(w) for w in lines])).collect() if r["n_removed"]}
    assert len(should) > 50 and gone <= should and len(gone) >= 0.95 * len(should)


@pytest.mark.parametrize("rows, blocks", [(1 << 16, 100_000), (40, 300)])
def test_line_blocks_are_all_that_two_lines_have(spark, monkeypatch, rows, blocks):
    """A crowded block of many batches, ones of two lines and lines of few or common words; no block goes, none is said twice."""
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", rows)
    monkeypatch.setattr(line_dedup, "BUCKET_BLOCKS", blocks)
    rng = random.Random(5)
    nodes = []
    for i in range(400):
        w = sorted({1, 2, *(rng.randrange(3, 400) for _ in range(rng.randrange(0, 5)))} if i % 2 else {rng.randrange(3, 400) for _ in range(rng.randrange(0, 7))})
        w = w[:6] if i % 7 else [-(1 << 60) - x for x in w[:6]]  # common words have the sign
        nodes.append((i * 977 - 50_000, *w, *[None] * (6 - len(w))))
    k, node = line_dedup._keys(np.array([n[0] for n in nodes]), [np.array([-1 if n[i] is None else n[i] for n in nodes]) for i in range(1, 7)])
    want = {}
    for x, n in zip(k.view(np.int64).tolist(), node.tolist(), strict=True):
        want.setdefault(x, set()).add(n)
    want = {x: ns for x, ns in want.items() if len(ns) > 1}
    df = spark.createDataFrame(nodes, "node long, " + ", ".join(f"w{i} long" for i in range(6))).repartition(5)
    got = line_dedup.blocks(df).collect()
    assert max(map(len, want.values())) > 150 and len(got) == sum(map(len, want.values()))
    assert {(r["k"], r["node"]) for r in got} == {(x, n) for x, ns in want.items() for n in ns}
    assert all(r["lo"] in want[r["k"]] for r in got)
    # Along lo all of a block hang together, and only few speak for others.
    for x, ns in want.items():
        order = sorted(ns)
        links = [(order.index(r["node"]), order.index(r["lo"])) for r in got if r["k"] == x]
        assert set(grouped(len(order), links)) == {0}


def test_word_hashes_tell_words_apart_of_every_length():
    rng = random.Random(6)
    words = [bytes(rng.choice(b"ab") for _ in range(n)) for n in range(1, 150) for _ in range(20)] + [b"a", b"a\0", b"a\0\0", b"", b"\0"]
    words = [w for w in words if w]
    hashes = {}
    for shift in range(3):
        data = np.frombuffer(b" " * shift + b" ".join(words), np.uint8)
        ends = shift + np.cumsum([len(w) + 1 for w in words]) - 1
        for w, h in zip(words, textkernel.word_hashes(data, ends - [len(w) for w in words], ends).tolist(), strict=True):
            hashes.setdefault(w, set()).add(h)
    assert all(len(h) == 1 for h in hashes.values()) and len({next(iter(h)) for h in hashes.values()}) == len(hashes)


def test_edit_similarity_is_exact():
    rng = random.Random(2)

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(400):
        x, y = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        total = len(x) + len(y)
        want = total == 0 or 2 * lcs(x, y) / total >= 0.8 - 1e-9
        assert line_dedup.edit_similar(x, y, 0.8) == want


ITEM = "Question: a train from the town of Arlen leaves at 9 and travels 120 km in 3 hours, so how fast does the train from Arlen go on its way?"


def test_decontamination_finds_copies_and_changed_values(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "Some other item that no document here repeats in any way at all, be it long or short."), (3, None), (4, "tiny")], "item_id long, text string")
    other = ITEM.replace("Arlen", "Benford").replace("120", "360").replace(" 9 ", " 7 ").replace("3 hours", "4 hours")
    mixed = ITEM.replace("the town of Arlen", "the town of Benford").replace("120", "360")
    texts = ["Intro words first. " + ITEM + " And some more.", ITEM.lower(), "Start here. " + other + " End.", "a clean document about trains and towns that go on and on", None, "", "Begin. " + mixed]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.hits(docs(spark, texts), bench).collect()}
    assert got[0, 1] == "verbatim" and got[1, 1] == "verbatim" and got[2, 1] == "reparameterised"
    assert {d for d, _ in got} <= {0, 1, 2, 6}
    assert got.get((6, 1)) != "reparameterised"  # one name stands for two
    left = {r["doc_id"] for r in decontam.without_contaminated(docs(spark, texts), bench).collect()}
    assert {3, 4, 5} <= left and not {0, 1, 2} & left


def test_decontamination_of_plain_words_against_brute_force(spark):
    rng = random.Random(21)
    vocab = [c + v + d for c in "bdfgkl" for v in "aeiou" for d in ("n", "r", "sk")]
    line = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {i: line(rng.choice((3, 5, 6, 7, 8, 9, 14, 30))) for i in range(40)}
    texts = {}
    for d in range(300):
        words = line(rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 3)):
            item = rng.choice(items)
            a = rng.randrange(len(item))
            at = rng.randrange(len(words) + 1)
            words[at:at] = item[a : a + rng.randrange(1, 31)] if rng.random() < 0.6 else item
        texts[d] = words
    want = {}
    for i, item in items.items():
        w = min(8, len(item))
        for d, words in texts.items():
            have = {tuple(words[k : k + w]) for k in range(len(words) - w + 1)}
            places = [k for k in range(len(item) - w + 1) if len(item) >= 5 and tuple(item[k : k + w]) in have]
            cover = len({x for k in places for x in range(k, k + w)}) / len(item)
            if cover >= 0.4:
                want[d, i] = (len(places), round(cover, 9), 0.0, "verbatim")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    found = decontam.hits(docs(spark, [" ".join(x) for x in texts.values()], list(texts)), bench).collect()
    assert len(want) > 50 and len(found) == len(want)
    assert {(r["doc_id"], r["item_id"]): (r["n_windows"], round(r["plain_cover"], 9), r["template_cover"], r["kind"]) for r in found} == want
    assert decontam.hits(docs(spark, ["a b c d e"]), bench.limit(0)).count() == 0


def test_decontamination_both_ways_agree(spark, monkeypatch):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "item_id", "n_windows").collect()))
    small = key(decontam.hits(d, b))
    monkeypatch.setattr(decontam, "INDEX_ROWS", 0)
    assert key(decontam.hits(d, b)) == small
    rows = [(r["doc_id"], " ".join(re.findall(r"\w+", (r["text"] or "").lower()))) for r in d.collect()]
    want = {i for i, t in rows for q in b.collect() if " ".join(re.findall(r"\w+", q["text"].lower())) in t}
    assert want <= {i for i, _, _ in small}


def test_gif_round_trips():
    rng = random.Random(4)
    payloads = [media_gif.payload_of(t)[0] for t in (None, "", "a" * 200_000, "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(40_000)))] + [rng.randbytes(64 * 1500)]
    for p in payloads:
        frames = list(media_gif.decode(media_gif.encode(p)))
        assert b"".join(f.patch()[..., 0].tobytes() for f in frames) == p
        assert sum(f.delay_ms for f in frames) == 100 * len(frames)


def test_gif_disposal_transparency_interlace_and_palettes():
    import struct

    def frame(index_rows, left=0, top=0, disposal=0, transparent=None, palette=None, interlaced=False):
        h, w = len(index_rows), len(index_rows[0])
        order = [r for s, k in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(s, h, k)] if interlaced else range(h)
        data = media_gif._pack(media_gif._lzw_codes(bytes(x for r in order for x in index_rows[r])))
        out = b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), 5, transparent or 0, 0)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, (0x80 if palette else 0) | (0x40 if interlaced else 0)) + (palette or b"") + b"\x08"
        return out + bytes([len(data)]) + data + b"\0\0"[:1]

    two = bytes([255, 0, 0, 0, 0, 255])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 9, 0x80, 0, 0) + bytes([10, 20, 30, 40, 50, 60])
    gif = head + frame([[0, 1]] * 9, interlaced=True) + frame([[1, 0]], 0, 0, disposal=3, transparent=1) + frame([[0]], 1, 1, disposal=2, palette=two) + frame([[1]], 0, 2) + b"\x3b"
    frames = list(media_gif.decode(gif))
    assert [f.delay_ms for f in frames] == [50] * 4
    assert frames[0].canvas[3].tolist() == [[10, 20, 30, 255], [40, 50, 60, 255]]
    assert frames[1].canvas[0].tolist() == [[10, 20, 30, 255], [10, 20, 30, 255]]  # index 1 shows what is below
    assert frames[2].canvas[0].tolist() == [[10, 20, 30, 255], [40, 50, 60, 255]]  # restored
    assert frames[2].canvas[1][1].tolist() == [255, 0, 0, 255]
    assert frames[3].canvas[1][1].tolist() == [0, 0, 0, 0]  # cleared
    assert sum(frames[3].histogram()[:8]) == 17
    for bad in (b"", b"GIF89a", gif[:40], b"nope" * 9):
        with pytest.raises(ValueError):
            list(media_gif.decode(bad))


def test_gif_frame_rows(spark):
    df = spark.createDataFrame([(1, media_gif.encode(bytes(64 * 600))), (2, None), (3, b"bad"), (4, b"")], "doc_id long, media binary")
    rows = sorted(map(tuple, media_gif.frame_rows(df).select("doc_id", "frame", "height", "error").collect()), key=str)
    assert [r[:3] for r in rows if r[3] is None] == [(1, 0, 512), (1, 1, 88)] and {r[0] for r in rows if r[3]} == {3, 4}


def test_gif_query_columns_against_brute_force(spark):
    df = awkward(spark)
    got = {}
    for r in media_gif.media_digest(media_gif.sample_media(df)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]))
    want = {}
    for r in df.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.setdefault(r["doc_id"], []).append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_chat_escape_is_exact_and_layouts_map(spark):
    rng = random.Random(6)
    bits = ["<", "[", "s>", "/s>", "INST]", "/INST]", "\\", "<SYS>>", "a", "\n", ">", "</SYS>>", "é"]
    for _ in range(3000):
        x, y = ("".join(rng.choices(bits, k=8)) for _ in range(2))
        assert chat_format.unescape(chat_format.escape(x)) == x
        f, spans = chat_format.format_turns([{"role": y, "text": x}, {"role": "assistant", "text": x}])
        assert list(chat_format.read_turns(f)) == [(y, x), ("assistant", x)]
        assert chat_format.unescape("".join(f[a:b] for a, b in spans)).startswith(x if y == "assistant" else x)
    records = ['{"prompt":"p","completion":"c"}', '{"instruction":"i","input":"n","output":"o"}', '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', '{"x":1}', "broken", None, '{"messages":[{"role":"user","content":null}]}', "[1]"]
    df = spark.createDataFrame(list(enumerate(records)), "k long, record string")
    got = {r["k"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in chat_format.canonical_turns(df, "k").collect()}
    assert got == {0: [("user", "p"), ("assistant", "c")], 1: [("user", "i\n\nn"), ("assistant", "o")], 2: [("user", "h"), ("assistant", "g")], 3: None, 4: None, 5: None, 6: [("user", "")], 7: None}


def test_chat_layouts_stand_extra_and_mixed_fields(spark):
    records = {
        1: '{"id":7,"prompt":"p","completion":"c","meta":{"score":1.5,"tags":["a"]}}',
        2: '{"source":"s","messages":[{"role":"user","content":"a","name":"n"},{"content":"b"}]}',
        3: '{"messages":[{"role":"user","content":"a"},{"role":"user","content":3}]}',  # a content that is no text
        4: '{"messages":[{"role":"user","content":"a"},{"role":"user","content":[{"text":"x"}]}]}',
        5: '{"messages[].role":"user","messages[].content":"a"}',  # keys that look like paths
        6: '{"messages":[]}',
        7: '{"prompt":"p","completion":"c","question":"q"}',  # two layouts at once
        8: "[" * 100_000,
        9: '{"user":"u","system":null,"prompt":"p","response":""}',
        10: '{"chosen":"yes","asked":"no"}',
        11: "{}",
    }
    df = spark.createDataFrame(list(records.items()), "k long, record string").withColumns({c: F.lit(1) for c in ("turns", "layout", "fingerprint")})
    mine = chat_format.Layout("chosen", (("user", ("asked",)), ("assistant", ("chosen",))))
    rows = {r["k"]: r for r in chat_format.canonical_turns(df, "k", layouts=[mine]).collect()}
    got = {k: r["turns"] and [tuple(t) for t in r["turns"]] for k, r in rows.items()}
    assert got == {1: [("user", "p"), ("assistant", "c")], 2: [("user", "a"), ("", "b")], 3: None, 4: None, 5: None, 6: [], 7: None, 8: None, 9: [("user", "p"), ("assistant", "")], 10: [("user", "no"), ("assistant", "yes")], 11: None}
    assert {k for k, r in rows.items() if r["fingerprint"] is None} == {8} and rows[1]["fingerprint"] != rows[10]["fingerprint"]
    assert rows[1]["layout"] == "completion" and rows[6]["layout"] == "messages" and rows[7]["layout"] is None


def test_chat_records_of_every_layout_are_lossless(spark):
    rng = random.Random(9)
    texts = ["a", "b\n\nc", "\n\n", "x\n\n\ny\n\nz", "", None, "</s>\\", "é\u2028\x00\"", "long " * 40_000]
    shapes = [["user", "assistant"], ["system", "user", "assistant"], ["user", "gpt"], ["human"], ["assistant"], [None, "", "a\nb"], ["user"] * 5]
    rows = [(i, t, r, rng.choice(texts)) for i in range(400) for t, r in enumerate(rng.choice(shapes))] + [(None, 0, "user", "n"), (None, 1, "assistant", "n"), (-5, None, None, None), (-6, 1, "user", "same"), (-6, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("t", "record", "turns", "layout", "__turns")})
    made = chat_format.canonical_turns(chat_format.records_of_rows(df), "conv_id")
    got = {r["conv_id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in made.collect()}
    want: dict = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((r or "", x or ""))
    assert {c: ts for c, (_, ts) in got.items()} == want
    assert {x for x, _ in got.values()} == {x.name for x in chat_format.LAYOUTS}
    formatted = chat_format.format_chats(made, "conv_id")
    digests = chat_format.chat_digest(formatted, "conv_id").collect()
    assert {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in digests} == {c: (len(ts), sum(len(x) for r, x in ts if r == "assistant")) for c, ts in want.items()}
    assert chat_format.chat_digest(chat_format.format_chats(chat_format.canonical_turns(chat_format.records_of_rows(df.limit(0)), "conv_id"), "conv_id"), "conv_id").count() == 0


def test_chat_query_matches_brute_force(spark):
    got = {r["conv_id"]: r for r in llm.op4_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    turns: dict = {-1: [("user", llm.CONTROL_TURN), ("assistant", llm.CONTROL_TURN)]}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    assert set(got) == set(turns)
    for c, ts in turns.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_packing_is_whole_and_tight(spark):
    import numpy as np
    from tokenizers import Tokenizer

    path = llm.word_tokenizer_path()
    t = Tokenizer.from_file(path)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").union(docs(spark, [None, "", "it's <|endoftext|> ½ İ"], [-1, -2, -3]))
    rows = packing.pack(df.coalesce(1), path).collect()
    pieces: dict = {}
    windows: dict = {}
    for r in rows:
        assert 1 <= r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    t.encode_special_tokens = True
    for r in df.collect():
        ids = [x for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]) for x in p["ids"]]
        assert ids == t.encode(r["text"] or "", add_special_tokens=False).ids + [2] and all(p["doc_tokens"] == len(ids) for p in pieces[r["doc_id"]])
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
    total = sum(r["length"] for r in rows)
    assert 1 - total / (packing.WINDOW * len(windows)) < 0.03


def test_differencing_is_nearly_equal():
    rng = random.Random(8)
    for _ in range(30):
        sizes = [rng.randrange(1, 4096) for _ in range(rng.randrange(1, 300))]
        owner, m = packing.balance(sizes)
        sums = [0] * m
        for s, w in zip(sizes, owner.tolist(), strict=True):
            sums[w] += s
        assert max(sums) <= 4096 and sum(sums) == sum(sizes)
    owner, sums = packing.difference([8, 7, 6, 5, 4], 2)
    assert abs(int(sums[0] - sums[1])) <= 2


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GNU = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU %s as published by
the Free Software Foundation%s either version %s of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU %s for more details."""
BSD2 = """Copyright (c) 2019, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of Example Corporation nor the names of its contributors may
   be used to endorse or promote products derived from this software without
   specific prior written permission.
"""
MIT = """MIT License

Copyright (c) 2021 Some Holder

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
ISC = """Copyright (c) 2004 by A. Holder

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
NOTICES = [
    (APACHE, "Apache-2.0"),
    ("Copyright 2020 The Authors. All rights reserved.\n\n" + APACHE, "All-rights-reserved;Apache-2.0"),
    (APACHE.replace("\n", "\n# "), "Apache-2.0"),
    (GNU % (":", "General Public License", ",", "3", "General Public License"), "GPL-3.0-or-later"),
    (GNU % (";", "General Public License", ";", "2", "General Public License"), "GPL-2.0-or-later"),
    (GNU % (":", "Affero General Public License", ",", "3", "Affero General Public License"), "AGPL-3.0-or-later"),
    ((GNU % (";", "Lesser General Public\nLicense", ";", "2.1", "Lesser General Public License")).replace("This program", "This library"), "LGPL-2.1-or-later"),
    (BSD2, "All-rights-reserved;BSD-2-Clause"),
    (BSD2 + BSD3, "All-rights-reserved;BSD-3-Clause"),
    (MIT, "MIT"),
    (ISC, "ISC"),
    (MPL, "MPL-2.0"),
    ("This software is provided 'as-is', without any express or implied\nwarranty.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented.", "Zlib"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.", "Unlicense"),
    ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to Her Work.", "CC0-1.0"),
    ("This package may be used under the terms of the MIT license.", "MIT"),
    ("Released under the MIT License. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0;MIT"),
    ("This work is licensed under the GNU General Public License version 3.", "GPL-3.0-only"),
    ("Intro text without a stop\nLicensed under the Apache License, Version 2.0.\nmore", "Apache-2.0"),
    ("// SPDX-License-Identifier: BSL-1.0\nint main() {}", "BSL-1.0"),
    ("All rights reserved.", "All-rights-reserved"),
    ("All rights reserved. No part of this work may be copied without permission.", "All-rights-reserved"),
    ("No rights here. 2.0. And more of the license.", ""),
    ("The MIT students met the mayor. A licence to kill.", ""),
    ("Nothing here.", ""),
    (None, ""),
    ("", ""),
]


def test_published_licence_notices(spark):
    """Headers as they are published, with their own stops, breaks, holders and years."""
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(docs(spark, [t for t, _ in NOTICES])).collect()}
    assert got == {i: want for i, (_, want) in enumerate(NOTICES)}


def test_licence_sql_agrees_on_notices(spark):
    import duckdb
    import pandas

    frame = pandas.DataFrame({"doc_id": range(len(NOTICES)), "text": [t for t, _ in NOTICES]})
    con = duckdb.connect()
    con.register("documents", frame)
    want = {r[0]: r[1:] for r in con.execute(licenses.scan_sql()).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in licenses.scan(docs(spark, [t for t, _ in NOTICES])).collect()}
    assert got == want


def test_every_licence_sentence_and_rule_is_reachable(spark):
    """Each known sentence, written as a sentence, gives its identifier; each rule's sentences in order give its licence."""
    s = licenses.SENTENCES
    rows = {r["doc_id"]: r["sentence_ids"].split(";") for r in licenses.scan(docs(spark, [x.capitalize() + ". " for x in s.values()])).collect()}
    assert [k for i, k in enumerate(s) if k not in rows[i]] == []
    texts = [". ".join(s[x] for x in ids) + ". " for _, ids in licenses.RULES]
    found = {r["doc_id"]: r["licences"].split(";") for r in licenses.scan(docs(spark, texts)).collect()}
    assert [rule for i, rule in enumerate(licenses.RULES) if rule[0] not in found[i]] == []


def test_toxicity_learns_terms_and_exceptions(spark):
    rng = random.Random(9)
    filler = [f"f{rng.randrange(200)}x" for _ in range(5000)]
    say = lambda *extra: " ".join(rng.sample(filler, 30) + list(extra))
    texts = [say("you", rng.choice(["blarg", "Bl4rg", "blаrg", "blargish"]), "now") for _ in range(60)] + [say("you", "now") for _ in range(300)] + [say("nice", "blarg", "cake") for _ in range(10)]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i < 60)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    assert any(t.strip().startswith("blar") for t in model.terms) and " nice blarg " in model.phrases
    score = lambda t: toxicity._score(model, t)
    assert score("you are so 8lаrg now") > 0.5 > score("have some nice blarg cake")
    assert score("a clean text") < 0.5
    rows = toxicity.score(df, model).collect()
    assert all(r["predicted"] == int(r["doc_id"] < 60) for r in rows)
    empty = toxicity.fit(df, labels.limit(0))
    assert all(r["score"] < 1e-6 for r in toxicity.score(docs(spark, ["x", None, ""]), empty).collect())


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    df, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(df, toxicity.fit(df, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    bad, good = ([r["predicted"] for r in held if r["toxic"] == x] for x in (1, 0))
    assert sum(bad) / len(bad) > 0.75 and sum(good) / len(good) < 0.02


OPERATORS = {
    "decontamination": lambda s, d: decontam.hits(d, s.createDataFrame([(1, ITEM), (1, ITEM), (None, "x y z " * 20)], "item_id long, text string")),
    "lines": lambda s, d: line_dedup.dedup(d),
    "gif": lambda s, d: media_gif.media_digest(media_gif.sample_media(d)),
    "debruijn": lambda s, d: debruijn.dedup(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "suffixes": lambda s, d: suffix_array.dedup(d),
    "packing": lambda s, d: packing.pack(d, llm.word_tokenizer_path()),
    "licences": lambda s, d: licenses.scan(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.Model({" w1": 2.0}, (), 0.5, 1.0, -1.0)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(spark, name):
    run = OPERATORS[name]
    df = awkward(spark)
    rows = run(spark, df).collect()
    if name == "decontamination":
        assert {r["doc_id"] for r in rows} <= {None, 7}
    elif name == "packing":
        assert len({r["doc_id"] for r in rows}) == 9
    else:
        assert len(rows) == df.count()
    if name == "suffixes":
        by = {}
        for r in rows:
            by.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
        assert by[4][0][0] == by[4][0][1] and all(x[1] == 0 or x[0] > x[1] for x in by[3])  # 4 copies 3
        assert sorted(by[None])[0] == (0, 0) and sorted(by[None])[1] == (120, 120)  # a null id comes after 7
    assert run(spark, df.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_decide(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    out = spark.read.parquet(f"{d}/documents.parquet")
    columns, ids = out.columns, {r["doc_id"] for r in out.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in out.collect()}
        stage(spark, out, d).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == columns
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= ids and set(after) <= set(before)
        if name == "line_dedup":
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "simhash_near_dedup":
            assert len({brute_fingerprint(r["text"]) for r in after.values()}) == len(after)
            assert {brute_fingerprint(r["text"]) for r in before.values()} >= {brute_fingerprint(r["text"]) for r in after.values()}
        else:
            assert all(after[i]["text"] == before[i]["text"] for i in after)
    rows = pipeline.STAGES[-1][1](spark, out, d).collect()
    assert {r["doc_id"] for r in rows} == set(after)
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["length"] == r["doc_tokens"]) > 0
    assert {r["doc_id"] for r in pipeline.run(spark, d).collect()} == set(after)


def test_pipeline_stages_on_awkward_and_empty_tables(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    df = awkward(spark)
    for name, stage in pipeline.STAGES:
        out = stage(spark, df, d)
        rows = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in df.select("doc_id").collect()}
        else:
            assert out.columns == df.columns
            ids = {r["doc_id"] for r in rows}
            if name == "simhash_near_dedup":
                assert {1, 3} <= ids and not ids & {2, 4, 6}  # 2 and 6 have no words either, 4 copies 3
            else:
                assert ids == {r["doc_id"] for r in df.select("doc_id").collect()}
        assert stage(spark, df.limit(0), d).count() == 0


def test_maximal_repeats_list_all_occurrences(spark):
    from siltstone.llm.repeats import keyed, originals

    shared = "".join(f"{i:03d}" for i in range(30))
    docs_ = keyed(docs(spark, [f"aa{shared}bb", f"x{shared}yyy", f"{shared[:60]}q"]))
    rows = suffix_array.maximal_repeats(docs_, originals(docs_)).collect()
    assert {r["doc"] for r in rows} == {0, 1, 2} and {r["owner"] for r in rows} == {0}
    for doc, start, end in ((0, 2, 92), (1, 1, 91), (2, 0, 60)):
        covered = {i for r in rows if r["doc"] == doc for i in range(r["start"], r["start"] + r["length"])}
        assert covered == set(range(start, end))
