"""Packing by Karmarkar-Karp multiway differencing.

Documents become token ids plus one end id. Whole windows are cut off long documents; the remaining pieces of a group
of neighbouring documents are partitioned by largest differencing: each piece is a partition of the windows with one
window filled, and the two partitions of the largest imbalance merge so that the fullest windows of one meet the
emptiest of the other, until one partition is left. Its windows are nearly equal. Where one exceeds the capacity, the
number of windows rises and the group is done again.

A group is a run of documents in one scan partition, so packing needs no shuffle; a retried task reads the same rows
and makes the same windows. sequence_id holds the partition in its upper bits.

Null and empty texts hold the end id alone. Repeated rows are packed each. Extra columns are dropped.
"""

from __future__ import annotations

import heapq
import os
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 4096
#: Tokens of a group; fixes the memory of a task and the windows that one differencing run balances.
GROUP_TOKENS = 120 * WINDOW
#: Words whose ids a worker remembers.
WORD_CACHE = 400_000


_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class WordTokenizer:
    """Ids of whole texts by a tokenizer that lower-cases and drops white space, one word (run without ASCII white space) at a time.

    Such a tokenizer never looks across white space, so a text's ids are its words' ids in order and words can be
    remembered. Words of letters alone need no search for the tokenizer's own words and go to the bare model, many at
    once. A word of letters before ASCII marks has the ids of both in turn. Strings of special tokens count as
    ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        self.ascii, self.letters = Tokenizer(self.t.model), Tokenizer(self.t.model)
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters.normalizer = normalizers.Lowercase()
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.t.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for w, i in names.items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for at in range(0, len(words), 4096) for e in self.t.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]

    def _joined(self, bare, words: list[str]) -> list[bytes]:
        """_ids() of words of letters alone, many as one text: a word's last id is the one that ends a word."""
        out = []
        for at in range(0, len(words), 64):
            ids = np.array(bare.encode_batch_fast([" ".join(words[at : at + 64])], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        return out

    def _learn(self, words: list[bytes]) -> None:
        known, older = self.known, self.older
        parts: dict[bytes, tuple[bytes, bytes]] = {}  # letters, then marks
        whole: dict[bytes, None] = {}
        for w in words:
            base = w.rstrip(_MARKS)
            if base and len(base) < len(w) and (base.isalpha() or not base.isascii()):
                parts[w] = base, w[len(base) :]
                whole[base] = whole[w[len(base) :]] = None
            else:
                whole[w] = None
        ascii_, letters, rest = [], {}, {}
        for w in whole:
            if w in known:
                continue
            if w in older:
                known[w] = older[w]
            elif w.isalpha():
                ascii_.append(w)
            else:
                t = w.decode()
                (letters if t.isalpha() and t.lower().isalpha() and unicodedata.is_normalized("NFC", t) else rest)[w] = t
        known.update(zip(ascii_, self._joined(self.ascii, [w.decode() for w in ascii_]), strict=True))
        known.update(zip(letters, self._joined(self.letters, list(letters.values())), strict=True))
        # A word is letters and marks only if its letters are; else its ids are its own.
        rest |= {w: w.decode() for w, (base, _) in parts.items() if base in rest or not (base.isalpha() or base in letters or base.decode().isalpha())}
        known.update(zip(rest, self._ids(list(rest.values())), strict=True))
        known.update((w, known[base] + known[tail]) for w, (base, tail) in parts.items() if w not in rest)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text. ASCII letters may be lowered first: that is what the tokenizer does."""
        split = [t.lower().split() for t in texts]
        if len(self.known) > WORD_CACHE:
            self.known, self.older = {}, self.known
        known = self.known
        if new := [w for w in set().union(*split) if w not in known]:
            self._learn(new)
        return [b"".join([known[w] for w in words]) for words in split]


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def difference(sizes: list[int], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition pieces of these sizes into m sets by multiway differencing: (set of each piece, sums of sets)."""
    # A partition: descending sums of its filled sets and the tree of pieces in each; the other sets are empty.
    heap = [(-s, k, [(s, k)]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    left: list = list(range(len(sizes)))
    right: list = [-1] * len(sizes)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # The fullest set of one partition joins the emptiest of the other.
        spare = m - len(a)
        made = list(a)
        if spare >= len(b):
            made += b
        else:
            made += b[:spare]
            for j, (s, node) in enumerate(b[spare:]):
                t, other = made[len(a) - 1 - j]
                left.append(other)
                right.append(node)
                made[len(a) - 1 - j] = (s + t, len(left) - 1)
        made.sort(key=lambda x: -x[0])
        least = made[-1][0] if len(made) == m else 0
        tick += 1
        heapq.heappush(heap, (least - made[0][0], tick, made))
    owner, sums = np.zeros(len(sizes), np.int64), np.zeros(m, np.int64)
    for w, (s, node) in enumerate(heap[0][2] if heap else []):
        sums[w] = s
        todo = [node]
        while todo:
            x = todo.pop()
            if right[x] < 0:
                owner[x] = w
            else:
                todo += (left[x], right[x])
    return owner, sums


def balance(sizes: list[int], capacity: int = WINDOW) -> tuple[np.ndarray, int]:
    """(window of each piece, number of windows): the least number from the total's quotient up that holds."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        owner, sums = difference(sizes, m)
        if sums.max() <= capacity:
            return owner, m
        m += 1


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_group(docs: list[tuple[object, bytes]], base: int, window: int) -> tuple[list[tuple], int]:
    """Rows (id, start, length, crc, doc_tokens, sequence, offset, ids) of a group, and the sequences it used."""
    rows, rest, seq = [], [], base
    for k, (_, ids) in enumerate(docs):
        n, start = len(ids) // 4, 0
        while n - start >= window:
            rows.append((k, start, window, seq, 0))
            seq, start = seq + 1, start + window
        if start < n:
            rest.append((k, start, n - start))
    if rest:
        owner, m = balance([x[2] for x in rest], window)
        filled = [0] * m
        for (k, start, n), w in zip(rest, owner.tolist(), strict=True):
            rows.append((k, start, n, seq + w, filled[w]))
            filled[w] += n
        names = {w: i for i, w in enumerate(w for w in range(m) if filled[w])}  # no empty windows
        rows = [r if r[3] < seq else (*r[:3], seq + names[r[3] - seq], r[4]) for r in rows]
        seq += len(names)
    out = []
    for k, start, n, s, offset in rows:
        key, ids = docs[k]
        piece = ids[4 * start : 4 * (start + n)]
        out.append((key, start, n, zlib.crc32(piece), len(ids) // 4, s, offset, piece))
    return out, seq


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each piece: its document's key, start, length, CRC, the document's tokens, its sequence and offset there, and ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = tokenizer(tokenizer_path)
        context = TaskContext.get()
        seq = (context.partitionId() if context else 0) << 36
        group, tokens = [], 0

        def flush():
            nonlocal seq, group, tokens
            rows, seq = _pack_group(group, seq, window)
            group, tokens = [], 0
            cols = [pa.array([r[0] for r in rows], kind), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 7))]
            if with_ids:
                flat = np.frombuffer(b"".join([r[7] for r in rows]), "<u4").astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([r[2] for r in rows])].astype(np.int32)), pa.array(flat)))
            return pa.RecordBatch.from_arrays(cols, [key, *PIECES.replace(",", "").split()[::2], *["ids"] * with_ids])

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                for k, ids in zip(part.column(0).to_pylist(), encoder.encode([t.as_py() or b"" for t in part.column(1).cast(pa.binary())]), strict=True):
                    group.append((k, ids + end))
                    tokens += len(ids) // 4 + 1
                    if tokens >= GROUP_TOKENS:
                        yield flush()
        if group:
            yield flush()

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {PIECES}{', ids array<int>' * with_ids}")
