"""Vectorised word and window hashing over Arrow text batches.

Everything works on UTF-8 bytes. A hash of a range is a polynomial prefix hash modulo 2**64 over random byte
values, finished by a mixing step, so any range of a text costs two lookups once its prefix sums are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; bounds the memory of a Python worker (about 100 bytes of arrays per text byte).
CHUNK_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash() takes the hash of any range of values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_P, "p", len(values)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end); equal ranges have equal hashes wherever they lie."""
    inverse = _power(_P_INV, "i", len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows in bytes) of a text column, null as empty, about limit bytes at once.

    A single longer text makes one longer chunk: texts are never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # several chunks remain only where none can hold all
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, whole[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes that are no ASCII white space; texts end words), and the number of words before each text."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~WHITE[data]
    start = solid[1:-1] & ~solid[:-2]
    end = solid[1:-1] & ~solid[2:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = solid[inner + 1]
    end[inner - 1] = solid[inner]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


_LANE = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
#: Longer words take the hash of a range.
_LONG = 64
_SIZES = mix(np.arange(1, _LONG + 2, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words by eight bytes at once; equal words have equal hashes wherever they lie."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix((eight[starts] & _LANE[np.minimum(size, 8)]) ^ _SIZES[np.minimum(size, _LONG)])
    rest = np.flatnonzero((size > 8) & (size <= _LONG))
    for at in range(8, _LONG, 8):
        if not len(rest):
            break
        left = size[rest] - at
        out[rest] = mix(out[rest] * _P ^ (eight[starts[rest] + at] & _LANE[np.minimum(left, 8)]))
        rest = rest[left > 8]
    long = np.flatnonzero(size > _LONG)
    if len(long):
        out[long] = range_hash(prefix_hash(BYTE_VALUES[data]), starts[long], ends[long])
    return out


def window_hashes(hashes: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every window of k words inside one text; before: words before each text."""
    if len(hashes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.arange(len(hashes) - k + 1)
    ends = np.repeat(before[1:], np.diff(before))[: len(first)]
    first = first[first + k <= ends]
    return first, range_hash(prefix_hash(hashes), first, first + k)


def sliding_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """range_hash() of every k consecutive values."""
    n = len(prefix) - k
    x = prefix[k:] - prefix[:-k]
    x *= _power(_P_INV, "i", n)
    x += np.uint64(k)
    return mix(x)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    best, span = values, 1
    while span < w:
        step = min(span, w - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    return best
