"""GIF media columns: LZW streams, palettes, disposal, transparency, timed frames and colour histograms.

encode() and decode() know the whole of GIF89a that matters for pixels: variable-width LZW with clear and end codes
(also deferred clears), global and local palettes, interlacing, frame offsets, disposal methods 0 to 3, transparent
indices and delays. frame_rows() gives one row a frame; sample_media() stores byte strings losslessly as 8-bit samples.

Null media give no frames; empty or broken media give one row with an error and null columns. Rows are independent of
each other: repeated rows repeat their results, extra columns are dropped unless named.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CLEAR, END = 256, 257
#: Samples in a row of an image, and rows of one frame; longer payloads go on in further frames.
WIDTH, FRAME_ROWS = 64, 512
DELAY_CS = 10
BINS = 8


def _lzw_codes(samples: bytes) -> list[int]:
    """Codes of 8-bit samples, a clear code first and wherever the table is full, an end code last."""
    codes = [CLEAR]
    emit = codes.append
    if not samples:
        return [CLEAR, END]
    table: dict[int, int] = {}
    get, free, have = table.get, END + 1, samples[0]
    for b in memoryview(samples)[1:]:
        key = have << 8 | b
        code = get(key)
        if code is None:
            emit(have)
            if free < 4096:
                table[key] = free
                free += 1
            else:
                emit(CLEAR)
                table.clear()
                free = END + 1
            have = b
        else:
            have = code
    emit(have)
    emit(END)
    return codes


def _widths(since_clear: np.ndarray, least: int) -> np.ndarray:
    """Bits of a code by its place after the last clear code (0: the first), for a table that starts at 2**(least - 1) + 2."""
    filled = since_clear + (1 << (least - 1)) + 1
    width = np.full(len(filled), least, np.int64)
    for w in range(least, 12):
        width[filled >= 1 << w] = w + 1
    return width


def _pack(codes: list[int]) -> bytes:
    c = np.array(codes, np.uint64)
    place = np.arange(len(c))
    last = np.maximum.accumulate(np.where(c == CLEAR, place, -1))
    before = np.r_[-1, last[:-1]]  # the clear code before each code
    since = np.where(before < 0, 0, place - before - 1)
    width = _widths(since, 9)
    at = np.r_[0, np.cumsum(width)]
    out = np.zeros((int(at[-1]) + 7) // 8 + 4, np.uint8)
    byte, bits = at[:-1] >> 3, c << (at[:-1] & 7).astype(np.uint64)
    for k in range(3):  # a code touches three bytes at most, and codes never share bits
        np.bitwise_or.at(out, byte + k, (bits >> np.uint64(8 * k)).astype(np.uint8))
    return out[: (int(at[-1]) + 7) // 8].tobytes()


def _unpack_lzw(stream: bytes, least_size: int, n: int) -> bytes:
    """The first n samples of an LZW stream; ValueError for a broken one."""
    clear, end, least = 1 << least_size, (1 << least_size) + 1, least_size + 1
    raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
    total, at, since = 8 * len(stream), 0, 0
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, prev, out, got = list(base), b"", [], 0
    while got < n:
        # Code widths depend only on the number of codes since the last clear: take many codes at once.
        offsets = at + np.r_[0, np.cumsum(_widths(np.arange(since, since + 4096), least))]
        fit = int(np.searchsorted(offsets[1:], total, "right"))
        if not fit:
            break
        byte = offsets[:fit] >> 3
        word = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        width = np.diff(offsets[: fit + 1])
        codes = (word >> (offsets[:fit] & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        used = int(stop[0]) if len(stop) else fit
        emit, add, size = out.append, table.append, len(table)
        for c in codes[:used].tolist():
            if c < size:
                entry = table[c]
            elif c == size and prev:
                entry = prev + prev[:1]
            else:
                raise ValueError(f"code {c} of a table of {size}")
            emit(entry)
            if prev and size < 4096:
                add(prev + entry[:1])
                size += 1
            prev = entry
        if len(stop):
            at, since = int(offsets[used + 1]), 0
            if codes[used] == end:
                break
            table, prev = list(base), b""
            if len(out) > 1:
                out = [b"".join(out)]
            got = len(out[0]) if out else 0
        else:
            at, since = int(offsets[fit]), since + fit
            got = sum(map(len, out))
    data = b"".join(out)
    if len(data) < n:
        raise ValueError(f"{len(data)} of {n} samples")
    return data[:n]


def encode(payload: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF whose grey levels are the payload's bytes: frames of at most `rows` rows of `width` samples."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    lines = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(lines, rows), 0xF7, 0, 0), bytes(x for i in range(256) for x in (i, i, i))]
    for top in range(0, lines, rows):
        part = payload[top * width : (top + rows) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay_cs, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        packed = _pack(_lzw_codes(part))
        for k in range(0, len(packed), 255):
            block = packed[k : k + 255]
            out.append(bytes([len(block)]) + block)
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


@dataclass
class Frame:
    index: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    canvas: np.ndarray  # height x width x RGBA of the screen once this frame is drawn

    def patch(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]

    def histogram(self, bins: int = BINS) -> list[int]:
        """Pixels by red, green and blue level, `bins` counts a channel, of the opaque part of the screen."""
        seen = self.canvas[self.canvas[..., 3] > 0]
        return [int(n) for ch in range(3) for n in np.bincount(seen[:, ch].astype(np.int64) * bins // 256, minlength=bins)]


def decode(data: bytes):
    """Yield the Frames of a GIF; ValueError for a broken file."""
    try:
        yield from _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError(f"truncated: {e}") from e


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    colours = np.frombuffer(data[at : at + 3 * n], np.uint8)
    if len(colours) < 3 * n:
        raise ValueError("palette cut off")
    return colours.reshape(n, 3), at + 3 * n


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _decode(data: bytes):
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    common, at = _palette(data, 13, flags)
    canvas = np.zeros((high, wide, 4), np.uint8)
    disposal, delay, clear_index, index = 0, 0, None, 0
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label, (body, at) = data[at + 1], _blocks(data, at + 2)
            if label == 0xF9:
                packed, delay, transparent = struct.unpack_from("<BHB", body, 0)
                disposal, clear_index = packed >> 2 & 7, transparent if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"block {kind:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, flags)
        palette, least = common if own is None else own, data[at]
        if palette is None or not 2 <= least <= 8 or left + w > wide or top + h > high:
            raise ValueError("frame header")
        stream, at = _blocks(data, at + 1)
        pixels = np.frombuffer(_unpack_lzw(stream, least, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:
            rows = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
            woven = np.empty_like(pixels)
            woven[rows] = pixels
            pixels = woven
        before = canvas.copy() if disposal == 3 else None
        drawn = np.ones((h, w), bool) if clear_index is None else pixels != clear_index
        if drawn.any() and int(pixels[drawn].max()) >= len(palette):
            raise ValueError("palette index")
        spot = canvas[top : top + h, left : left + w]
        spot[drawn, :3], spot[drawn, 3] = palette[pixels[drawn]], 255
        yield Frame(index, 10 * delay, left, top, w, h, canvas.copy())
        if disposal == 2:
            spot[:] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, clear_index, index = 0, 0, None, index + 1


FRAMES = "frame int, delay_ms int, left int, top int, width int, height int, histogram array<int>, error string"


def frame_rows(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each frame of each GIF in the binary column `media`, with the screen's colour histogram."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if m is None:
                    continue
                try:
                    for f in decode(m):
                        rows.append((k, f.index, f.delay_ms, f.left, f.top, f.width, f.height, f.histogram(), None))
                except ValueError as e:
                    rows.append((k, *[None] * 7, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([batch.schema.field(0).type, *[pa.int32()] * 6, pa.list_(pa.int32()), pa.string()])], [key, *FRAMES.replace(",", "").split()[::2]])

    return df.select(key, media).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {FRAMES}")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of 64, and its length without them."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0"), len(raw)


MEDIA = "n_bytes long, payload_bytes long, media binary"
DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def sample_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload_bytes, media): each text stored losslessly as the samples of a GIF; null: as the empty text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [payload_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([len(p) for p, _ in made], pa.int64()), pa.array([encode(p) for p, _ in made], pa.binary())], [key, "n_bytes", "payload_bytes", "media"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {MEDIA}")


def media_digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read sample_media() back: digests of the payload found in the frames, of the stored form, and a histogram feature."""

    def run(batches):
        for batch in batches:
            rows = []
            for n, media in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts, hist, ms = [], np.zeros(BINS, np.int64), 0
                for f in decode(media):
                    grey = f.patch()[..., 0]
                    parts.append(grey.tobytes())
                    hist += np.bincount(grey.ravel() >> 5, minlength=BINS)
                    ms += f.delay_ms
                payload = b"".join(parts)
                feature = f"{len(parts)} frames {ms} ms " + ",".join(map(str, hist.tolist()))
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], [key, *DIGEST.replace(",", "").split()[::2]])

    return df.select(key, "n_bytes", "media").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {DIGEST}")
