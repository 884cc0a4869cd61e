"""Archive members: gzip, WARC and ARC records, HTTP entities, and HTML bytes of unknown encoding."""

from __future__ import annotations

import gzip
import html
import re
import zlib

from pyspark.sql import functions as F

_BYTES = "struct<content: binary, error: string>"


def _gunzip(data: bytes, what: str) -> bytes:
    try:
        return gzip.decompress(data)
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError(f"{what} is no complete gzip") from e


def http_entity(member: bytes) -> bytes:
    """The HTTP body that a gzipped WARC or ARC member holds; ValueError names the stage that fails."""
    record = _gunzip(member, "range")
    head, blank, rest = record.partition(b"\r\n\r\n") if record[:5] == b"WARC/" else record.partition(b"\n")
    if not blank:
        raise ValueError("record has no end of its header")
    if record[:5] != b"WARC/" and not re.match(rb"https?://", head):
        raise ValueError("neither WARC nor ARC")
    if rest[:5] == b"HTTP/":
        _, blank, rest = rest.partition(b"\r\n\r\n")
        if not blank:
            raise ValueError("response has no end of its header")
    if rest[:2] == b"\x1f\x8b":
        rest = _gunzip(rest, "entity")
    if not rest:
        raise ValueError("entity is empty")
    return rest


def decoded(data: bytes) -> str:
    """Text of an HTML page: byte order mark, declared charset, UTF-8, Windows-1252, then UTF-8 with replacement."""
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "replace")
    named = re.search(rb"charset=[\"']?\s*([A-Za-z0-9_.:-]+)", data[:4096])
    for name in ([named[1].decode("ascii")] if named else []) + ["utf-8", "windows-1252"]:
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", "replace")


def entity_text(data: bytes) -> str:
    """As decoded(), but a page of numeric entities has them resolved."""
    return html.unescape(data.decode("latin-1")) if b"&#" in data else decoded(data)


def _checked(f):
    def one(data):
        if data is None:
            return None
        try:
            return {"content": f(bytes(data)), "error": None}
        except ValueError as e:
            return {"content": None, "error": str(e)}

    return one


def gunzip(x):
    """struct(content, error); what is no gzip stays as it is."""
    return F.udf(_checked(lambda d: _gunzip(d, "file") if d[:2] == b"\x1f\x8b" else d), _BYTES, useArrow=True)(x)


def extract_entity(x):
    """struct(content, error) of an archive member."""
    return F.udf(_checked(http_entity), _BYTES, useArrow=True)(x)


def decode_html(x):
    return F.udf(lambda d: None if d is None else decoded(bytes(d)), "string", useArrow=True)(x)


def entity_html(x):
    return F.udf(lambda d: None if d is None else entity_text(bytes(d)), "string", useArrow=True)(x)
