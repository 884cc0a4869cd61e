"""HTML in column expressions: visible text, anchors, headings. Parsers that need a tree are in operators.extract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
_BLOCKS = "p|div|section|article|h[1-6]|li|br|tr|ul|nav|footer|header|title"


def plain(x: Column) -> Column:
    """Tags dropped, common entities decoded, spaces collapsed."""
    x = F.regexp_replace(x, "<[^>]*>", "")
    for e, c in _ENTITIES:
        x = F.replace(x, F.lit(e), F.lit(c))
    return F.trim(F.regexp_replace(x, "[ \\t\\r\\f]+", " "))


def without_code(x: Column) -> Column:
    for tag in ("script", "style", "noscript"):
        x = F.regexp_replace(x, f"(?is)<{tag}\\b.*?</{tag}\\s*>", "")
    return x


def visible_text(x: Column) -> Column:
    """Text a reader sees, one block a line, blank lines dropped."""
    x = F.regexp_replace(without_code(x), f"(?i)</?(?:{_BLOCKS})\\b[^>]*>", "\n")
    lines = F.transform(F.split(x, "\n"), plain)
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def anchors(x: Column) -> Column:
    """array<struct(href, text)> of links in order."""
    pattern = "(?is)<a\\s[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    both = F.arrays_zip(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(x, F.lit(pattern), F.lit(2)).alias("text"))
    return F.transform(both, lambda p: F.struct(p["href"].alias("href"), plain(p["text"]).alias("text")))


def headings(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit("(?is)<h[1-3]\\b[^>]*>(.*?)</h[1-3]>"), F.lit(1)), plain)


def first_heading(x: Column, least: int = 5, script: str = "[຀-໿]", least_script: int = 3) -> Column:
    """The first heading of `least` characters with enough of a script."""
    return F.get(F.filter(headings(x), lambda h: (F.length(h) >= least) & (F.regexp_count(h, F.lit(script)) >= least_script)), F.lit(0))


def absolute(base: Column, href: Column) -> Column:
    """href against its page: whole URLs stay, paths from the root take the host, others the folder."""
    root = F.regexp_extract(base, "^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), "^([a-zA-Z]+://[^/]+(?:/[^/]*)*?)/[^/]*$", 1)
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(F.coalesce(F.nullif(folder, F.lit("")), root), F.lit("/"), href))
