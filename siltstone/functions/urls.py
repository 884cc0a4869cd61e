"""URL functions as column expressions. They split by pattern, so malformed URLs never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, name: str) -> Column:
    """scheme, netloc, path, query or fragment; empty where absent."""
    return F.regexp_extract(url, _PARTS, ("scheme", "netloc", "path", "query", "fragment").index(name) + 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, "netloc"), "^.*@", ""), ":\\d*$", ""))


def port(url: Column) -> Column:
    return F.regexp_extract(part(url, "netloc"), ":(\\d+)$", 1)


def _joined(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no tracking keys, no fragment; other pairs stay in order, blank values too."""
    u = F.trim(url)
    pairs = F.filter(F.split(part(u, "query"), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*vocab.TRACKING_KEYS))
    pairs = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    out = _joined(F.lower(part(u, "scheme")), F.lower(part(u, "netloc")), part(u, "path"), F.array_join(pairs, "&"))
    return F.when(F.trim(url) != "", out)


def staging(url: Column) -> Column:
    """Lower-case scheme (http by default) and host without the ports 80 and 443; path and query stay."""
    p = port(url)
    netloc = F.concat(host(url), F.when(~p.isin("", "80", "443"), F.concat(F.lit(":"), p)).otherwise(""))
    return _joined(F.coalesce(F.nullif(F.lower(part(url, "scheme")), F.lit("")), F.lit("http")), netloc, part(url, "path"), part(url, "query"))


def scheme_port(url: Column) -> Column:
    """As staging(), but only the scheme's own port goes."""
    p, s = port(url), F.lower(part(url, "scheme"))
    own = ((s == "http") & (p == "80")) | ((s == "https") & (p == "443")) | (p == "")
    return _joined(s, F.concat(host(url), F.when(~own, F.concat(F.lit(":"), p)).otherwise("")), part(url, "path"), part(url, "query"))


def query_value(url: Column, key: str) -> Column:
    """The first value of a query key, null if absent or blank."""
    return F.nullif(F.regexp_extract(part(url, "query"), f"(?:^|&){key}=([^&]*)", 1), F.lit(""))


DETAIL = "pasaxon-detail.php"


def dedupe_key(url: Column, detail: str = DETAIL) -> Column:
    """Host without www. and decoded path in lower case, slashes merged; detail pages keep p_id and act."""
    h = F.regexp_replace(host(url), "^www\\.", "")
    raw = part(url, "path")
    path = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(F.try_url_decode(F.regexp_replace(raw, "\\+", "%2B")), raw), "//", "/"), "/+$", ""))
    pid = F.concat(F.lit("?p_id="), F.coalesce(query_value(url, "p_id"), F.lit("")), F.lit("&act="), F.lower(F.coalesce(query_value(url, "act"), F.lit(""))))
    return F.concat(h, path, F.when(F.endswith(path, F.lit(detail)), pid).otherwise(""))


def url_key(url: Column, detail: str = DETAIL) -> Column:
    """php:<number> of a detail page, else the lower-case path without its last slash."""
    path, pid = F.lower(part(url, "path")), query_value(url, "p_id")
    numeric = F.endswith(path, F.lit(detail)) & F.coalesce(pid.rlike("^\\d+$"), F.lit(False))
    return F.when(numeric, F.concat(F.lit("php:"), F.regexp_replace(pid, "^0+(?=\\d)", ""))).otherwise(F.regexp_replace(path, "/+$", ""))


def source_path(url: Column, detail: str = DETAIL) -> Column:
    """The lower-case first segment of the path; a detail page is its own."""
    path = F.lower(part(url, "path"))
    return F.when(F.endswith(path, F.lit(detail)), detail).otherwise(F.regexp_extract(path, "^/*([^/]*)", 1))


_YMD = r"/((?:19|20)\d{2})/(\d{1,2})/(\d{1,2})/([^/?#]*?\d+[^/?#]*)\.html?"
_DMY = r"/(\d{1,2})-(\d{1,2})-(\d{4}|\d{2})/([^/?#]*?\d+[^/?#]*)\.html?"
_MONTH = r"/((?:19|20)\d{2})/(\d{1,2})/([^/?#]*?\d+[^/?#]*)\.html?"


def _date(y: Column, m: Column, d: Column) -> Column:
    """An ISO day, or null for no calendar day."""
    day = F.try_to_date(F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return F.date_format(day, "yyyy-MM-dd")


def identity(url: Column) -> Column:
    """struct(day, month, slot) that a URL itself tells: year-month-day path, day-month-year path, month path or page number; else null.

    A date that no calendar has makes the whole null.
    """
    g = lambda p, i: F.regexp_extract(url, p, i)
    digits = lambda x: F.regexp_replace(x, "\\D", "").cast("long")
    ymd = _date(g(_YMD, 1), g(_YMD, 2), g(_YMD, 3))
    year = F.when(F.length(g(_DMY, 3)) == 2, F.concat(F.lit("20"), g(_DMY, 3))).otherwise(g(_DMY, 3))
    dmy = _date(year, g(_DMY, 2), g(_DMY, 1))
    month = F.substring(_date(g(_MONTH, 1), g(_MONTH, 2), F.lit("1")), 1, 7)
    pid = query_value(url, "p_id")
    made = lambda day, mon, slot: F.struct(day.alias("day"), mon.alias("month"), slot.alias("slot"))
    none = F.lit(None).cast("string")
    return (
        F.when(url.rlike(_YMD), F.when(ymd.isNotNull(), made(ymd, F.substring(ymd, 1, 7), digits(g(_YMD, 4)))))
        .when(url.rlike(_DMY), F.when(dmy.isNotNull(), made(dmy, F.substring(dmy, 1, 7), digits(g(_DMY, 4)))))
        .when(url.rlike(_MONTH), F.when(month.isNotNull(), made(none, month, digits(g(_MONTH, 3)))))
        .when(F.endswith(F.lower(part(url, "path")), F.lit(DETAIL)) & F.coalesce(pid.rlike("^\\d+$"), F.lit(False)), made(none, none, pid.cast("long")))
    )


def record_slot(url: Column) -> Column:
    """struct(day, slot) of an old agency address .../newsrecord/<year>/<month's name>/<d>.<m>.<year>/edn<slot>.htm, else null.

    Both years must be the same and the day must exist.
    """
    parts = F.split(F.lower(url), "/")
    last = lambda n: F.try_element_at(parts, F.lit(-n))
    dmy = F.split(last(2), "\\.")
    number = lambda i: F.coalesce(F.try_element_at(dmy, F.lit(i)), F.lit(""))
    slot = F.regexp_extract(last(1), "^edn([0-9]+)\\.htm$", 1)
    day = _date(number(3), number(2), number(1))
    fits = (last(5) == "newsrecord") & last(4).rlike("^20[0-9]{2}$") & last(3).rlike("^[a-z]+$") & (F.size(dmy) == 3) & (number(3) == last(4)) & number(1).rlike("^[0-9]{1,2}$") & number(2).rlike("^[0-9]{1,2}$")
    return F.when(fits & (slot != "") & day.isNotNull(), F.struct(day.alias("day"), slot.cast("long").alias("slot")))


def article_kind(url: Column, first_year: int = 2021, last_year: int = 2022) -> Column:
    day, path = identity(url)["day"], F.regexp_replace(F.lower(part(url, "path")), "/+$", "")
    return (
        F.when(F.substring(day, 1, 4).cast("int").between(first_year, last_year), "exact_dated")
        .when(F.endswith(path, F.lit(DETAIL)) & F.coalesce(query_value(url, "p_id").rlike("^\\d+$"), F.lit(False)), "php_detail_page_date_required")
        .when(path.rlike("-\\d+\\.html$") & ~path.rlike("^/(search|tags)/"), "slug_article_page_date_required")
    )


def replay(url: Column) -> Column:
    """The raw form of an archive's replay URL, marked once."""
    return F.regexp_replace(url, "/web/(\\d+)/", "/web/$1id_/")
