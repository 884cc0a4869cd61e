"""Dates of mixed precision, kept as ISO strings: they are compared as text and never shifted by a time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(x: Column) -> Column:
    return F.substring(x, 1, 10)


def year_month(x: Column) -> Column:
    return F.when(F.length(x) >= 7, F.substring(x, 1, 7))


def _real(y: Column, m: Column, d: Column) -> Column:
    return F.date_format(F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")


def from_dmy(x: Column) -> Column:
    """Minutes in ISO form from day/month/year or ISO, with or without a clock; else null."""
    x = F.trim(F.regexp_replace(x, "\\s+", " "))
    tries = [F.try_to_timestamp(x, F.lit(f)) for f in ("d/M/yyyy H:mm", "d/M/yyyy", "yyyy-M-d H:mm", "yyyy-M-d")]
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd'T'HH:mm")


def _fields(x: Column, order: tuple[str, str, str]) -> Column:
    """struct(value, precision) of the first word that is a date with its fields in this order, and of the clock after it."""
    year_first = order[0] == "y"
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(x, "[T\\s]+", " "), "([0-9])[^0-9:/ -]+", "$1 ")), " ")
    bare = F.transform(words, lambda w: F.regexp_replace(w, "^[^0-9]+", ""))
    shape = "^20[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}" if year_first else "^[0-9]{1,2}[/-][0-9]{1,2}[/-]20[0-9]{2}"
    at = F.array_position(F.transform(bare, lambda w: w.rlike(shape)), True).cast("int")
    parts = F.split(F.regexp_extract(F.try_element_at(bare, at), shape, 0), "[/-]")
    field = lambda name: F.try_element_at(parts, F.lit(order.index(name) + 1))
    date = _real(field("y"), field("m"), field("d"))
    clock = F.split(F.regexp_extract(F.coalesce(F.try_element_at(bare, at + 1), F.lit("")), "^[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?", 0), ":")
    number = lambda i: F.coalesce(F.try_element_at(clock, F.lit(i)).try_cast("int"), F.lit(0))
    timed = F.size(clock) > 1
    text = F.concat_ws(":", *[F.format_string("%02d", number(i)) for i in (1, 2, 3)])
    real = date.isNotNull() & (number(1) < 24) & (number(2) < 60) & (number(3) < 60)
    value = F.when(timed, F.concat(date, F.lit("T"), text)).otherwise(date)
    kind = F.when(F.size(clock) == 3, "second").when(timed, "minute").otherwise("day")
    return F.when(at > 0, F.struct(F.when(real, F.struct(value.alias("value"), kind.alias("precision"))).alias("found")))


def timestamp(x: Column) -> Column:
    """struct(value, precision): a date with the year first is looked for first, then one with the day first.

    Null where there is no date, or one that no calendar or clock has.
    """
    return F.coalesce(_fields(x, ("y", "m", "d")), _fields(x, ("d", "m", "y")))["found"]


_CLOCKED = r"(?:(\d{1,2}:\d{2})\s+)?(\d{2})/(\d{2})/(\d{4})(?:\s+(\d{1,2}:\d{2}))?"


def published(x: Column, zone: str = "+07:00") -> Column:
    """A day, or with a clock before or after it an instant in the zone."""
    g = lambda i: F.regexp_extract(x, _CLOCKED, i)
    date, clock = _real(g(4), g(3), g(2)), F.coalesce(F.nullif(g(1), F.lit("")), F.nullif(g(5), F.lit("")))
    return F.when(x.rlike(_CLOCKED), F.when(clock.isNull(), date).otherwise(F.concat(date, F.lit("T"), F.lpad(clock, 5, "0"), F.lit(f":00{zone}"))))


_PAGE = r"(?<!\d)(\d{1,2})[/-](\d{1,2})[/-](20\d{2})"


def page_day(x: Column) -> Column:
    return F.when(x.rlike(_PAGE), _real(F.regexp_extract(x, _PAGE, 3), F.regexp_extract(x, _PAGE, 2), F.regexp_extract(x, _PAGE, 1)))


def page_day_agrees(x: Column, month: Column) -> Column:
    """The page's day if its month is the one hinted at (or none is)."""
    d = page_day(x)
    return F.when(month.isNull() | (F.substring(d, 1, 7) == month), d)


def capture_instant(x: Column) -> Column:
    """ISO with Z from the 14 digits of a capture, else null."""
    return F.date_format(F.try_to_timestamp(F.when(x.rlike("^\\d{14}$"), x), F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def capture_distance(capture_day: Column, published_day: Column) -> Column:
    """Sort key: captures after publication first, nearest first."""
    d = F.datediff(capture_day, published_day)
    return F.struct(F.when(d >= 0, 0).otherwise(1).alias("late"), F.abs(d).alias("days"))


def pdf_day(url: Column, year: str = "2022") -> Column:
    """The day-month-year at the end of a PDF's name; a random prefix is ignored."""
    p = rf"(\d{{2}})-(\d{{1,2}})-({year})(?:\D|$)"
    name = F.regexp_extract(url, "([^/?#]*)(?:[?#].*)?$", 1)
    return F.when(name.rlike(p), _real(F.regexp_extract(name, p, 3), F.regexp_extract(name, p, 2), F.regexp_extract(name, p, 1)))


def issue(x: Column) -> Column:
    """struct(number, day) of an issue line such as 15.024 (16-07-2026)."""
    p = r"(\d{1,3}\.\d{1,4})\s*\((\d{2})[-.](\d{2})[-.](\d{4})\)"
    return F.when(x.rlike(p), F.struct(F.regexp_extract(x, p, 1).alias("number"), _real(F.regexp_extract(x, p, 4), F.regexp_extract(x, p, 3), F.regexp_extract(x, p, 2)).alias("day")))


def within(x: Column, first: str, last: str) -> Column:
    return day(x).between(first, last)


def months(spark, first: str, last: str):
    """(year_month) for every month from first to last."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first[:7] + "-01")), F.to_date(F.lit(last[:7] + "-01")), F.expr("interval 1 month"))).alias("m")).select(F.date_format("m", "yyyy-MM").alias("year_month"))
