from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import dates, html, screen, text, urls


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTPS://Example.COM/a?utm_source=x&b=1&GCLID=2&c=#top", "https://example.com/a?b=1&c="), ("http://h/p?x=1&x=2", "http://h/p?x=1&x=2"), ("  http://h/ ", "http://h/"), ("", None), ("no scheme at all", "no scheme at all")],
)
def test_canonical(spark, url, want):
    assert one(spark, urls.canonical(F.col("u")), u=url) == want


def test_url_kinds(spark):
    got = lambda f, u: one(spark, f(F.col("u")), u=u)
    assert got(urls.staging, "Http://H.org:80/a?b#c") == "http://h.org/a?b" and got(urls.staging, "https://h:80/a") == "https://h/a"
    assert got(urls.scheme_port, "https://H:80/a") == "https://h:80/a" and got(urls.scheme_port, "https://H:443/a") == "https://h/a"
    assert got(urls.dedupe_key, "http://WWW.h.org//A%20b//C/") == "h.org/a b/c"
    assert got(urls.dedupe_key, "http://h/pasaxon-detail.php?act=Leader&p_id=07") == "h/pasaxon-detail.php?p_id=07&act=leader"
    assert got(urls.url_key, "http://h/pasaxon-detail.php?p_id=007") == "php:7" and got(urls.url_key, "http://h/A/b/") == "/a/b"
    assert got(urls.source_path, "http://h/Leader/2018/1.html") == "leader" and got(urls.source_path, "http://h") == ""
    ident = lambda u: (lambda r: r and tuple(r))(got(urls.identity, u))
    assert ident("http://h/s/2018/02/03/a12.html") == ("2018-02-03", "2018-02", 12)
    assert ident("http://h/s/3-2-14/7.htm") == ("2014-02-03", "2014-02", 7)
    assert ident("http://h/s/31-2-14/7.htm") is None
    assert ident("http://h/s/2019/05/s3.html") == (None, "2019-05", 3)
    assert ident("http://h/pasaxon-detail.php?p_id=44") == (None, None, 44) and ident("http://h/x.html") is None
    assert got(urls.replay, "https://w/web/2020/http://x") == "https://w/web/2020id_/http://x"
    assert got(urls.article_kind, "http://h/s/2021/02/03/1.html") == "exact_dated" and got(urls.article_kind, "http://h/tags/x-1.html") is None


def test_dates(spark):
    ts = lambda x: (lambda r: r and tuple(r))(one(spark, dates.timestamp(F.col("x")), x=x))
    assert ts("at 24/06/2014 11:20") == ("2014-06-24T11:20:00", "minute") and ts("2014-6-4") == ("2014-06-04", "day")
    assert ts("2014-06-17 03:37:09") == ("2014-06-17T03:37:09", "second") and ts("31/02/2014") is None and ts("x") is None
    pub = lambda x: one(spark, dates.published(F.col("x")), x=x)
    assert pub("13:48 30/07/2026") == "2026-07-30T13:48:00+07:00" and pub("04/01/2020 9:30") == "2020-01-04T09:30:00+07:00" and pub("04/01/2020") == "2020-01-04" and pub("?") is None
    assert one(spark, dates.from_dmy(F.col("x")), x="5/6/2012 7:08") == "2012-06-05T07:08" and one(spark, dates.from_dmy(F.col("x")), x="2012-13-01") is None
    assert one(spark, dates.pdf_day(F.col("x")), x="http://h/31-12-1999-05-3-2022.pdf") == "2022-03-05"
    assert tuple(one(spark, dates.issue(F.col("x")), x="15.024 (16-07-2026)")) == ("15.024", "2026-07-16")
    assert one(spark, dates.capture_instant(F.col("x")), x="20200102030405") == "2020-01-02T03:04:05Z" and one(spark, dates.capture_instant(F.col("x")), x="20209902030405") is None
    assert one(spark, dates.year_month(F.col("x")), x="2014") is None
    assert dates.months(spark, "2012-01-01", "2026-08-07").count() == 176


def test_text(spark):
    assert one(spark, text.clean_lines(F.col("x")), x=" a  b\n\na b\n​c\na b") == "a b\nc\na b"
    assert one(spark, text.normalized(F.col("x")), x=" é &amp;​\n x ") == "é & x"
    assert one(spark, text.match_key(F.col("x")), x="Straße — ຈີນ!") == "strasseຈີນ"
    assert one(spark, text.collapse(F.col("x")), x="﻿ a  b ") == "a b"
    assert one(spark, text.titles_agree(F.col("a"), F.col("b")), a="Lao China rail", b="lao-china RAIL opens") is True
    assert one(spark, text.titles_agree(F.col("a"), F.col("b")), a="", b="x") is False
    assert one(spark, text.language_of(F.col("x")), x="ຈີນ abc") == "lo" and one(spark, text.language_of(F.col("x")), x="") == "en"
    assert one(spark, text.usable_title(F.col("t"), F.col("b")), t="��x", b="\n ຫົວຂໍ້ \nz") == "ຫົວຂໍ້"
    assert [one(spark, text.confidence(F.col("x")), x=x) for x in ("87", "0.5", "-1", "no", "300")] == [0.87, 0.5, 0.0, None, 1.0]
    assert one(spark, text.numbered_id("KPL-LAO", F.col("x")), x="1234567") == "KPL-LAO-1234567"


def test_screens(spark):
    hits = lambda f, x, *a: one(spark, F.array_join(f(F.col("x"), *a), "|"), x=x)
    assert hits(screen.token_hits, "ລາວ - ຈີນ") == "ຈີນ|ລາວ-ຈີນ"
    assert hits(screen.term_hits, "CHINA and Yunnan") == "china|yunnan"
    assert hits(screen.strict_hits, "Indochina war") == "" and hits(screen.strict_hits, "INDOCHINA war") == "china"
    assert hits(screen.context_hits, "ອິນໂດຈີນ") == "" and hits(screen.context_hits, "ທ້າວ ຈີນ ມາ") == "" and hits(screen.context_hits, "ຈີນ ແລະ ຈີນ") == "ຈີນ" and hits(screen.context_hits, "ປະເທດ ຈີນ") == "ຈີນ"
    got = one(spark, screen.keyword_contexts(F.col("x"), ("China", "Chinese"), 3), x="a China b Chinese c china")
    assert [(r["start"], r["end"], r["keyword"], r["context"]) for r in got] == [(2, 7, "China", "a China b"), (10, 17, "Chinese", "b Chinese c"), (20, 25, "China", "c china")]
    assert one(spark, screen.contaminated(F.col("x")), x="Toggle navigation agen togel lapak online") is True and one(spark, screen.contaminated(F.col("x")), x="agen togel lapak online") is False
    assert one(spark, screen.grade_in(F.col("x")), x="XA1 (B2)") == "B2" and one(spark, screen.grade_in(F.col("x")), x="?") == "C2"
    assert one(spark, screen.formal(F.col("g"), F.col("m")), g="C1", m='{"second_corroboration": true}') is True and one(spark, screen.formal(F.col("g"), F.col("m")), g="C1", m="{}") is False
    assert one(spark, screen.family(F.col("x")), x="kpl_lao") == "KPL" and one(spark, screen.family(F.col("x")), x="other") == "OTHER"
    items = spark.createDataFrame([([(1.0, 2.0, "ຂ"), (1.0, 1.0, "ກ ຈີນ"), (60.0, 1.0, "ຄ"), (2.0, 3.0, "xqz")],)], "items array<struct<x double, y double, text string>>")
    assert items.select(screen.column_text(F.col("items"), [(0, 50), (50, 100)], 0, 10).alias("t")).first()["t"] == "ກ ຈີນ\nຂ\n\nຄ\n"


def test_html(spark):
    page = "<script>var a='</p>';</script><h1>A &amp; b</h1><p>one<p>two <a href='/x'>li<b>nk</b></a>"
    assert one(spark, html.visible_text(F.col("x")), x=page) == "A & b\none\ntwo link"
    assert [tuple(a) for a in one(spark, html.anchors(F.col("x")), x=page)] == [("/x", "link")]
    assert one(spark, html.absolute(F.lit("http://h/a/b?c"), F.col("x")), x="d") == "http://h/a/d" and one(spark, html.absolute(F.lit("http://h/a/b"), F.col("x")), x="/d") == "http://h/d"


def test_capture_distance_prefers_later(spark):
    day = dt.date(2021, 5, 5)
    rows = [(i, day + dt.timedelta(days=random.Random(i).randrange(-9, 9)), day) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, c date, p date").orderBy(dates.capture_distance(F.col("c"), F.col("p")), "i")
    want = sorted(rows, key=lambda r: ((0, (r[1] - r[2]).days) if r[1] >= r[2] else (1, (r[2] - r[1]).days), r[0]))
    assert [r["i"] for r in df.collect()] == [r[0] for r in want]
