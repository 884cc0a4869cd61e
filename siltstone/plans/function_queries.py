"""Queries that exercise the column functions on the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, html, screen, text, urls
from ..operators import queues
from .corpus_view import ARTICLES, articles, table, with_

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents")


def pages(spark, d):
    return table(spark, d, "pages")


@query("f01_text_normalized", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[\x{200b}-\x{200d}\x{feff}]', '', 'g'), '\s+', ' ', 'g'))) AS sha FROM documents")
def f01(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(text.collapse(F.col("text")), 256).alias("sha"))


@query("f03_clean_lines", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '[\t\r\f\v ]+', ' ', 'g'))), lambda s: s <> '') AS v FROM documents)
SELECT doc_id, sha256(array_to_string(list_filter(v, lambda s, i: i = 1 OR s <> v[i - 1]), chr(10))) AS sha FROM l""")
def f03(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(text.clean_lines(F.col("text")), 256).alias("sha"))


_P = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_SPLIT = f"SELECT page_id, u, regexp_extract(u, '{_P}', 1) AS scheme, regexp_extract(u, '{_P}', 2) AS netloc, regexp_extract(u, '{_P}', 3) AS path, regexp_extract(u, '{_P}', 4) AS q"


@query("f07_canonical_url", f"""WITH s AS ({_SPLIT} FROM (SELECT page_id, url AS u FROM pages)),
p AS (SELECT *, array_to_string(list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('utm_source','utm_medium','utm_campaign','fbclid','gclid')), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') AS kept FROM s)
SELECT page_id, lower(scheme) || '://' || lower(netloc) || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url FROM p""")
def f07(spark, d):
    return pages(spark, d).select("page_id", urls.canonical(F.col("url")).alias("url"))


def _ported(spark, d):
    port = F.element_at(F.array(*map(F.lit, [":80", ":443", ":8080", ""])), (F.col("page_id") % 4 + 1).cast("int"))
    return pages(spark, d).select("page_id", F.concat(F.upper(urls.part(F.col("url"), "scheme")), F.lit("://WWW."), urls.part(F.col("url"), "netloc"), port, F.lit("//A%20b"), urls.part(F.col("url"), "path"), F.lit("?x=1#f")).alias("u"))


_PORTED = f"""r AS ({_SPLIT} FROM (SELECT page_id, url AS u FROM pages)),
v AS (SELECT page_id, upper(scheme) || '://WWW.' || netloc || [':80',':443',':8080',''][page_id % 4 + 1] || '//A%20b' || path || '?x=1#f' AS u, lower(scheme) AS s, lower('WWW.' || netloc) AS h, [':80',':443',':8080',''][page_id % 4 + 1] AS p, '//A%20b' || path AS path FROM r)"""


@query("f08_staging_url", with_(_PORTED) + "SELECT page_id, s || '://' || h || CASE WHEN p = ':8080' THEN p ELSE '' END || path || '?x=1' AS url FROM v")
def f08(spark, d):
    return _ported(spark, d).select("page_id", urls.staging(F.col("u")).alias("url"))


@query("f09_scheme_port_url", with_(_PORTED) + "SELECT page_id, s || '://' || h || CASE WHEN p = ':8080' OR (p = ':80' AND s <> 'http') OR (p = ':443' AND s <> 'https') THEN p ELSE '' END || path || '?x=1' AS url FROM v")
def f09(spark, d):
    return _ported(spark, d).select("page_id", urls.scheme_port(F.col("u")).alias("url"))


@query("f10_dedupe_key", with_(_PORTED) + "SELECT page_id, regexp_replace(h, '^www\\.', '') || regexp_replace(replace(lower(replace(path, '%20', ' ')), '//', '/'), '/+$', '') AS url FROM v")
def f10(spark, d):
    return _ported(spark, d).select("page_id", urls.dedupe_key(F.col("u")).alias("url"))


def _dated(spark, d):
    i = F.col("doc_id")
    u = (
        F.when(i % 6 == 0, F.format_string("http://h.org/Sec/2018/%d/%d/a%d.html", i % 14 + 1, i % 31 + 1, i))
        .when(i % 6 == 1, F.format_string("http://h.org/sec/%02d-%02d-14/%d.htm", i % 31 + 1, i % 13 + 1, i))
        .when(i % 6 == 2, F.format_string("http://h.org/sec/2019/%02d/s%d.html", i % 13 + 1, i))
        .when(i % 6 == 3, F.format_string("http://h.org/pasaxon-detail.php?p_id=%d&act=Leader", i * 3))
        .when(i % 6 == 4, F.format_string("http://h.org/search/x-%d.html", i))
        .otherwise(F.format_string("http://h.org/news/x-%d.html", i))
    )
    return docs(spark, d).select("doc_id", u.alias("u"))


_DATED = """v AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN printf('http://h.org/Sec/2018/%d/%d/a%d.html', doc_id % 14 + 1, doc_id % 31 + 1, doc_id) WHEN 1 THEN printf('http://h.org/sec/%02d-%02d-14/%d.htm', doc_id % 31 + 1, doc_id % 13 + 1, doc_id)
 WHEN 2 THEN printf('http://h.org/sec/2019/%02d/s%d.html', doc_id % 13 + 1, doc_id) WHEN 3 THEN printf('http://h.org/pasaxon-detail.php?p_id=%d&act=Leader', doc_id * 3)
 WHEN 4 THEN printf('http://h.org/search/x-%d.html', doc_id) ELSE printf('http://h.org/news/x-%d.html', doc_id) END AS u FROM documents),
t AS (SELECT *, strftime(CASE doc_id % 6 WHEN 0 THEN try_strptime(printf('2018-%02d-%02d', doc_id % 14 + 1, doc_id % 31 + 1), '%Y-%m-%d') WHEN 1 THEN try_strptime(printf('2014-%02d-%02d', doc_id % 13 + 1, doc_id % 31 + 1), '%Y-%m-%d') END, '%Y-%m-%d') AS day,
 CASE WHEN doc_id % 6 = 2 AND doc_id % 13 + 1 <= 12 THEN printf('2019-%02d', doc_id % 13 + 1) END AS mon FROM v)"""


@query("f12_url_identity", with_(_DATED) + """SELECT doc_id, day, coalesce(substr(day, 1, 7), mon) AS month, CASE WHEN day IS NOT NULL OR mon IS NOT NULL THEN doc_id WHEN doc_id % 6 = 3 THEN doc_id * 3 END AS slot FROM t""")
def f12(spark, d):
    one = urls.identity(F.col("u"))
    return _dated(spark, d).select("doc_id", one["day"].alias("day"), one["month"].alias("month"), one["slot"].alias("slot"))


@query("f11_url_key", with_(_DATED) + "SELECT doc_id, CASE WHEN doc_id % 6 = 3 THEN 'php:' || (doc_id * 3) ELSE regexp_replace(lower(regexp_extract(u, '^http://[^/]*([^?]*)', 1)), '/+$', '') END AS key, CASE WHEN doc_id % 6 = 3 THEN 'pasaxon-detail.php' ELSE lower(split_part(u, '/', 4)) END AS category FROM v")
def f11(spark, d):
    return _dated(spark, d).select("doc_id", urls.url_key(F.col("u")).alias("key"), urls.source_path(F.col("u")).alias("category"))


@query("p11_article_kind", with_(_DATED) + "SELECT doc_id, CASE WHEN substr(day, 1, 4) BETWEEN '2014' AND '2016' THEN 'exact_dated' WHEN doc_id % 6 = 3 THEN 'php_detail_page_date_required' WHEN doc_id % 6 = 5 THEN 'slug_article_page_date_required' END AS kind FROM t")
def p11(spark, d):
    return _dated(spark, d).select("doc_id", urls.article_kind(F.col("u"), 2014, 2016).alias("kind"))


_VALID = """q AS (SELECT t.doc_id, u, CASE WHEN doc_id % 4 = 0 THEN '1999-01-01' ELSE day END AS published_at FROM t),
k AS (SELECT *, coalesce(published_at = (SELECT day FROM t WHERE t.doc_id = q.doc_id), FALSE) AS ok FROM q)"""


@query("p13_valid_queue_rows", with_(_DATED, _VALID) + "SELECT doc_id, substr(published_at, 1, 7) AS year_month, TRUE AS valid FROM k WHERE ok UNION ALL SELECT doc_id, NULL, FALSE FROM k WHERE NOT ok")
def p13(spark, d):
    day = urls.identity(F.col("u"))["day"]
    q = _dated(spark, d).select("doc_id", F.col("u").alias("original_url"), F.when(F.col("doc_id") % 4 == 0, "1999-01-01").otherwise(day).alias("published_at"), F.col("doc_id").alias("queue_pos"))
    good, bad = queues.valid_rows(q)
    return good.select("doc_id", "year_month", F.lit(True).alias("valid")).unionByName(bad.select("doc_id", F.lit(None).cast("string").alias("year_month"), F.lit(False).alias("valid")))


@query("p14_eligible_queue_rows", with_(_DATED) + "SELECT doc_id FROM t WHERE day IS NOT NULL")
def p14(spark, d):
    q = _dated(spark, d).select("doc_id", F.col("u").alias("original_url"), urls.identity(F.col("u"))["day"].alias("published_at"))
    return queues.eligible_rows(q, ("h.org",)).select("doc_id")


@query("f33_replay_url", "SELECT doc_id, 'https://w.org/web/' || (20200101000000 + doc_id) || 'id_/http://x.org/' || doc_id AS url FROM documents")
def f33(spark, d):
    u = F.concat(F.lit("https://w.org/web/"), (F.lit(20200101000000) + F.col("doc_id")).cast("string"), F.lit("/http://x.org/"), F.col("doc_id").cast("string"))
    return docs(spark, d).select("doc_id", urls.replay(urls.replay(u)).alias("url"))


def _stamped(spark, d):
    i = F.col("doc_id")
    x = (
        F.when(i % 5 == 0, F.format_string("%d/%d/2020 %d:%02d", i % 31 + 1, i % 13 + 1, i % 24, i % 60))
        .when(i % 5 == 1, F.format_string("%02d/%02d/2020", i % 31 + 1, i % 12 + 1))
        .when(i % 5 == 2, F.format_string("2021-%02d-%02d %02d:%02d", i % 12 + 1, i % 31 + 1, i % 24, i % 60))
        .when(i % 5 == 3, F.format_string("2021-%02d-%02d", i % 12 + 1, i % 31 + 1))
        .otherwise("no date")
    )
    return docs(spark, d).select("doc_id", x.alias("x"))


_STAMPED = """v AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN printf('%d/%d/2020 %d:%02d', doc_id % 31 + 1, doc_id % 13 + 1, doc_id % 24, doc_id % 60) WHEN 1 THEN printf('%02d/%02d/2020', doc_id % 31 + 1, doc_id % 12 + 1)
 WHEN 2 THEN printf('2021-%02d-%02d %02d:%02d', doc_id % 12 + 1, doc_id % 31 + 1, doc_id % 24, doc_id % 60) WHEN 3 THEN printf('2021-%02d-%02d', doc_id % 12 + 1, doc_id % 31 + 1) ELSE 'no date' END AS x FROM documents),
p AS (SELECT *, coalesce(try_strptime(x, '%d/%m/%Y %H:%M'), try_strptime(x, '%d/%m/%Y'), try_strptime(x, '%Y-%m-%d %H:%M'), try_strptime(x, '%Y-%m-%d')) AS ts FROM v)"""


@query("f16_iso_from_dmy", with_(_STAMPED) + "SELECT doc_id, strftime(ts, '%Y-%m-%dT%H:%M') AS value FROM p")
def f16(spark, d):
    return _stamped(spark, d).select("doc_id", dates.from_dmy(F.col("x")).alias("value"))


@query("f17_timestamp", with_(_STAMPED) + "SELECT doc_id, CASE WHEN contains(x, ':') THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%d') END AS value, CASE WHEN ts IS NULL THEN NULL WHEN contains(x, ':') THEN 'minute' ELSE 'day' END AS precision FROM p")
def f17(spark, d):
    one = dates.timestamp(F.col("x"))
    return _stamped(spark, d).select("doc_id", one["value"].alias("value"), one["precision"].alias("precision"))


@query("f18_published_at", with_(_STAMPED) + "SELECT doc_id, CASE WHEN regexp_matches(x, '\\d{2}/\\d{2}/\\d{4}') THEN CASE WHEN contains(x, ':') THEN strftime(ts, '%Y-%m-%dT%H:%M') || ':00+07:00' ELSE strftime(ts, '%Y-%m-%d') END END AS value FROM p")
def f18(spark, d):
    return _stamped(spark, d).select("doc_id", dates.published(F.col("x")).alias("value"))


@query("f19_page_date", with_(_STAMPED) + "SELECT doc_id, CASE WHEN doc_id % 5 < 2 AND strftime(ts, '%Y-%m') = '2020-03' THEN strftime(ts, '%Y-%m-%d') END AS value FROM p")
def f19(spark, d):
    return _stamped(spark, d).select("doc_id", dates.page_day_agrees(F.col("x"), F.lit("2020-03")).alias("value"))


@query("f20_capture_instant", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN strftime(try_strptime(printf('2019%02d%02d%02d0101', doc_id % 13 + 1, doc_id % 31 + 1, doc_id % 24), '%Y%m%d%H%M%S'), '%Y-%m-%dT%H:%M:%SZ') END AS value FROM documents")
def f20(spark, d):
    i = F.col("doc_id")
    x = F.when(i % 2 == 0, F.format_string("2019%02d%02d%02d0101", i % 13 + 1, i % 31 + 1, i % 24)).otherwise("bad")
    return docs(spark, d).select("doc_id", dates.capture_instant(x).alias("value"))


@query("f14_pdf_day", "SELECT doc_id, strftime(try_strptime(printf('2022-%02d-%02d', doc_id % 13 + 1, doc_id % 31 + 1), '%Y-%m-%d'), '%Y-%m-%d') AS day, printf('%02d.%03d', doc_id % 90 + 10, doc_id % 1000) AS number FROM documents")
def f14(spark, d):
    i = F.col("doc_id")
    pdf = F.format_string("http://x.org/f/77-1-%02d-%d-2022.pdf", i % 31 + 1, i % 13 + 1)
    issue = dates.issue(F.format_string("No %02d.%03d (01-01-2022)", i % 90 + 10, i % 1000))
    return docs(spark, d).select("doc_id", dates.pdf_day(pdf).alias("day"), issue["number"].alias("number"))


@query("f24_stable_ids", "SELECT doc_id, 'DOC-' || substr(sha256(text), 1, 16) AS hashed, 'DOC-' || printf('%06d', doc_id * 5000) AS numbered FROM documents")
def f24(spark, d):
    return docs(spark, d).select("doc_id", text.stable_id("DOC", F.col("text")).alias("hashed"), text.numbered_id("DOC", F.col("doc_id") * 5000).alias("numbered"))


@query("f26_language", "WITH v AS (SELECT doc_id, repeat('ລາວ', CAST(doc_id % 4 * 60 AS INT)) || text AS t FROM documents) SELECT doc_id, CASE WHEN length(regexp_replace(t, '[^\\x{0e80}-\\x{0eff}]', '', 'g')) >= greatest(1, length(regexp_replace(t, '[^\\p{L}]', '', 'g')) // 3) THEN 'lo' ELSE 'en' END AS language FROM v")
def f26(spark, d):
    return docs(spark, d).select("doc_id", text.language_of(F.concat(F.repeat(F.lit("ລາວ"), (F.col("doc_id") % 4 * 60).cast("int")), F.col("text"))).alias("language"))


@query("f27_title_repair", "WITH v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '  ' WHEN doc_id % 3 = 1 THEN ' ok title ' ELSE '12' END AS t, text FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'ok title' ELSE coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')[1], t) END AS title FROM v")
def f27(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, "  ").when(F.col("doc_id") % 3 == 1, " ok title ").otherwise("12")
    return docs(spark, d).select("doc_id", text.usable_title(t, F.col("text"), 3, "[a-z]").alias("title"))


@query("f28_retrieval_tier", "SELECT doc_id, ['T2_BILATERAL_VARIANT','T1_DIRECT_CHINA','T3_ENTITY_TOPIC','T4_ARCHIVE_DISCOVERY'][doc_id % 4 + 1] AS tier FROM documents")
def f28(spark, d):
    i = F.col("doc_id")
    q = F.when(i % 4 == 0, F.array(F.lit("Lao-China rail"), F.lit("x"))).when(i % 4 == 1, F.array(F.lit("Chinese"))).when(i % 4 == 2, F.array(F.lit("Boten"))).otherwise(F.array().cast("array<string>"))
    return docs(spark, d).select("doc_id", screen.retrieval_tier(q).alias("tier"))


@query("f29_origin_grade", "SELECT doc_id, ['xinhua','syndicated','local_original','unknown'][doc_id % 4 + 1] AS origin, ['A1','C2','B2'][doc_id % 3 + 1] AS grade FROM documents")
def f29(spark, d):
    label = F.element_at(F.array(*map(F.lit, ["新华社", "供稿", "本地原创", "?"])), (F.col("doc_id") % 4 + 1).cast("int"))
    grade = F.element_at(F.array(*map(F.lit, ["证据 A1 级", "XA1", "(B2)"])), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs(spark, d).select("doc_id", screen.content_origin(label).alias("origin"), screen.grade_in(grade).alias("grade"))


@query("f35_year_month", with_(ARTICLES) + "SELECT record_id, ym AS year_month FROM articles")
def f35(spark, d):
    return articles(spark, d).select("record_id", dates.year_month(F.col("published_at")).alias("year_month"))


@query("f36_confidence", "WITH v AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS s FROM events), c AS (SELECT event_id, try_cast(s AS DOUBLE) AS x FROM v) SELECT event_id, round(greatest(0.0, least(1.0, CASE WHEN x > 1 AND x <= 100 THEN x / 100 ELSE x END)), 6) AS confidence FROM c WHERE x IS NOT NULL UNION ALL SELECT event_id, NULL FROM c WHERE x IS NULL")
def f36(spark, d):
    s = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", F.round(text.confidence(s), 6).alias("confidence"))


_TERMS = ("nicht", "para", "pour", "that")
_HITS = "list_filter(['nicht','para','pour','that'], lambda t: contains(lower({0}), t))"


@query("p02_term_hits", f"SELECT doc_id, array_to_string({_HITS.format('text')}, '|') AS hits FROM documents")
def p02(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(screen.term_hits(F.col("text"), _TERMS), "|").alias("hits"))


@query("p01_token_hits", "WITH v AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN 'ລາວ - ຈີນ ' || text WHEN doc_id % 3 = 1 THEN 'ສປ ຈີນ' ELSE text END, '[\\s\\x{200b}-]+', '', 'g') AS t FROM documents) SELECT doc_id, array_to_string(list_transform(list_filter([['ຈີນ','ຈີນ'],['ສປຈີນ','ສປ ຈີນ'],['ລາວຈີນ','ລາວ-ຈີນ'],['ຈີນລາວ','ຈີນ-ລາວ']], lambda p: contains(t, p[1])), lambda p: p[2]), '|') AS hits FROM v")
def p01(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ລາວ - ຈີນ "), F.col("text"))).when(F.col("doc_id") % 3 == 1, "ສປ ຈີນ").otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", F.array_join(screen.token_hits(t), "|").alias("hits"))


@query("p03_union_hits", "SELECT doc_id, array_to_string(list_concat(CASE WHEN doc_id % 2 = 0 THEN ['ຈີນ'] ELSE []::VARCHAR[] END, " + _HITS.format("text") + "), '|') AS hits FROM documents")
def p03(spark, d):
    t = F.concat(F.when(F.col("doc_id") % 2 == 0, "ຈີນ ").otherwise(""), F.col("text"))
    return docs(spark, d).select("doc_id", F.array_join(screen.union_hits(t, terms=_TERMS), "|").alias("hits"))


@query("p04_masked_hits", "SELECT doc_id, array_to_string(" + _HITS.format("replace(replace(replace(replace(text, 'that ', ' '), 'That ', ' '), 'para la', ' '), 'Para La', ' ')") + ", '|') AS hits FROM documents")
def p04(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(screen.strict_hits(F.col("text"), ("that ", "para la"), terms=_TERMS), "|").alias("hits"))


@query("p05_context_hits", "SELECT doc_id, array_to_string(list_concat(CASE WHEN len(regexp_extract_all(text, 'that')) >= 2 OR regexp_matches(text, '(?:the|and).{0,10}that|that.{0,10}(?:the|and)') THEN ['that'] ELSE []::VARCHAR[] END, list_filter(['nicht','para'], lambda t: contains(lower(text), t))), '|') AS hits FROM documents")
def p05(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(screen.context_hits(F.col("text"), "that", "", (("zzz", "zzz"),), ("the", "and"), ("nicht", "para"), 10), "|").alias("hits"))


@query("p06_direct_hits", "SELECT doc_id, array_to_string(list_filter(['That','POUR'], lambda t: contains(lower(text), lower(t))), '|') AS hits FROM documents")
def p06(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(screen.direct_hits(F.col("text"), ("That", "POUR")), "|").alias("hits"))


@query("p08_keyword_contexts", """WITH v AS (SELECT doc_id, text AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(0, greatest(length(t), 1))) AS s FROM v)
SELECT doc_id, s AS "start", s + length(k) AS "end", k AS keyword, trim(substr(t, CAST(greatest(0, s - 20) AS BIGINT) + 1, CAST(least(s, 20) + length(k) + 20 AS BIGINT))) AS context FROM p, (VALUES ('with'), ('nicht')) w(k) WHERE lower(substr(t, CAST(s AS BIGINT) + 1, length(k))) = k""")
def p08(spark, d):
    hits = screen.keyword_contexts(F.col("text"), ("with", "nicht"), 20)
    return docs(spark, d).select("doc_id", F.inline(hits)).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "keyword", "context")


@query("p09_contaminated", "SELECT doc_id, contains(lower(text), 'the') AND len(list_filter(['that','with','from'], lambda t: contains(lower(text), t))) >= 2 AS bad, len(list_filter(['idiot','scum'], lambda t: contains(lower(substr(text, 1, 500)), t))) > 0 AS blocked FROM documents")
def p09(spark, d):
    return docs(spark, d).select("doc_id", screen.contaminated(F.col("text"), "the", ("that", "with", "from")).alias("bad"), screen.challenged(F.col("text"), ("idiot", "scum"), 500).alias("blocked"))


@query("p17_length_gates", "SELECT doc_id, length(trim(text)) >= 80 AS old_kpl, length(trim(text)) >= 60 AS direct, length(trim(text)) >= 500 AS epaper, length(trim(text)) >= 100 AS current FROM documents")
def p17(spark, d):
    return docs(spark, d).select("doc_id", *[screen.long_enough(F.col("text"), k).alias(k) for k in ("old_kpl", "direct", "epaper", "current")])


@query("p18_formal_eligibility", with_(ARTICLES) + "SELECT record_id, eligible FROM articles")
def p18(spark, d):
    return articles(spark, d).select("record_id", screen.formal(F.col("evidence_grade"), F.col("metadata")).alias("eligible"))


@query("p16_date_window", with_(ARTICLES) + "SELECT record_id FROM articles WHERE published_at BETWEEN '2012-06-01' AND '2013-06-30'")
def p16(spark, d):
    return articles(spark, d).where(dates.within(F.col("published_at"), "2012-06-01", "2013-06-30")).select("record_id")


_CODE = "regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?is)<noscript\\b.*?</noscript\\s*>', '', 'g')"
_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \\t\\r\\f]+', ' ', 'g'))"


@query("h05_visible_text", "SELECT page_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(" + _CODE.format("html") + ", '(?i)</?(?:p|div|section|article|h[1-6]|li|br|tr|ul|nav|footer|header|title)\\b[^>]*>', chr(10), 'g'), chr(10)), lambda s: " + _PLAIN.format("s") + "), lambda s: s <> ''), chr(10))) AS sha FROM pages")
def h05(spark, d):
    return pages(spark, d).select("page_id", F.sha2(html.visible_text(F.col("html")), 256).alias("sha"))


_A = "(?is)<a\\s[^>]*?href=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"


@query("h06_anchors", f"WITH a AS (SELECT page_id, regexp_extract_all(html, '{_A}', 1) AS h, regexp_extract_all(html, '{_A}', 2) AS t FROM pages), u AS (SELECT page_id, unnest(h) AS href, unnest(t) AS raw FROM a) SELECT page_id, href, {_PLAIN.format('raw')} AS text FROM u")
def h06(spark, d):
    return pages(spark, d).select("page_id", F.inline(html.anchors(F.col("html"))))


@query("h14_first_heading", "SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-3]\\b[^>]*>(.*?)</h[1-3]>', 1), lambda s: " + _PLAIN.format("s") + "), lambda s: length(s) >= 5 AND length(regexp_replace(s, '[^a-z]', '', 'g')) >= 3)[1] AS heading FROM pages")
def h14(spark, d):
    return pages(spark, d).select("page_id", html.first_heading(F.col("html"), script="[a-z]").alias("heading"))


@query("h13_segment", """WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS v FROM documents),
c AS (SELECT *, list_min(list_filter(list_transform(v, lambda s, i: CASE WHEN contains(regexp_replace(s, '\\s+', '', 'g'), 'idiot') THEN i - 1 END), lambda x: x IS NOT NULL)) AS cut FROM l),
k AS (SELECT *, array_to_string(v[1:cut], chr(10) || chr(10)) AS kept FROM c)
SELECT doc_id, sha256(CASE WHEN cut IS NOT NULL AND cut > 0 AND length(kept) >= 60 THEN kept ELSE text END) AS sha FROM k""")
def h13(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(screen.segment(F.col("text"), "idiot"), 256).alias("sha"))


@query("h15_column_text", """WITH i AS (SELECT l_orderkey, l_quantity AS x, l_extendedprice AS y, l_shipmode AS t FROM (SELECT l_orderkey, l_quantity, l_extendedprice, CASE WHEN l_linenumber % 3 = 0 THEN '12.5' WHEN l_linenumber % 3 = 1 THEN 'GDP  ' || l_linestatus ELSE l_returnflag END AS l_shipmode FROM lineitem)),
s AS (SELECT *, regexp_replace(trim(t), '[ \\t]+', ' ', 'g') AS v FROM i WHERE y BETWEEN 1000 AND 40000 AND x < 50), k AS (SELECT *, CASE WHEN x < 25 THEN 1 ELSE 2 END AS col FROM s WHERE v = '12.5' OR v LIKE 'GDP%'),
c AS (SELECT l_orderkey, col, string_agg(v, chr(10) ORDER BY y, x, v) AS body FROM k GROUP BY ALL), o AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT o.l_orderkey, sha256(coalesce(trim(string_agg(body, chr(10) || chr(10) ORDER BY col)), '') || chr(10)) AS sha FROM o LEFT JOIN c ON c.l_orderkey = o.l_orderkey GROUP BY o.l_orderkey""")
def h15(spark, d):
    n = F.col("l_linenumber") % 3
    t = F.when(n == 0, "12.5").when(n == 1, F.concat(F.lit("GDP  "), F.col("l_linestatus"))).otherwise(F.col("l_returnflag"))
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), t.alias("text"))).alias("items"))
    return items.select("l_orderkey", F.sha2(screen.column_text(F.col("items"), [(0, 25), (25, 50)], 1000, 40000), 256).alias("sha"))
