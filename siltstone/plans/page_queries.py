"""Queries that lay whole documents out as the pages and staged records of the old sites, and extract and import them again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..operators import archive_round, extract, staging
from ..operators.shared import folder
from ..sources import members, readers, sinks
from .corpus_view import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


#: Texts with one space between words and without markup, a title, a day: in Spark and in SQL.
_DOCS = """d AS (SELECT doc_id, lang, source, n_chars, trim(regexp_replace(translate(coalesce(text, ''), '<>&', '+++'), '\\s+', ' ', 'g')) AS body, 'Title of ' || source || ' ' || doc_id AS title,
 printf('2021-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1) AS day, printf('%02d/%02d/2021', doc_id % 28 + 1, doc_id % 12 + 1) AS shown FROM documents)"""


def _docs(spark, d):
    i = F.col("doc_id")
    day, month = F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lpad((i % 12 + 1).cast("string"), 2, "0")
    body = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "<>&", "+++"), "\\s+", " "))
    return table(spark, d, "documents").select(
        "doc_id", "lang", "source", "n_chars", body.alias("body"), F.concat(F.lit("Title of "), F.col("source"), F.lit(" "), i.cast("string")).alias("title"),
        F.concat(F.lit("2021-"), month, F.lit("-"), day).alias("day"), F.concat(day, F.lit("/"), month, F.lit("/2021")).alias("shown"),
    )


def _page(*parts):
    """Names in parts are columns, all else is markup."""
    columns = {"doc_id", "lang", "source", "body", "title", "shown", "day"}
    return F.concat(*[F.col(p).cast("string") if p in columns else F.lit(p) for p in parts])


@query("h01_search_page", f"WITH {_DOCS} SELECT doc_id, CASE WHEN lang = 'en' THEN 'KPL-EN-' ELSE 'KPL-LAO-' END || printf('%06d', doc_id) AS record_id, title, day || 'T08:30:00' AS published_at, sha256(body) AS excerpt_sha256 FROM d")
def search_page(spark, d):
    """A result page a document, with a link to a detail page twice."""
    item = ["<li><a href='detail.aspx?id=", "doc_id", "'>", "title", "</a><p>", "shown", " 08:30</p><p>", "body", "</p></li>"]
    page = _page("<script>var total = 1;</script><ul>", *item, *item, "<li><a href='about.aspx?id=1'>About</a></li></ul>")
    url = F.when(F.col("lang") == "en", "https://k.example/En/search.aspx").otherwise("https://k.example/search.aspx")
    rows = _docs(spark, d).select("doc_id", extract.search_listing_udf(page, url).alias("r")).select("doc_id", F.explode("r.items").alias("i"))
    return rows.select("doc_id", "i.record_id", "i.title", "i.published_at", F.sha2("i.excerpt", 256).alias("excerpt_sha256"))


@query("h02_detail_page", f"WITH {_DOCS} SELECT doc_id, CAST(doc_id AS VARCHAR) AS source_article_id, title, day AS published_at, CASE WHEN body <> '' THEN sha256(body) END AS content_sha256, source AS section, CASE WHEN body = '' THEN 'no body' END AS error FROM d")
def detail_page(spark, d):
    page = _page("<meta property='og:title' content='", "title", "'><h1 class='uk-hidden'>x</h1><div class='category'>", "source", "</div><div class='post-time'>", "shown", "</div><div class='post-ct-entry'><p>", "body", "</p><script>x()</script></div>")
    rows = _docs(spark, d).select("doc_id", extract.detail_article_udf(page, F.concat(F.lit("https://k.example/detail.aspx?id="), F.col("doc_id").cast("string"))).alias("r"))
    return rows.select("doc_id", "r.source_article_id", "r.title", "r.published_at", "r.content_sha256", "r.section", "r.error")


@query("h03_card_listing", f"WITH {_DOCS} SELECT doc_id, 'https://p.example/tags/x.html?page=2' AS next_url, 'https://p.example/' || lang || '-' || doc_id || '.html' AS url, CAST(doc_id AS VARCHAR) AS source_article_id, title, day || 'T07:05:00+07:00' AS published_at FROM d")
def card_listing(spark, d):
    """A listing a document; the card of the side bar isn't one of the list's."""
    page = _page("<main><div><article><h2><a href='/", "lang", "-", "doc_id", ".html'>", "title", "</a></h2><time>", "shown", " 07:05</time></article><a href='/tags/x.html?page=2'>2</a><a href='/tags/x.html?page=3'>3</a></div></main><aside><article><a href='/side-1.html'>Side</a></article></aside>")
    rows = _docs(spark, d).select("doc_id", extract.card_listing_udf(page, F.lit("https://p.example/tags/x.html")).alias("r")).select("doc_id", "r.next_url", F.explode("r.items").alias("i"))
    return rows.select("doc_id", "next_url", "i.url", "i.source_article_id", "i.title", "i.published_at")


@query("h04_site_article", f"WITH {_DOCS} SELECT doc_id, title, day || 'T09:10:00+07:00' AS published_at, sha256('Lead of ' || lang || CASE WHEN body <> '' THEN chr(10) || chr(10) || body ELSE '' END) AS content_sha256, 'A1' AS evidence_grade, 'Lead of ' || lang AS excerpt FROM d")
def site_article(spark, d):
    """Paragraphs that stand twice count once."""
    page = _page("<div class='article'><h1 class='article__title'>", "title", "</h1><div class='article__meta'>", "shown", " 09:10</div><div class='article__sapo'>Lead of ", "lang", "</div><div class='article__body'><p>", "body", "</p><p>", "body", "</p></div></div>")
    rows = _docs(spark, d).select("doc_id", extract.site_article_udf(page, F.concat(F.lit("https://p.example/a-"), F.col("doc_id").cast("string"), F.lit(".html"))).alias("r"))
    return rows.select("doc_id", "r.title", "r.published_at", "r.content_sha256", "r.evidence_grade", "r.excerpt")


@query("h07_old_agency_page", f"WITH {_DOCS} SELECT doc_id, title, CASE WHEN length(body) >= 80 THEN sha256(body) END AS body_sha256, CASE WHEN length(body) < 80 THEN 'body too short' END AS error FROM d")
def old_agency_page(spark, d):
    page = _page("<p>National news</p><p>", "title", "</p><p>", "body", "</p><p>Back</p>")
    rows = _docs(spark, d).select("doc_id", extract.old_agency_udf(page).alias("r"))
    return rows.select("doc_id", "r.title", F.sha2("r.body", 256).alias("body_sha256"), "r.error")


@query("h08_old_home_links", f"WITH {_DOCS} SELECT doc_id, 'http://o.example/content/' || (doc_id % 28 + 1) || '-' || (doc_id % 12 + 1) || '-2021/' || doc_id || '.htm' AS url, title FROM d UNION ALL SELECT doc_id, 'http://o.example/pasaxon-detail.php?p_id=' || doc_id, title FROM d")
def old_home(spark, d):
    i = F.col("doc_id")
    day = F.concat((i % 28 + 1).cast("string"), F.lit("-"), (i % 12 + 1).cast("string"), F.lit("-2021"))
    page = F.concat(F.lit("<a href='content/"), day, F.lit("/"), i.cast("string"), F.lit(".htm'>"), "title", F.lit("</a><a href='/pasaxon-detail.php?p_id="), i.cast("string"), F.lit("'>"), "title", F.lit("</a><a href='/about.htm'>About</a>"))
    return _docs(spark, d).select("doc_id", F.inline(extract.old_home_udf(page, F.lit("http://o.example/"))))


@query("h08_titled_article", f"WITH {_DOCS} SELECT doc_id, title, CASE WHEN length(body) >= 60 THEN sha256(body) END AS body_sha256, CASE WHEN length(body) < 60 THEN 'body too short' END AS error FROM d")
def titled_article(spark, d):
    page = _page("<p>Menu</p><p>", "title", "</p><p>", "body", "</p><p>Copyright 2012</p><p>rest</p>")
    rows = _docs(spark, d).select("doc_id", extract.titled_udf(page, F.col("title")).alias("r"))
    return rows.select("doc_id", "r.title", F.sha2("r.body", 256).alias("body_sha256"), "r.error")


@query("h09_direct_article", f"WITH {_DOCS} SELECT doc_id, day AS published_at, CASE WHEN substr(day, 6, 2) = '03' THEN NULL ELSE title END AS title, CASE WHEN length(body) >= 60 AND substr(day, 6, 2) <> '03' THEN sha256(body) END AS body_sha256, CASE WHEN substr(day, 6, 2) = '03' THEN 'date conflicts with address' WHEN length(body) < 60 THEN 'body too short' END AS error FROM d")
def direct_article(spark, d):
    """The day is shown below the headline; the month of the address differs in pages of March."""
    page = _page("<p>", "title", "</p><p>", "shown", "</p><p>", "body", "</p>")
    month = F.when(F.substring("day", 6, 2) == "03", "2021-04").otherwise(F.substring("day", 1, 7))
    rows = _docs(spark, d).select("doc_id", extract.direct_udf(page, F.lit(None).cast("string"), month).alias("r"))
    return rows.select("doc_id", "r.published_at", "r.title", F.sha2("r.body", 256).alias("body_sha256"), "r.error")


_LAO = "ລາວ" * 20


@query("h10_php_article", f"WITH {_DOCS} SELECT doc_id, title, day AS published_at, CASE WHEN length(body) + 61 >= 120 THEN sha256('{_LAO} ' || body) END AS body_sha256 FROM d")
def php_article(spark, d):
    """Injected nodes go before anything is read."""
    page = _page("<h4><span class='cok'>spam</span>", "title", "</h4><small>", "shown", "</small><div class='text-justify'>" + _LAO + " <i class='cok'>spam</i>", "body", "</div>")
    rows = _docs(spark, d).select("doc_id", extract.php_udf(page).alias("r"))
    return rows.select("doc_id", "r.title", "r.published_at", F.sha2("r.body", 256).alias("body_sha256"))


@query("h11_listing_refs", f"WITH {_DOCS} SELECT doc_id, doc_id AS p_id, 'cooperation' AS action, 'China and ' || source AS title, day AS published_at, 'http://o.example/pasaxon-detail.php?p_id=' || doc_id || '&act=cooperation' AS original_url FROM d WHERE doc_id % 3 <> 0")
def listing_refs(spark, d):
    """Of every third page the title speaks of Indochina only; of one number the last link counts."""
    link = ["<a href='pasaxon-detail.php?p_id=", "doc_id", "&act=cooperation'>"]
    china = F.when(F.col("doc_id") % 3 == 0, "Indochina and ").otherwise("China and ")
    page = F.concat(_page(*link, "China before</a> 2021-13-40 "), _page(*link), china, F.col("source"), F.lit("</a> <b>"), F.col("shown"), F.lit("</b>"))
    return _docs(spark, d).select("doc_id", F.explode(extract.listing_refs_udf(page, F.lit("http://o.example/list.php"))).alias("i")).select("doc_id", "i.p_id", "i.action", "i.title", "i.published_at", "i.original_url")


@query("h12_issue_cards", f"WITH {_DOCS} SELECT doc_id, '1.' || (doc_id % 1000) AS issue_number, day AS published_at, 'https://p.example/issue-' || doc_id || '.html' AS detail_url, 'https://p.example/c/' || lang || '.jpg' AS cover_url, 'https://p.example/f/' || doc_id || '.pdf' AS pdf_url FROM d")
def issue_cards(spark, d):
    i = F.col("doc_id").cast("string")
    name = F.concat(F.lit("1."), (F.col("doc_id") % 1000).cast("string"), F.lit(" ("), F.replace("shown", F.lit("/"), F.lit("-")), F.lit(")"))
    page = F.concat(F.lit("<div><img src='/c/"), "lang", F.lit(".jpg' alt='"), name, F.lit("'><a href='/issue-"), i, F.lit(".html'>Read</a></div>"))
    paper = F.concat(F.lit("<a href='/x.html'>x</a><a href='f/"), i, F.lit(".pdf'>PDF</a>"))
    at = F.lit("https://p.example/epaper.html")
    return _docs(spark, d).select("doc_id", F.inline(extract.issue_cards_udf(page, at)), extract.pdf_link_udf(paper, at).alias("pdf_url"))


@query("f31_decoded_page", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def decoded_page(spark, d):
    """Bytes with a byte order mark, a declared charset or neither."""
    i, data = F.col("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    marked = F.when(i % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), data)).otherwise(data)
    return table(spark, d, "documents").select("doc_id", F.sha2(members.decode_html(marked), 256).alias("text_sha256"))


def _staged(spark, d):
    """Records of documents: of every fifth the hash is of something else, of every third (by length) the address is known."""
    rows = _docs(spark, d).where("body <> ''")
    address = F.concat(F.lit("http://a.example:80/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    bad = F.col("doc_id") % 5 == 0
    return rows.select("doc_id", "n_chars", F.col("title").alias("title_original"), F.col("body").alias("body_original"), F.col("day").alias("published_at"), address.alias("original_url"), F.lit("B1").alias("evidence_grade"), F.when(bad, F.sha2("title", 256)).otherwise(F.sha2("body", 256)).alias("content_sha256"), F.sha2("body", 256).alias("raw_sha256"), F.sha2("title", 256).alias("payload_sha256"))


_IMPORT = f"""WITH {_DOCS}, r AS (SELECT *, 'http://a.example/' || lang || '/' || doc_id AS url, doc_id % 5 = 0 AS bad, n_chars % 3 = 0 AS known FROM d WHERE body <> '')
SELECT 'rejected' AS outcome, url AS address FROM r WHERE bad UNION ALL SELECT 'skipped', url FROM r WHERE NOT bad AND known UNION ALL SELECT 'article', 'P-' || substr(sha256(url), 1, 16) FROM r WHERE NOT bad AND NOT known
UNION ALL SELECT 'evidence', 'P-' || substr(sha256(url), 1, 16) || ':' || sha256(body) FROM r WHERE NOT bad AND NOT known UNION ALL SELECT 'article', 'old' || doc_id FROM r WHERE known"""


def _imported(spark, d, **which):
    rows = _staged(spark, d)
    old = rows.where(F.col("n_chars") % 3 == 0).select(F.concat(F.lit("old"), F.col("doc_id").cast("string")).alias("record_id"), "original_url", F.lit("t").alias("title_original"))
    got = staging.import_plan(rows, old, "P", **which)
    plain = lambda c: F.replace(F.col(c), F.lit(":80/"), F.lit("/"))
    parts = [got["rejected"].select(F.lit("rejected").alias("outcome"), plain("original_url").alias("address")), got["skipped"].select(F.lit("skipped"), plain("original_url")), got["articles"].select(F.lit("article"), "record_id"), got["evidence"].select(F.lit("evidence"), "evidence_id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("c09_import_records", _IMPORT)
def import_records(spark, d):
    return _imported(spark, d)


@query("c10_import_payloads", _IMPORT)
def import_payloads(spark, d):
    return _imported(spark, d, payload_hash=True)


@query("c11_import_listings", f"""WITH {_DOCS}, l AS (SELECT *, doc_id % 4 <> 0 AS ok, n_chars % 3 = 0 AS known, 'http://l.example/' || lang AS listing, 'PASAXON-CC-LIST-LO-' || substr(sha256('pasaxon-listing:' || doc_id), 1, 16) AS made FROM d)
SELECT 'rejected' AS outcome, CAST(doc_id AS VARCHAR) AS name FROM l WHERE NOT ok UNION ALL SELECT 'evidence', CASE WHEN known THEN 'old' || doc_id ELSE made END || ':listing:' || sha256(listing) FROM l WHERE ok
UNION ALL SELECT 'article', 'old' || doc_id FROM l WHERE known UNION ALL SELECT 'article', made FROM l WHERE ok AND NOT known""")
def import_listings(spark, d):
    """Every fourth lead has a title without Lao letters."""
    rows = _docs(spark, d)
    leads = rows.select(F.col("doc_id").alias("p_id"), F.when(F.col("doc_id") % 4 == 0, F.col("title")).otherwise(F.concat(F.lit("ລາວ "), "title")).alias("title_original"), F.col("day").alias("published_at"), F.concat(F.lit("http://l.example/"), "lang").alias("listing_url"))
    known = rows.where(F.col("n_chars") % 3 == 0).select(F.concat(F.lit("old"), F.col("doc_id").cast("string")).alias("record_id"), F.concat(F.lit("http://o.example/pasaxon-detail.php?p_id="), F.col("doc_id").cast("string")).alias("original_url"), F.lit("t").alias("title_original"))
    got = staging.import_listings(leads, known)
    return got["rejected"].select(F.lit("rejected").alias("outcome"), F.col("p_id").cast("string").alias("name")).union(got["evidence"].select(F.lit("evidence"), "evidence_id")).union(got["articles"].select(F.lit("article"), "record_id"))


@query("c12_import_upgrades", f"""WITH {_DOCS} SELECT doc_id AS record_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 6 = 1 THEN 'A2' ELSE 'B1' END AS evidence_grade, CASE WHEN doc_id % 4 = 0 OR doc_id % 6 = 1 THEN NULL ELSE sha256(body) END AS content_sha256, doc_id % 4 = 0 OR doc_id % 6 = 1 AS rejected FROM d""")
def import_upgrades(spark, d):
    """Bodies for articles without one; of some the day differs, of others the hash."""
    rows, i = _docs(spark, d), F.col("doc_id")
    old = rows.select(i.alias("record_id"), F.col("title").alias("title_original"), F.col("day").alias("published_at"), F.lit(None).cast("string").alias("body_original"), F.lit(None).cast("string").alias("content_sha256"), F.lit("A2").alias("evidence_grade"))
    new = rows.select(i.alias("record_id"), F.upper("title").alias("title_original"), F.when(i % 4 == 0, "1999-01-01").otherwise(F.col("day")).alias("published_at"), F.col("body").alias("body_original"), F.when(i % 6 == 1, F.sha2("title", 256)).otherwise(F.sha2("body", 256)).alias("content_sha256"))
    got = staging.import_upgrades(new, old)
    refused = got["rejected"].select("record_id", F.lit(True).alias("r")).distinct()
    return got["articles"].select("record_id", "evidence_grade", "content_sha256").join(refused, "record_id", "left").select("record_id", "evidence_grade", "content_sha256", F.coalesce("r", F.lit(False)).alias("rejected"))


@query("c13_import_pages", f"""WITH {_DOCS} SELECT doc_id AS record_id, '[' || concat_ws(', ', CASE WHEN doc_id % 4 = 1 THEN 'no PDF' END, CASE WHEN doc_id % 6 = 5 THEN 'body hash differs' END, CASE WHEN doc_id % 7 = 2 THEN 'no such page' END) || ']' AS problems FROM d""")
def import_pages(spark, d):
    """The rejected with their problems, and the articles with none."""
    rows, i = _docs(spark, d), F.col("doc_id")
    pdf = F.encode(F.concat(F.when(i % 4 == 1, "%PNG-").otherwise("%PDF-"), i.cast("string")), "UTF-8")
    base = rows.select(i.alias("record_id"), pdf.alias("pdf_content"), F.col("body").alias("body_original"), F.when(i % 6 == 5, F.sha2("title", 256)).otherwise(F.sha2("body", 256)).alias("content_sha256"), F.when(i % 7 == 2, 9).otherwise(2).alias("page_num")).withColumn("raw_sha256", F.sha2("pdf_content", 256))
    staged = base.withColumn("native_json", F.concat(F.lit('{"pdf_sha256":"'), "raw_sha256", F.lit('","pages":[{"page_num":1},{"page_num":2}]}'))).withColumn("native_json_sha256", F.sha2("native_json", 256))
    got = staging.import_pages(staged, spark.createDataFrame([], "record_id long, body_original string"))
    shown = F.concat(F.lit("["), F.array_join("problems", ", "), F.lit("]"))
    return got["rejected"].select("record_id", shown.alias("problems")).union(got["articles"].select("record_id", F.lit("[]")))


@query("c17_reparse", f"""WITH {_DOCS}, v AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'china_match' ELSE 'not_china' END AS prior_status, contains(body, 'und') AS related FROM d)
SELECT doc_id, prior_status, CASE WHEN doc_id % 9 = 4 THEN 'parse_failure' WHEN doc_id % 7 = 3 THEN prior_status WHEN related THEN 'china_match' WHEN prior_status = 'china_match' THEN 'not_china_after_body_reparse' ELSE 'not_china' END AS status FROM v""")
def reparse(spark, d):
    """Of some pages the new parser says nothing, of others it fails."""
    rows, i = _docs(spark, d), F.col("doc_id")
    previous = rows.select("doc_id", F.when(i % 2 == 0, "china_match").otherwise("not_china").alias("status"))
    parsed = rows.where((i % 7 != 3) | (i % 9 == 4)).select("doc_id", F.contains("body", F.lit("und")).alias("related"), F.when(i % 9 == 4, "broken").alias("error"))
    return archive_round.reparse(previous, parsed, "doc_id")


@query("w18_supplemental", "SELECT doc_id, CASE WHEN doc_id % 2 + row_number() OVER (PARTITION BY lang ORDER BY doc_id) > 40 THEN 'china_match_non_gap' ELSE 'china_match' END AS status FROM documents")
def supplemental(spark, d):
    matches = table(spark, d, "documents").select("doc_id", F.col("lang").alias("month"), (F.col("doc_id") % 2).alias("base"), F.col("doc_id").alias("queue_pos"))
    return archive_round.supplemental(matches, 40).select("doc_id", "status")


@query("c19_candidates", """WITH c AS (SELECT doc_id, doc_id // 3 AS page, 2010 + doc_id // 3 % 12 AS y, doc_id // 3 % 28 + 1 AS dd FROM documents)
SELECT max(doc_id) AS doc_id, printf('%d-03', y) AS year_month FROM c WHERE y BETWEEN 2014 AND 2020 GROUP BY page, y""")
def candidates(spark, d):
    """Three captures of each dated address; the latest of each within the years stays."""
    i = F.col("doc_id")
    page = F.floor(i / 3).cast("long")
    url = F.concat(F.lit("http://o.example/content/"), (page % 28 + 1).cast("string"), F.lit("-3-"), (page % 12 + 2010).cast("string"), F.lit("/"), page.cast("string"), F.lit(".htm"))
    captures = table(spark, d, "documents").select("doc_id", url.alias("original_url"), F.format_string("2021%010d", i).alias("timestamp"))
    return archive_round.candidates(captures, archive_round.ROUNDS["replay_2014_2020"]).select("doc_id", "year_month")


@query("s04_capture_list", "SELECT printf('2021%010d', page_id) AS timestamp, url AS original_url, sha256(html) AS digest, 'text/html' AS mimetype FROM pages")
@query("k13_capture_list", "SELECT printf('2021%010d', page_id) AS timestamp, url AS original_url, sha256(html) AS digest, 'text/html' AS mimetype FROM pages")
def capture_list(spark, d):
    """Written as capture lists of one host's pages each and scanned again."""
    path = folder(spark, "capture-list")
    rows = table(spark, d, "pages").select(F.format_string("2021%010d", "page_id").alias("timestamp"), F.col("url").alias("original_url"), F.lit("text/html").alias("mimetype"), F.sha2("html", 256).alias("digest"))
    sinks.cdx_json(rows).write.text(path)
    return readers.cdx(spark, path).select("timestamp", "original_url", "digest", "mimetype")


@query("s15_word_lines", f"WITH {_DOCS}, w AS (SELECT doc_id, unnest(string_split(body, ' ')) AS word FROM d WHERE body <> '') SELECT doc_id, sha256(string_agg(word, ' ')) AS text_sha256, CAST(count(*) AS BIGINT) AS n_words FROM w GROUP BY doc_id")
def word_lines(spark, d):
    """A recogniser's word table, a page a document, put together to lines again."""
    path = folder(spark, "words")
    words = _docs(spark, d).where("body <> ''").select("doc_id", F.posexplode(F.split("body", " ")).alias("i", "word"))
    zero = F.lit(0)
    words.select(F.lit(5).alias("level"), F.col("doc_id").alias("page_num"), zero.alias("block_num"), zero.alias("par_num"), zero.alias("line_num"), F.col("i").alias("word_num"), zero.alias("left"), zero.alias("top"), zero.alias("width"), zero.alias("height"), F.lit(90).alias("conf"), F.col("word").alias("text")).write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return readers.tsv_lines(spark, path).select(F.col("page_num").cast("long").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"), F.size(F.split("text", " ")).cast("long").alias("n_words"))


@query("s08_raw_objects", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def raw_objects(spark, d):
    """Compressed files of a line a document, read as objects and opened again."""
    path = folder(spark, "objects")
    line = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.sha2(F.coalesce("text", F.lit("")), 256))
    table(spark, d, "documents").select(line.alias("value")).write.option("compression", "gzip").text(path)
    lines = readers.raw_objects(spark, path, "*.gz").where("error IS NULL").select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("v")).where("v <> ''")
    return lines.select(F.split_part("v", F.lit(" "), F.lit(1)).cast("long").alias("doc_id"), F.split_part("v", F.lit(" "), F.lit(2)).alias("text_sha256"))


@F.pandas_udf(BinaryType())
def _gzipped(x):
    import gzip

    return x.map(gzip.compress)


@query("s09_archive_members", "SELECT page_id, CASE WHEN page_id % 4 < 2 AND html <> '' THEN sha256(html) END AS entity_sha256, CASE page_id % 4 WHEN 2 THEN 'range is no complete gzip' WHEN 3 THEN 'neither WARC nor ARC' END AS error FROM pages")
def archive_members(spark, d):
    """WARC and ARC members of whole pages, members cut short, and what is neither."""
    i = F.col("page_id")
    head = F.when(i % 4 == 0, "WARC/1.0\r\nWARC-Type: response\r\n\r\n").when(i % 4 == 3, "FTP/1.0\n").otherwise("http://a.example/ 1.2.3.4 20210101000000 text/html 9\n")
    member = _gzipped(F.encode(F.concat(head, F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), "html"), "UTF-8"))
    cut = F.when(i % 4 == 2, F.substring(member, F.lit(1), F.octet_length(member) - 6)).otherwise(member)
    rows = table(spark, d, "pages").select("page_id", members.extract_entity(cut).alias("r"))
    return rows.select("page_id", F.sha2("r.content", 256).alias("entity_sha256"), "r.error")


@query("f32_entity_page", "SELECT doc_id, 'ກ' || chr(CAST(97 + doc_id % 26 AS INT)) || '&<' || lang AS plain FROM documents")
def entity_page(spark, d):
    """Pages of numeric and named entities."""
    coded = F.concat(F.lit("&#3713;&#"), (F.col("doc_id") % 26 + 97).cast("string"), F.lit(";&amp;&lt;"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", members.entity_html(F.encode(coded, "UTF-8")).alias("plain"))
