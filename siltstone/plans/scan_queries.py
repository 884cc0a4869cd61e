"""Queries that write the standard tables in the forms that the readers scan, and scan them again; streams' sinks, gates and title keys."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import text
from ..operators import queues
from ..operators.shared import folder as _folder
from ..sources import planners, readers, sinks
from ..streaming import incremental
from .corpus_view import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


@query("s01_table_scan", "SELECT doc_id, lang, n_chars FROM documents")
def table_scan(spark, d):
    """Three declared columns: no other is read."""
    return readers.table(spark, f"{d}/documents.parquet").select("doc_id", "lang", "n_chars")


@query("s02_ndjson_scan", "SELECT doc_id, lang, source, sha256(text) AS text_sha256 FROM documents")
def ndjson_scan(spark, d):
    path = _folder(spark, "ndjson")
    table(spark, d, "documents").select("doc_id", "lang", "source", "text").write.json(path)
    return readers.ndjson(spark, path, "doc_id long, lang string, source string, text string").select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"))


_BAD = "CASE WHEN page_id % 11 = 0 THEN 'missing required fields: url' WHEN page_id % 7 = 0 THEN 'offset and length must be integers' WHEN page_id % 5 = 0 THEN 'offset must be non-negative and length positive' END"


@query("s03_index_rows", f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 11 <> 0 THEN url END AS url, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN -1 ELSE page_id * 100 END AS place, length(html) AS size, {_BAD} AS error FROM pages)
SELECT page_id, url, place, size, 'bytes=' || place || '-' || (place + size - 1) AS range_header, error FROM p""")
def index_rows(spark, d):
    """Index lines of which some lack the address, have no number for an offset, or a negative one."""
    path, i = _folder(spark, "index"), F.col("page_id")
    at = F.when(i % 7 == 0, "x").when(i % 5 == 0, "-1").otherwise((i * 100).cast("string"))
    line = F.struct(F.when(i % 11 != 0, F.col("url")).alias("url"), F.lit("20200101000000").alias("timestamp"), F.concat(F.lit("f"), i.cast("string")).alias("filename"), at.alias("offset"), F.length("html").cast("string").alias("length"))
    table(spark, d, "pages").select(F.to_json(line).alias("value")).write.text(path)
    rows = readers.range_columns(readers.index_rows(spark, path))
    return rows.select(F.substring("filename", 2, 20).cast("long").alias("page_id"), "url", F.col("offset").alias("place"), F.col("length").alias("size"), "range_header", "error")


@query("s05_capture_lines", "SELECT url, '20200101' || lpad(CAST(page_id % 1000000 AS VARCHAR), 6, '0') AS timestamp, sha256(html) AS digest FROM pages")
def capture_lines(spark, d):
    path = _folder(spark, "captures")
    stamp = F.concat(F.lit("20200101"), F.lpad((F.col("page_id") % 1_000_000).cast("string"), 6, "0"))
    table(spark, d, "pages").select("url", stamp.alias("timestamp"), F.sha2("html", 256).alias("digest")).write.json(path)
    return readers.arquivo(spark, path).select("url", "timestamp", "digest")


@query("s16_sitemap_addresses", "SELECT page_id, 2 AS n, url AS first_address, url || '/b' AS second_address FROM pages")
def sitemap_addresses(spark, d):
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    xml = F.concat(F.lit("<urlset><url><loc>\n "), escaped, F.lit(" </loc></url><url><LOC>"), escaped, F.lit("/b</LOC></url></urlset>"))
    found = table(spark, d, "pages").select("page_id", readers.sitemap(xml).alias("a"))
    return found.select("page_id", F.size("a").alias("n"), F.get("a", F.lit(0)).alias("first_address"), F.get("a", F.lit(1)).alias("second_address"))


@query("s17_search_partitions", """SELECT 'lo' AS language, q AS query, greatest('2012-03-05', y || '-01-01') AS date_from, least('2026-08-07', y || '-12-31') AS date_to FROM (VALUES ('alpha'), ('beta')) v(q), range(2012, 2027) r(y)
UNION ALL SELECT 'en', 'alpha', '2012-03-05', '2026-08-07'""")
def search_partitions(spark, d):
    first, last = date(2012, 3, 5), date(2026, 8, 7)
    lao = planners.search_partitions(spark, "Lao", ["alpha", " beta", "", "alpha "], first, last)
    return lao.unionByName(planners.search_partitions(spark, "english", ["alpha"], first, last))


_LETTERS = "replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g'), 'ß', 'ss')"


@query("f05_title_key", f"SELECT doc_id, {_LETTERS.format("split_part(text, chr(10), 1)")} AS title_key FROM documents")
def title_key(spark, d):
    return table(spark, d, "documents").select("doc_id", text.compact_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title_key"))


@query("f04_match_key", f"SELECT doc_id, sha256({_LETTERS.format("coalesce(replace(text, '&', '+'), '')")}) AS match_sha256 FROM documents")
def match_key(spark, d):
    """Keys of whole texts; their ampersands, which may begin an entity, are made plus signs first."""
    return table(spark, d, "documents").select("doc_id", F.sha2(text.match_key(F.replace(F.col("text"), F.lit("&"), F.lit("+"))), 256).alias("match_sha256"))


@query("p15_checked_queue", "SELECT doc_id, 'https://web.archive.example/' || doc_id || '/' || lang AS archive_url FROM documents")
def checked_queue(spark, d):
    queue = table(spark, d, "documents").select("doc_id", F.concat(F.lit("https://web.archive.example/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("lang")).alias("archive_url"))
    return queues.checked_queue(queue, ("doc_id", "archive_url"), "web.archive.example")


def _day(n: int):
    return F.lit(f"2020-01-0{n}").cast("timestamp").alias("at")


@query("t03_terminal_ledger", "SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'china_match' ELSE 'not_china' END AS status FROM documents")
def terminal_ledger(spark, d):
    """Two batches and the second once more: what has ended stays, what is pending ends, a repeated batch changes nothing."""
    path, docs = _folder(spark, "ledger-stream"), table(spark, d, "documents")
    write = incremental.ledger_sink(path, ["doc_id"], "at", query="ledger")
    write(docs.select("doc_id", F.when(F.col("n_chars") % 3 == 0, "china_match").otherwise("pending").alias("status"), _day(1)), 0)
    for _ in range(2):
        write(docs.select("doc_id", F.lit("not_china").alias("status"), _day(2)), 1)
    return incremental.latest(spark, path).select("doc_id", "status")


@query("t05_upsert_stream", "SELECT doc_id, CASE WHEN lang = 'en' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents")
def upsert_stream(spark, d):
    """A stream's batch, then a batch 0 of another stream, which changes the rows of one language."""
    path, docs = _folder(spark, "upsert-stream"), table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    incremental.upsert_sink(path, ["doc_id"], "at", query="first")(docs.select("doc_id", "n_chars", _day(1)), 0)
    incremental.upsert_sink(path, ["doc_id"], "at", query="second")(docs.where("lang = 'en'").select("doc_id", (F.col("n_chars") + 1).alias("n_chars"), _day(2)), 0)
    return incremental.latest(spark, path).select("doc_id", "n_chars")


@query("k15_language_report", """SELECT '# Corpus' || chr(10) || chr(10) || '## languages' || chr(10) || chr(10) || '| lang | n |' || chr(10) || '|-|-|' || chr(10) || string_agg('| ' || coalesce(lang, '') || ' | ' || n || ' |', chr(10) ORDER BY lang) || chr(10) AS page
FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""")
def language_report(spark, d):
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang")
    return spark.createDataFrame([(sinks.report("Corpus", {"languages": counts}),)], "page string")


@query("c08_seed_import", "SELECT CASE WHEN lang = 'en' THEN 'KPL-EN-' ELSE 'KPL-LAO-' END || doc_id AS record_id, CASE WHEN lang = 'en' THEN 'kpl_english' ELSE 'kpl_lao' END AS source_code, CAST(doc_id AS VARCHAR) AS source_article_id, 'Title of ' || source AS title_original, 'https://example.org/' || doc_id AS original_url FROM documents")
def seed_import(spark, d):
    """A Markdown seed with a heading and an address for each document."""
    path, i = _folder(spark, "seed"), F.col("doc_id").cast("string")
    name = F.concat(F.when(F.col("lang") == "en", "KPL-EN-").otherwise("KPL-LAO-"), i)
    block = F.concat(F.lit("### "), name, F.lit("｜01/02/2020 08:00｜Title  of "), F.col("source"), F.lit("\n- 原文：https://example.org/"), i, F.lit("\n"))
    table(spark, d, "documents").select(block.alias("value")).write.text(path)
    return readers.seed(spark, path).select("record_id", "source_code", "source_article_id", "title_original", "original_url")
