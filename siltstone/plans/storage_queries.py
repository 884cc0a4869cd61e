"""Queries that write with the sinks, read back with the readers, and audit what they find; and functions of old addresses.

Each writes below the shared folder that the session names, under a name of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text, urls
from ..operators import clustering, queues, ranking, reports, staging, tables
from ..operators.shared import folder as _folder
from ..sources import readers, sinks, versions
from .corpus_view import ARTICLES, BEST, SAMPLE, SCORED, articles, table, with_

Q: dict = {}
SQL: dict[str, str] = {}
_SAMPLED = with_(ARTICLES, SCORED, BEST, SAMPLE)


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents")


_PATHS = ["ShowListCooperation.php", "showlisteconomic.php/", "showlistpolitic.php?p=1", "showlistnotice_detail.php?p_id=1", "", "index.php", "showlistfinance.php", "pasaxon-detail.php?p_id=2"]


@query("p12_listing_kind", f"""WITH u AS (SELECT doc_id, lower('http://' || lang || '.example/' || [{", ".join(f"'{p}'" for p in _PATHS)}][doc_id % 8 + 1]) AS url FROM documents),
p AS (SELECT doc_id, rtrim(split_part(substr(url, 8 + strpos(substr(url, 8), '/') - 1), '?', 1), '/') AS path FROM u), k AS (SELECT doc_id, CASE WHEN path = '' THEN '/index.php' ELSE path END AS path FROM p)
SELECT doc_id, kind, priority FROM k LEFT JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in queues.LISTING_PRIORITY.items())}) v(kind, priority) ON kind = path""")
def listing_kind(spark, d):
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("doc_id") % 8 + 1).cast("int"))
    kind = queues.listing_kind(F.concat(F.lit("http://"), F.col("lang"), F.lit(".example/"), path))
    return docs(spark, d).select("doc_id", kind["kind"].alias("kind"), kind["priority"].alias("priority"))


@query("f02_markup_text", "SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(nfc_normalize(replace(replace(coalesce(text, ''), 'e', 'e' || chr(8203)), 'n', chr(173) || 'n')), chr(160), ' '), chr(65279), ''), chr(8203), ' '), chr(173), ''), '\\s+', ' ', 'g')) AS plain FROM documents")
def markup_text(spark, d):
    marked = F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("e​")), F.lit("n"), F.lit("­n"))
    return docs(spark, d).select("doc_id", text.markup_text(marked).alias("plain"))


_MONTH = "['January','february','Foo9','May'][doc_id % 4 + 1]"


@query("f13_record_slot", f"""WITH u AS (SELECT doc_id, 2010 + doc_id % 9 AS y, doc_id % 33 AS dd, doc_id % 14 AS mm, {_MONTH} AS mon, CASE WHEN doc_id % 17 = 0 THEN 2001 ELSE 2010 + doc_id % 9 END AS y2 FROM documents),
t AS (SELECT doc_id, try_strptime(y || '-' || mm || '-' || dd, '%Y-%m-%d') AS day FROM u WHERE y = y2 AND mon <> 'Foo9')
SELECT u.doc_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN day IS NOT NULL THEN u.doc_id END AS slot FROM u LEFT JOIN t ON t.doc_id = u.doc_id""")
def record_slot(spark, d):
    i = F.col("doc_id")
    year, month = (i % 9 + 2010).cast("string"), F.element_at(F.array(*map(F.lit, ["January", "february", "Foo9", "May"])), (i % 4 + 1).cast("int"))
    inner = F.when(i % 17 == 0, "2001").otherwise(year)
    name = F.concat(F.lit("http://h.org/NewsRecord/"), year, F.lit("/"), month, F.lit("/"), (i % 33).cast("string"), F.lit("."), (i % 14).cast("string"), F.lit("."), inner, F.lit("/edn"), i.cast("string"), F.lit(".htm"))
    found = urls.record_slot(name)
    return docs(spark, d).select("doc_id", found["day"].alias("day"), found["slot"].alias("slot"))


@query("j02_orphan_audit", _SAMPLED + """, s AS (SELECT * FROM articles WHERE coalesce(body_original, '') <> ''), r AS (SELECT record_id FROM s),
c AS (SELECT story_id, min(record_id) AS rep FROM articles GROUP BY story_id), e AS (SELECT record_id FROM articles WHERE archive_url IS NOT NULL)
SELECT 'story_clusters' AS relation, count(*) AS n FROM c WHERE rep NOT IN (SELECT * FROM r) UNION ALL SELECT 'evidence_objects', count(*) FROM e WHERE record_id NOT IN (SELECT * FROM r)
UNION ALL SELECT 'sample_memberships', count(*) FROM sample WHERE record_id NOT IN (SELECT * FROM r) UNION ALL SELECT 'translation_queue', count(*) FROM sample WHERE record_id NOT IN (SELECT * FROM r)""")
def orphan_audit(spark, d):
    """All four relations against a store that holds the articles with a body only."""
    a = articles(spark, d)
    s = ranking.monthly_sample(a)
    relations = {
        "story_clusters": (clustering.clusters(a), "representative_record_id"),
        "evidence_objects": (a.where("archive_url IS NOT NULL").select("record_id"), "record_id"),
        "sample_memberships": (s, "record_id"),
        "translation_queue": (tables.translation_queue(a, s), "record_id"),
    }
    return reports.orphans(relations, a.where(F.coalesce("body_original", F.lit("")) != ""))


@query("k06_queue_retain", _SAMPLED + "SELECT record_id, story_id FROM articles WHERE record_id IN (SELECT record_id FROM sample)")
def queue_retain(spark, d):
    a = articles(spark, d)
    return tables.retain_members(a.select("record_id", "story_id"), ranking.monthly_sample(a), "record_id")


@query("k03_evidence_rows", with_(ARTICLES) + "SELECT record_id || ':' || sha256(body_original) AS evidence_id, record_id, evidence_grade, coalesce(archive_url, original_url) AS evidence_url FROM articles WHERE body_original IS NOT NULL")
def evidence_rows(spark, d):
    rows = articles(spark, d).where("body_original IS NOT NULL").withColumn("content_sha256", F.sha2("body_original", 256))
    return staging.evidence(rows).select("evidence_id", "record_id", "evidence_grade", "evidence_url")


_OLD = "(SELECT sample_id, lang, count(*) AS n FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'main' ELSE 'other' END AS sample_id, lang FROM documents) GROUP BY ALL)"


@query("k05_sample_replace", f"SELECT sample_id, lang, n FROM {_OLD} WHERE sample_id = 'other' UNION ALL SELECT 'main', lang, count(*) FROM documents GROUP BY lang")
def sample_replace(spark, d):
    path = _folder(spark, "sample")
    named = F.when(F.col("doc_id") % 2 == 0, "main").otherwise("other").alias("sample_id")
    sinks.replace_sample(docs(spark, d).groupBy(named, "lang").agg(F.count(F.lit(1)).alias("n")), path)
    sinks.replace_sample(docs(spark, d).groupBy(F.lit("main").alias("sample_id"), "lang").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.parquet(path).select("sample_id", "lang", "n")


_EXPORTED = ["record_id", "story_id", "source_code", "language", "title_original", "published_at", "evidence_grade", "retrieval_tier", "content_origin", "topic_labels", "original_url", "archive_url", "body_file", "china_note_zh"]


@query("k08_json_export", with_(ARTICLES) + f"SELECT {', '.join(c for c in _EXPORTED if c != 'topic_labels')}, array_to_string(topic_labels, '|') AS topic_labels FROM articles")
def json_export(spark, d):
    """Written as JSON lines and scanned again with the declared schema."""
    path = _folder(spark, "articles-json")
    sinks.export_json(articles(spark, d).select(*_EXPORTED), path)
    rows = readers.ndjson(spark, path, ", ".join(f"{c} {'array<string>' if c == 'topic_labels' else 'string'}" for c in _EXPORTED))
    return rows.select(*[F.array_join(c, "|").alias(c) if c == "topic_labels" else F.col(c) for c in _EXPORTED])


@query("k10_record_files", with_(ARTICLES) + "SELECT family, coalesce(ym, 'undated') AS year_month, record_id, sha256('# ' || coalesce(title_original, '') || chr(10) || chr(10) || '- record_id: ' || record_id || chr(10) || '- published_at: ' || coalesce(published_at, '') || chr(10) || '- evidence_grade: ' || evidence_grade || chr(10) || '- original_url: ' || coalesce(original_url, '') || chr(10) || chr(10) || coalesce(body_original, '')) AS markdown_sha256 FROM articles")
def record_files(spark, d):
    path = _folder(spark, "records")
    sinks.export_records(articles(spark, d), path)
    rows = spark.read.schema("record_id string, markdown string, family string, year_month string").json(path)
    return rows.select("family", "year_month", "record_id", F.sha2("markdown", 256).alias("markdown_sha256"))


@query("k11_ledger_rewrite", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'china_match' ELSE 'not_china' END AS status FROM documents")
def ledger_rewrite(spark, d):
    """Written twice: the second version is what readers see."""
    path = _folder(spark, "ledger")
    sinks.rewrite_ledger(docs(spark, d).select(F.col("doc_id").alias("id"), F.lit("pending").alias("status")), path)
    sinks.rewrite_ledger(docs(spark, d).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "china_match").otherwise("not_china").alias("status")), path)
    return versions.read(spark, path, "id long, status string", "json")


@query("k12_failure_log", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'late', count(*) FROM events")
def failure_log(spark, d):
    path, ev = _folder(spark, "failures"), table(spark, d, "events")
    sinks.append_failures(ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), path)
    sinks.append_failures(ev.agg(F.count(F.lit(1)).alias("n")).select(F.lit("late").alias("event_type"), "n"), path)
    return readers.ndjson(spark, path, "event_type string, n long")


@query("s06_csv_scan", "SELECT 'src' || lang AS source, '2020-01' AS year_month, CAST(count(*) AS INT) AS candidate_story_count FROM documents GROUP BY lang")
def csv_scan(spark, d):
    """A coverage export with a byte order mark, scanned by place."""
    path = _folder(spark, "coverage")
    rows = docs(spark, d).groupBy(F.concat(F.lit("src"), F.col("lang")).alias("source")).agg(F.count(F.lit(1)).cast("int").alias("candidate_story_count"))
    rows.select(F.col("source").alias("﻿source"), F.lit("2020-01").alias("year_month"), "candidate_story_count").write.option("header", True).csv(path)
    return readers.csv_table(spark, path, "source string, year_month string, candidate_story_count int")


QUERIES = dict(Q)
assert set(schemas.EXPORT_FIELDS) >= set(_EXPORTED)
