"""The corpus tables seen in the standard tables: deterministic columns in DataFrame form and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRADES = ["A1", "A2", "B1", "B2", "C1", "C2"]
ORIGINS = ["local_original", "xinhua", "local_adapted", "unknown"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles table over documents and labels; see ARTICLES for the same in SQL.

    What reports and samplers ask of texts is derived below the join with labels, so no text is shuffled for them.
    """
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    s = F.regexp_extract("source", "(\\d+)", 1).cast("int")
    half = F.floor(i / 2).cast("long")
    code = F.when(s < 7, F.concat(F.lit("KPL_"), F.upper("lang"))).when(s < 14, "pasaxon").when(s < 17, "pasaxon_archive").otherwise(F.col("source"))
    pub = F.date_format(F.date_add(F.lit("2012-01-01").cast("date"), (half * 37 % 900).cast("int")), "yyyy-MM-dd")
    tags = F.when(F.col("toxic") == 1, F.array(F.lit("bilateral"))).when(F.col("quality") == 1, F.array(F.lit("trade"))).otherwise(F.array().cast("array<string>"))
    meta = F.when(i % 7 == 0, '{"scope":"中老","second_corroboration":true}').when(i % 7 == 1, '{"second_corroboration":false}').otherwise("{}")
    body = F.when(i % 5 != 0, F.col("text"))
    flags = {"with_body": (F.coalesce("body_original", F.lit("")) != "") | (F.coalesce("body_file", F.lit("")) != ""), "with_text": F.coalesce(F.trim("body_original"), F.lit("")) != ""}
    base = d.select(
        i.alias("doc_id"),
        F.concat(F.lit("DOC-"), F.upper("lang"), F.lit("-"), F.format_string("%06d", i)).alias("record_id"),
        code.alias("source_code"),
        half.cast("string").alias("source_article_id"),
        F.col("lang").alias("language"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title_original"),
        body.alias("body_original"),
        F.when(i % 11 == 0, F.concat(F.lit("text/"), i.cast("string"), F.lit(".txt"))).alias("body_file"),
        F.when(i % 97 != 0, pub).alias("published_at"),
        F.element_at(F.array(*map(F.lit, GRADES)), (i % 6 + 1).cast("int")).alias("evidence_grade"),
        F.when(i % 13 == 0, "T9_OTHER").otherwise("T1_DIRECT_CHINA").alias("retrieval_tier"),
        F.element_at(F.array(*map(F.lit, ORIGINS)), (i % 4 + 1).cast("int")).alias("content_origin"),
        meta.alias("metadata"),
        F.when(i % 3 != 0, F.concat(F.lit("https://example.org/"), F.col("lang"), F.lit("/"), i.cast("string"))).alias("original_url"),
        F.when(i % 9 == 0, F.concat(F.lit("https://archive.example/"), i.cast("string"))).alias("archive_url"),
        F.when(i % 4 != 0, "note").alias("china_note_zh"),
    )
    base = base.withColumns(flags).join(labels.select("doc_id", "toxic", "quality"), "doc_id", "left").withColumn("topic_labels", tags).drop("toxic", "quality")
    from ..operators.clustering import assign_story_ids

    return assign_story_ids(base)


#: WITH-list entries in DuckDB SQL; articles has the columns of articles() and family, ym.
ARTICLES = """base AS (SELECT d.doc_id, CAST(regexp_extract(d.source, '(\\d+)', 1) AS INT) AS s, d.doc_id // 2 AS half, d.lang, d.source, d.text, l.toxic, l.quality
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
raw AS (SELECT doc_id, 'DOC-' || upper(lang) || '-' || printf('%06d', doc_id) AS record_id,
 CASE WHEN s < 7 THEN 'KPL_' || upper(lang) WHEN s < 14 THEN 'pasaxon' WHEN s < 17 THEN 'pasaxon_archive' ELSE source END AS source_code,
 CAST(half AS VARCHAR) AS source_article_id, lang AS language, split_part(text, chr(10), 1) AS title_original,
 CASE WHEN doc_id % 5 <> 0 THEN text END AS body_original, CASE WHEN doc_id % 11 = 0 THEN 'text/' || doc_id || '.txt' END AS body_file,
 CASE WHEN doc_id % 97 <> 0 THEN strftime(DATE '2012-01-01' + CAST(half * 37 % 900 AS INT), '%Y-%m-%d') END AS published_at,
 ['A1','A2','B1','B2','C1','C2'][doc_id % 6 + 1] AS evidence_grade, CASE WHEN doc_id % 13 = 0 THEN 'T9_OTHER' ELSE 'T1_DIRECT_CHINA' END AS retrieval_tier,
 ['local_original','xinhua','local_adapted','unknown'][doc_id % 4 + 1] AS content_origin,
 CASE WHEN toxic = 1 THEN ['bilateral'] WHEN quality = 1 THEN ['trade'] ELSE []::VARCHAR[] END AS topic_labels,
 CASE WHEN doc_id % 7 = 0 THEN 'both' WHEN doc_id % 7 = 1 THEN 'no' ELSE '' END AS meta,
 CASE WHEN doc_id % 3 <> 0 THEN 'https://example.org/' || lang || '/' || doc_id END AS original_url,
 CASE WHEN doc_id % 9 = 0 THEN 'https://archive.example/' || doc_id END AS archive_url, CASE WHEN doc_id % 4 <> 0 THEN 'note' END AS china_note_zh FROM base),
articles AS (SELECT *, CASE WHEN upper(source_code) LIKE 'KPL%' THEN 'KPL-STORY-' || printf('%06d', CAST(source_article_id AS BIGINT)) ELSE upper(source_code) || '-STORY-' || record_id END AS story_id,
 CASE WHEN upper(source_code) LIKE 'KPL%' THEN 'KPL' WHEN upper(source_code) LIKE 'PASAXON%' THEN 'PASAXON' ELSE upper(source_code) END AS family,
 substr(published_at, 1, 7) AS ym, coalesce(body_original, '') <> '' OR coalesce(body_file, '') <> '' AS has_body,
 evidence_grade IN ('A1','A2','B1','B2') OR (evidence_grade = 'C1' AND meta = 'both') AS eligible FROM raw)"""

SCORED = """scored AS (SELECT *, CAST(CASE evidence_grade WHEN 'A1' THEN 35 WHEN 'B1' THEN 32 WHEN 'A2' THEN 25 WHEN 'B2' THEN 22 WHEN 'C1' THEN 8 WHEN 'C2' THEN -100 ELSE -50 END AS DOUBLE)
 + CASE WHEN meta = 'both' OR list_contains(topic_labels, 'bilateral') OR list_contains(topic_labels, 'china_in_laos') THEN 45 ELSE 0 END
 + CASE WHEN has_body THEN 20 ELSE 0 END + CASE WHEN content_origin IN ('local_original','local_adapted') THEN 12 ELSE 0 END
 - CASE WHEN content_origin IN ('xinhua','cri','syndicated','reprint') THEN 8 ELSE 0 END + least(length(title_original), 80) / 1000.0 AS score,
 content_origin IN ('xinhua','cri','syndicated','reprint') AS syndicated FROM articles)"""

BEST = """best AS (SELECT * FROM scored WHERE published_at IS NOT NULL AND story_id IS NOT NULL AND published_at BETWEEN '2012-01-01' AND '2026-08-07'
 QUALIFY row_number() OVER (PARTITION BY family, ym, story_id ORDER BY score DESC, record_id) = 1)"""

SAMPLE = """ranked AS (SELECT *, row_number() OVER (PARTITION BY family, ym ORDER BY score DESC, record_id) AS r FROM best WHERE eligible AND has_body),
counted AS (SELECT *, sum(CASE WHEN syndicated THEN 1 ELSE 0 END) OVER (PARTITION BY family, ym ORDER BY r) AS sr FROM ranked),
chosen AS (SELECT *, row_number() OVER (PARTITION BY family, ym ORDER BY CASE WHEN syndicated AND sr > 2 THEN 1 ELSE 0 END, r) AS selection_rank FROM counted),
sample AS (SELECT story_id, record_id, family AS source_code, ym AS year_month, selection_rank, score,
 CASE WHEN syndicated AND selection_rank > 2 THEN 'syndicated_fallback_insufficient_local' ELSE 'deterministic_priority' END AS quota_reason FROM chosen WHERE selection_rank <= 4)"""

GRID = """grid AS (SELECT f.family, strftime(m.m, '%Y-%m') AS ym FROM (VALUES ('KPL'), ('PASAXON')) f(family),
 (SELECT unnest(generate_series(TIMESTAMP '2012-01-01', TIMESTAMP '2026-08-01', INTERVAL 1 MONTH)) AS m) m)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
