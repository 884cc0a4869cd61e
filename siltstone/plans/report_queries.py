"""Queries over the corpus view: clustering, sampling, coverage, inventories, quality."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import screen
from ..operators import clustering, ranking, reports, tables
from .corpus_view import ARTICLES, BEST, GRID, SAMPLE, SCORED, articles, table, with_

FULL = with_(ARTICLES, SCORED, BEST, SAMPLE, GRID)
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _both(spark, d):
    a = articles(spark, d)
    return a, ranking.monthly_sample(a)


@query("c01_story_assignment", with_(ARTICLES) + "SELECT record_id, story_id, CASE WHEN upper(source_code) LIKE 'KPL%' THEN 'shared_source_article_id' ELSE 'single_record' END AS cluster_method FROM articles")
def story_assignment(spark, d):
    return articles(spark, d).select("record_id", "story_id", "cluster_method")


@query("c01_story_clusters", with_(ARTICLES) + "SELECT story_id, arg_min(upper(source_code), record_id) AS source_code, min(record_id) AS representative_record_id, arg_min(CASE WHEN upper(source_code) LIKE 'KPL%' THEN 'shared_source_article_id' ELSE 'single_record' END, record_id) AS cluster_method FROM articles GROUP BY story_id")
def story_clusters(spark, d):
    return clustering.clusters(articles(spark, d)).drop("confidence")


@query("k04_cluster_insert_ignore", with_(ARTICLES, "c AS (SELECT story_id, min(record_id) AS rep FROM articles GROUP BY story_id), o AS (SELECT story_id, max(record_id) AS rep FROM articles WHERE doc_id % 4 = 0 GROUP BY story_id)") + "SELECT c.story_id, coalesce(o.rep, c.rep) AS representative_record_id FROM c LEFT JOIN o ON o.story_id = c.story_id")
def cluster_ignore(spark, d):
    a = articles(spark, d)
    old = a.where("doc_id % 4 = 0").groupBy("story_id").agg(F.max("record_id").alias("representative_record_id"))
    return clustering.keep_known(old, clustering.clusters(a).select("story_id", "representative_record_id"))


@query("w01_story_score", with_(ARTICLES, SCORED) + "SELECT record_id, round(score, 6) AS score, syndicated FROM scored")
def story_score(spark, d):
    return ranking.scored(articles(spark, d)).select("record_id", F.round("score", 6).alias("score"), "syndicated")


@query("w02_best_version", with_(ARTICLES, SCORED, BEST) + "SELECT family, ym AS year_month, story_id, record_id FROM best")
def best_version(spark, d):
    return ranking.best_versions(articles(spark, d)).select("family", "year_month", "story_id", "record_id")


@query("w03_hydration_candidates", with_(ARTICLES, SCORED, BEST) + "SELECT family, ym AS year_month, record_id, row_number() OVER (PARTITION BY family, ym ORDER BY score DESC, record_id) AS rank FROM best QUALIFY rank <= 10")
def hydration(spark, d):
    return ranking.hydration_candidates(articles(spark, d)).select("family", "year_month", "record_id", F.col("rank").cast("long").alias("rank"))


@query("w04_monthly_sample", FULL + "SELECT story_id, record_id, source_code, year_month, CAST(selection_rank AS BIGINT) AS selection_rank, round(score, 6) AS score, quota_reason FROM sample")
def sample(spark, d):
    return ranking.monthly_sample(articles(spark, d)).withColumn("score", F.round("score", 6)).withColumn("selection_rank", F.col("selection_rank").cast("long"))


@query("c02_monthly_coverage", FULL + """, cell AS (SELECT family, ym, count(DISTINCT story_id) AS c, count(DISTINCT CASE WHEN eligible THEN story_id END) AS e, count(DISTINCT CASE WHEN eligible AND has_body THEN story_id END) AS q
 FROM articles WHERE published_at IS NOT NULL GROUP BY family, ym), sc AS (SELECT source_code AS family, year_month AS ym, count(*) AS n FROM sample GROUP BY ALL),
g AS (SELECT grid.family, grid.ym, coalesce(c, 0) AS c, coalesce(e, 0) AS e, coalesce(q, 0) AS q, coalesce(n, 0) AS n FROM grid LEFT JOIN cell USING (family, ym) LEFT JOIN sc USING (family, ym))
SELECT family AS source, ym AS year_month, c AS candidate_story_count, e AS eligible_story_count, q AS qualified_body_story_count, n AS sample_story_count,
CASE WHEN n >= 4 THEN 'target_met' WHEN n >= 2 THEN 'minimum_met' ELSE 'documented_gap' END AS coverage_status, CAST(ym = '2026-08' AS INT) AS partial_period,
CASE WHEN c = 0 THEN 'no_discovered_records; historical_backfill_required' WHEN e = 0 THEN 'records_found_but_no_quota_eligible_evidence' WHEN q = 0 THEN 'eligible_records_found_but_no_verified_body'
 WHEN n < 2 THEN 'fewer_than_minimum_qualified_body_stories' WHEN n < 4 THEN 'fewer_than_target_eligible_unique_stories' ELSE '' END AS gap_reason FROM g""")
def coverage(spark, d):
    return reports.monthly_coverage(*_both(spark, d))


@query("c03_backfill_queue", with_(ARTICLES, GRID) + """, f AS (SELECT family, ym, count(DISTINCT story_id) AS n FROM articles WHERE published_at IS NOT NULL GROUP BY ALL),
g AS (SELECT grid.family, grid.ym, coalesce(n, 0) AS n FROM grid LEFT JOIN f USING (family, ym))
SELECT family AS source, ym AS year_month, n AS candidate_story_count, CASE WHEN ym < '2021-01' AND n < 2 THEN 'P0' WHEN n < 4 THEN 'P1' ELSE 'P2' END AS priority,
'current_site_partitions=0; seed_import=' || CASE WHEN family = 'KPL' THEN '1' ELSE '0' END AS attempted_entry_points,
CASE WHEN ym < '2021-01' THEN 'old_domain|Common_Crawl|LOC_catalog|epaper_PDF|official_reprint' ELSE 'current_search|tag|epaper|30_day_lookback' END AS next_entry_points,
CASE WHEN n < 2 THEN 'backfill_required' WHEN n < 4 THEN 'enrichment_required' ELSE 'candidate_target_met' END AS status FROM g""")
def backfill(spark, d):
    return reports.backfill_queue(articles(spark, d))


_BODY = "trim(coalesce(body_original, '')) <> ''"
_MEASURES = f"count(*) AS records, count(*) FILTER ({_BODY}) AS bodies, count(DISTINCT ym) AS candidate_months, count(DISTINCT CASE WHEN {_BODY} THEN ym END) AS body_months, " + ", ".join(f"count(*) FILTER (evidence_grade = '{g}') AS {g.lower()}" for g in ("A1", "A2", "B1", "B2", "C1", "C2")) + ", min(published_at) AS first_date, max(published_at) AS last_date"


@query("g07_source_year_inventory", FULL + f""", r AS (SELECT *, substr(published_at, 1, 4) AS year FROM articles WHERE published_at IS NOT NULL),
p AS (SELECT r.source_code, r.year, count(*) AS selected FROM r JOIN sample s ON s.record_id = r.record_id GROUP BY ALL), m AS (SELECT family AS source_family, source_code, year, {_MEASURES} FROM r GROUP BY ALL)
SELECT m.*, coalesce(selected, 0) AS selected FROM m LEFT JOIN p USING (source_code, year)""")
def source_year(spark, d):
    return reports.source_year_inventory(*_both(spark, d))


@query("g08_family_year_inventory", FULL + f""", r AS (SELECT *, substr(published_at, 1, 4) AS year FROM articles WHERE published_at IS NOT NULL),
p AS (SELECT r.family AS source_family, r.year, count(*) AS selected FROM r JOIN sample s ON s.record_id = r.record_id GROUP BY ALL), m AS (SELECT family AS source_family, year, {_MEASURES} FROM r GROUP BY ALL)
SELECT m.*, coalesce(selected, 0) AS selected FROM m LEFT JOIN p USING (source_family, year)""")
def family_year(spark, d):
    return reports.family_year_inventory(*_both(spark, d))


@query("g09_family_totals", with_(ARTICLES) + f"SELECT family, count(*) AS records, count(*) FILTER ({_BODY}) AS bodies, count(DISTINCT CASE WHEN {_BODY} THEN ym END) AS body_months, min(published_at) AS first_date, max(published_at) AS last_date FROM articles GROUP BY family")
def family_totals(spark, d):
    return reports.family_totals(articles(spark, d))


_STATUS = "CASE WHEN n >= 4 THEN 'target_met' WHEN n >= 2 THEN 'minimum_met' ELSE 'documented_gap' END"
_SC = ", sc AS (SELECT source_code AS family, year_month AS ym, count(*) AS n FROM sample GROUP BY ALL)"


@query("g10_status_histogram", FULL + _SC + f" SELECT {_STATUS} AS coverage_status, count(*) AS n FROM sc GROUP BY 1")
def histogram(spark, d):
    return reports.status_histogram(_both(spark, d)[1])


@query("c05_historical_coverage", FULL + _SC + f", g AS (SELECT grid.family, coalesce(n, 0) AS n FROM grid LEFT JOIN sc USING (family, ym) WHERE ym <= '2020-12') SELECT family AS source, " + ", ".join(f"count(*) FILTER ({_STATUS} = '{s}') AS {s}" for s in ("target_met", "minimum_met", "documented_gap")) + " FROM g GROUP BY family")
def historical(spark, d):
    return reports.historical_coverage(_both(spark, d)[1])


@query("c06_coverage_by_year", FULL + _SC + f", g AS (SELECT grid.family, substr(grid.ym, 1, 4) AS year, coalesce(n, 0) AS n FROM grid LEFT JOIN sc USING (family, ym)) SELECT family AS source, year, " + ", ".join(f"count(*) FILTER ({_STATUS} = '{s}') AS {s}" for s in ("target_met", "minimum_met", "documented_gap")) + " FROM g GROUP BY family, year")
def by_year(spark, d):
    return reports.coverage_by_year(_both(spark, d)[1])


@query("c06_yearly_status", FULL + f""", y AS (SELECT CAST(y AS VARCHAR) AS year, family FROM range(2012, 2027) r(y), (VALUES ('KPL'), ('PASAXON')) f(family)),
f AS (SELECT family, substr(published_at, 1, 4) AS year, count(*) AS records, count(*) FILTER ({_BODY}) AS bodies, count(DISTINCT CASE WHEN {_BODY} THEN ym END) AS body_months,
 count(*) FILTER (evidence_grade = 'A1') AS a1, count(*) FILTER (evidence_grade = 'A2') AS a2, count(*) FILTER (evidence_grade = 'B1') AS b1 FROM articles WHERE published_at IS NOT NULL GROUP BY 1, 2),
p AS (SELECT source_code AS family, substr(year_month, 1, 4) AS year, count(*) AS selected FROM sample GROUP BY 1, 2)
SELECT family AS source, year, coalesce(records, 0) AS records, coalesce(bodies, 0) AS bodies, coalesce(body_months, 0) AS body_months, coalesce(selected, 0) AS selected, coalesce(a1, 0) AS a1, coalesce(a2, 0) AS a2, coalesce(b1, 0) AS b1
FROM y LEFT JOIN f USING (family, year) LEFT JOIN p USING (family, year)""")
def yearly(spark, d):
    return reports.yearly_status(*_both(spark, d))


@query("g01_record_counts", with_(ARTICLES) + "SELECT count(*) AS rows, count(DISTINCT record_id) AS records FROM articles")
def record_counts(spark, d):
    return articles(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("record_id").alias("records"))


@query("g02_family_counts", with_(ARTICLES) + "SELECT family, count(*) AS n FROM articles GROUP BY family")
def family_counts(spark, d):
    return articles(spark, d).groupBy(screen.family(F.col("source_code")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("g03_grade_counts", with_(ARTICLES) + "SELECT evidence_grade, count(*) AS n, count(*) FILTER (retrieval_tier NOT IN ('T1_DIRECT_CHINA', 'T2_BILATERAL_VARIANT', 'T3_ENTITY_TOPIC', 'T4_ARCHIVE_DISCOVERY')) AS invalid_tier FROM articles GROUP BY evidence_grade")
def grade_counts(spark, d):
    from ..functions import vocab

    return articles(spark, d).groupBy("evidence_grade").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("retrieval_tier").isin(*vocab.TIERS)).alias("invalid_tier"))


@query("g12_stories_per_month", with_(ARTICLES) + "SELECT family, ym AS year_month, count(DISTINCT story_id) AS stories FROM articles WHERE published_at IS NOT NULL GROUP BY family, ym")
def stories_per_month(spark, d):
    return reports.dated(articles(spark, d)).where("published_at IS NOT NULL").groupBy("family", "year_month").agg(F.countDistinct("story_id").alias("stories"))


@query("j01_sample_join", FULL + "SELECT a.record_id, a.story_id, a.language, s.quota_reason FROM articles a JOIN sample s ON s.record_id = a.record_id")
def sample_join(spark, d):
    a, s = _both(spark, d)
    return a.join(s.select("record_id", "quota_reason"), "record_id").select("record_id", "story_id", "language", "quota_reason")


def _relations(spark, d, a):
    lab = table(spark, d, "labels").select(F.concat(F.lit("DOC-EN-"), F.format_string("%06d", "doc_id")).alias("record_id"))
    return {"labels": (lab, "record_id"), "clusters": (clustering.clusters(a), "representative_record_id")}


@query("c04_quality_checks", FULL + _SC + f""", p AS (SELECT a.* FROM articles a JOIN sample s ON s.record_id = a.record_id), c AS (
SELECT 'duplicate_record_ids' AS "check", 'Critical' AS severity, count(*) - count(DISTINCT record_id) AS n FROM articles UNION ALL
SELECT 'orphan_rows', 'Critical', count(*) FROM labels l WHERE 'DOC-EN-' || printf('%06d', l.doc_id) NOT IN (SELECT record_id FROM articles) UNION ALL
SELECT 'second_family_absent', 'High', CAST(count(*) FILTER (family = 'PASAXON') = 0 AS BIGINT) FROM articles UNION ALL
SELECT 'sample_missing_body', 'High', count(*) FILTER (NOT has_body) FROM p UNION ALL
SELECT 'sample_missing_url', 'High', count(*) FILTER (original_url IS NULL AND archive_url IS NULL) FROM p UNION ALL
SELECT 'sample_missing_note', 'High', count(*) FILTER (china_note_zh IS NULL) FROM p UNION ALL
SELECT 'coverage_gap_cells', 'High', count(*) FILTER (coalesce(n, 0) < 2) FROM grid LEFT JOIN sc USING (family, ym) UNION ALL
SELECT 'failed_partitions', 'Medium', count(*) FROM (SELECT user_id, event_type, arg_max(CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'ok' END, (ts, event_id)) AS st FROM events GROUP BY ALL) WHERE st = 'failed' UNION ALL
SELECT 'out_of_range_dates', 'High', count(*) FILTER (published_at IS NOT NULL AND published_at NOT BETWEEN '2012-01-01' AND '2026-08-07') FROM articles UNION ALL
SELECT 'invalid_evidence_grades', 'High', CAST(0 AS BIGINT) UNION ALL
SELECT 'invalid_retrieval_tiers', 'High', count(*) FILTER (retrieval_tier = 'T9_OTHER') FROM articles UNION ALL
SELECT 'required_fields_missing', 'Critical', count(*) FILTER (trim(title_original) = '' OR trim(source_code) = '' OR trim(language) = '') FROM articles)
SELECT * FROM c""")
def quality(spark, d):
    a, s = _both(spark, d)
    return reports.quality_checks(a, s, _relations(spark, d, a), _partitions(spark, d))


def _partitions(spark, d):
    ev = table(spark, d, "events")
    return tables.fold_attempts(ev, ["user_id", "event_type"], ["ts", "event_id"], F.when(F.col("event_id") % 5 == 0, "failed").otherwise("ok"))


@query("c04_quality_findings", "SELECT * FROM (" + SQL["c04_quality_checks"] + ") WHERE n > 0")
def quality_findings(spark, d):
    return reports.findings(quality(spark, d))


@query("k02_partition_attempts", "SELECT user_id, event_type, count(*) AS attempts, arg_max(CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'ok' END, (ts, event_id)) AS status, max(ts) AS last_checked_at FROM events GROUP BY user_id, event_type")
def attempts(spark, d):
    return _partitions(spark, d)


@query("g13_failed_partitions", "SELECT event_type, count(*) FILTER (st = 'failed') AS failed, CAST(sum(n) AS BIGINT) AS attempts FROM (SELECT user_id, event_type, count(*) AS n, arg_max(CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'ok' END, (ts, event_id)) AS st FROM events GROUP BY ALL) GROUP BY event_type")
def failed_partitions(spark, d):
    return _partitions(spark, d).groupBy("event_type").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.sum("attempts").alias("attempts"))


@query("c07_translation_queue", FULL + "SELECT record_id, story_id, language AS source_language, CASE WHEN coalesce(body_original, '') <> '' THEN sha256(body_original) END AS body_sha256, body_file, 'pending_provider_decision' AS translation_status FROM articles WHERE record_id IN (SELECT record_id FROM sample)")
def translation(spark, d):
    return tables.translation_queue(*_both(spark, d))


@query("k07_translation_upsert", FULL + """, q AS (SELECT record_id, CASE WHEN coalesce(body_original, '') <> '' THEN sha256(body_original) END AS body_sha256 FROM articles WHERE record_id IN (SELECT record_id FROM sample)),
o AS (SELECT record_id, 'old' AS body_sha256, 'provider-a' AS provider FROM articles WHERE doc_id % 3 = 0)
SELECT coalesce(q.record_id, o.record_id) AS record_id, CASE WHEN q.record_id IS NOT NULL THEN q.body_sha256 ELSE o.body_sha256 END AS body_sha256, o.provider FROM o FULL JOIN q ON q.record_id = o.record_id""")
def translation_upsert(spark, d):
    a, s = _both(spark, d)
    old = a.where("doc_id % 3 = 0").select("record_id", F.lit("old").alias("body_sha256"), F.lit("provider-a").alias("provider"))
    return tables.upsert_preserving(old, tables.translation_queue(a, s).select("record_id", "body_sha256"), "record_id", ["body_sha256"], ["provider"])


@query("k09_article_export", with_(ARTICLES) + "SELECT record_id, source_code, language, title_original, published_at, evidence_grade, array_to_string(topic_labels, '|') AS topic_labels, content_origin FROM articles")
def article_export(spark, d):
    return articles(spark, d).select("record_id", "source_code", "language", "title_original", "published_at", "evidence_grade", F.array_join("topic_labels", "|").alias("topic_labels"), "content_origin")


@query("k14_run_manifest", FULL + "SELECT (SELECT count(*) FROM articles) AS articles, (SELECT count(DISTINCT story_id) FROM articles) AS stories, (SELECT count(*) FROM sample) AS sampled")
def manifest(spark, d):
    a, s = _both(spark, d)
    return a.agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("story_id").alias("stories")).crossJoin(s.agg(F.count(F.lit(1)).alias("sampled")))


@query("w15_hydration_balance", with_(ARTICLES, SCORED, BEST) + "SELECT record_id, ym AS year_month FROM best WHERE family = 'KPL' AND NOT has_body QUALIFY row_number() OVER (PARTITION BY ym ORDER BY score DESC, record_id) <= 2")
def hydration_balance(spark, d):
    rows = ranking.best_versions(articles(spark, d)).where((F.col("family") == "KPL") & ~F.col("with_body"))
    return ranking.top_by(rows, ["year_month"], [F.desc("score"), "record_id"], 2).select("record_id", "year_month")


QUERIES = {k: partial(f) for k, f in Q.items()}
