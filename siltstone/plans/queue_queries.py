"""Queries for captures, queues, joins, upserts, audits and sets on the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls, vocab
from ..operators import ranking, tables
from ..streaming import incremental
from .corpus_view import table

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
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", "text")


def _month(i):
    return F.date_format(F.add_months(F.lit("2020-01-01").cast("date"), (i % 12).cast("int")), "yyyy-MM")


_MONTH = "strftime(DATE '2020-01-01' + to_months(CAST(doc_id % 12 AS INT)), '%Y-%m')"


@query("w06_interleave_queue", f"SELECT doc_id, depth, row_number() OVER (ORDER BY depth, month) AS queue_pos FROM (SELECT doc_id, {_MONTH} AS month, row_number() OVER (PARTITION BY {_MONTH} ORDER BY n_chars DESC, doc_id) AS depth FROM documents)")
def interleave(spark, d):
    rows = docs(spark, d).select("doc_id", "n_chars", _month(F.col("doc_id")).alias("month"))
    return ranking.interleave(rows, ["month"], [F.desc("n_chars"), "doc_id"]).select("doc_id", F.col("depth").cast("long").alias("depth"), F.col("queue_pos").cast("long").alias("queue_pos"))


@query("w07_gap_first_queue", f"""WITH q AS (SELECT doc_id, {_MONTH} AS month FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY doc_id) AS depth, CASE WHEN month IN ('2020-03', '2020-07') THEN 0 ELSE 1 END AS g FROM q)
SELECT doc_id, row_number() OVER (ORDER BY depth, g, month) AS queue_pos FROM r""")
def gap_first(spark, d):
    rows = docs(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").withColumn("month", _month(F.col("doc_id")))
    rows = rows.withColumn("g", F.when(F.col("month").isin("2020-03", "2020-07"), 0).otherwise(1))
    return ranking.interleave(rows, ["month"], ["doc_id"], ["g", "month"]).select("doc_id", F.col("queue_pos").cast("long").alias("queue_pos"))


_CANON = "regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '(/|\\.html)$', '')"


def _captures(spark, d):
    key = F.regexp_replace(F.regexp_replace(F.lower("url"), "[?#].*$", ""), "(/|\\.html)$", "")
    return table(spark, d, "pages").select("page_id", key.alias("key"), (F.col("page_id") * 7919 % 1000).alias("ts"))


@query("w08_latest_capture", f"SELECT page_id, {_CANON} AS key FROM pages QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id * 7919 % 1000 DESC, page_id) = 1")
def latest(spark, d):
    return ranking.first_by(_captures(spark, d), ["key"], [F.desc("ts"), "page_id"]).select("page_id", "key")


@query("w08_earliest_capture", f"SELECT page_id, {_CANON} AS key FROM pages QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id * 7919 % 1000, page_id) = 1")
def earliest(spark, d):
    return ranking.first_by(_captures(spark, d), ["key"], ["ts", "page_id"]).select("page_id", "key")


@query("w09_best_section", "WITH v AS (SELECT doc_id, doc_id // 3 AS pid, ['leader','cooperation','zzz'][doc_id % 3 + 1] AS act FROM documents) SELECT pid, arg_min(act, (CASE act WHEN 'cooperation' THEN 0 WHEN 'leader' THEN 1 ELSE 20 END, -doc_id)) AS act FROM v GROUP BY pid")
def best_section(spark, d):
    prio = F.create_map(*[F.lit(x) for kv in vocab.SECTION_PRIORITY.items() for x in kv])
    act = F.element_at(F.array(*map(F.lit, ["leader", "cooperation", "zzz"])), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = docs(spark, d).select(F.floor(F.col("doc_id") / 3).cast("long").alias("pid"), act.alias("act"), "doc_id")
    order = F.struct(F.coalesce(F.try_element_at(prio, "act"), F.lit(vocab.OTHER_SECTION)), -F.col("doc_id"))
    return rows.groupBy("pid").agg(F.min_by("act", order).alias("act"))


@query("w10_keyed_best_candidate", "SELECT lang, n_chars % 50 AS bucket, arg_min(doc_id, (CASE WHEN source < 'src5' THEN 0 ELSE 1 END, n_chars, doc_id)) AS doc_id FROM documents GROUP BY lang, bucket")
def keyed_best(spark, d):
    order = F.struct(F.when(F.col("source") < "src5", 0).otherwise(1), "n_chars", "doc_id")
    return docs(spark, d).groupBy("lang", (F.col("n_chars") % 50).alias("bucket")).agg(F.min_by("doc_id", order).alias("doc_id"))


@query("w11_first_seen", "SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents GROUP BY sha256(text)")
def first_seen(spark, d):
    rows = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"))
    return ranking.first_by(rows, ["sha"], ["doc_id"])


@query("w12_capture_per_kind_month", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type, day")
def per_kind(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return ranking.first_by(rows, ["event_type", "day"], ["ts", "event_id"]).select("event_type", "day", "event_id")


@query("w13_balanced_index_choice", "WITH v AS (SELECT DISTINCT 2014 + doc_id % 6 AS year, doc_id % 53 AS week FROM documents) SELECT year, week FROM v QUALIFY row_number() OVER (PARTITION BY year ORDER BY week DESC) <= CASE WHEN year <= 2016 THEN 2 ELSE 1 END")
def index_choice(spark, d):
    quota = spark.createDataFrame(list(vocab.INDEX_QUOTAS.items()), "year long, quota int")
    rows = docs(spark, d).select((F.col("doc_id") % 6 + 2014).alias("year"), (F.col("doc_id") % 53).alias("week")).distinct().join(F.broadcast(quota), "year")
    return ranking.top_by(rows, ["year"], [F.desc("week")], F.col("quota")).select("year", "week")


@query("w14_newest_two_a_month", f"SELECT doc_id, {_MONTH} AS month FROM documents QUALIFY row_number() OVER (PARTITION BY {_MONTH} ORDER BY doc_id DESC) <= 2")
def newest(spark, d):
    rows = docs(spark, d).withColumn("month", _month(F.col("doc_id")))
    return ranking.top_by(rows, ["month"], [F.desc("doc_id")], 2).select("doc_id", "month")


@query("w16_budgeted_scan", f"""WITH q AS (SELECT doc_id AS pos, {_MONTH} AS month, doc_id % 3 AS base, contains(lower(text), 'that') AS m FROM documents),
p AS (SELECT *, CASE WHEN base + coalesce(sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY month ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 4 THEN 1 ELSE 0 END AS w FROM q),
s AS (SELECT *, coalesce(sum(w) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM p), e AS (SELECT coalesce(min(pos) FILTER (w = 1 AND spent >= 40), 9223372036854775807) AS stop FROM s)
SELECT pos AS queue_pos, month, CASE WHEN pos >= stop THEN 'range_budget_exhausted' WHEN w = 0 THEN 'month_quota_met' WHEN m THEN 'china_match' ELSE 'not_china' END AS outcome FROM s, e""")
def budgeted(spark, d):
    q = docs(spark, d).select(F.col("doc_id").alias("queue_pos"), _month(F.col("doc_id")).alias("month"), (F.col("doc_id") % 3).alias("base"), F.contains(F.lower("text"), F.lit("that")).alias("match"))
    return ranking.quota_scan(q, 4, 40).select("queue_pos", "month", "outcome")


@query("w17_consecutive_stop", """WITH m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type = 'error' AS bad FROM events), r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY pos) AS k FROM r WHERE bad) SELECT user_id, min(pos) AS stop_pos FROM n WHERE k = 3 GROUP BY user_id""")
def stop(spark, d):
    return ranking.consecutive_stop(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3).select("user_id", F.col("stop_pos").cast("long").alias("stop_pos"))


_REC = "v AS (SELECT doc_id, 'u' || doc_id AS url, sha256(text) AS sha, " + _MONTH + " AS month, doc_id % 28 AS pub FROM documents), n AS (SELECT * FROM v WHERE doc_id % 2 = 0), k AS (SELECT sha FROM v WHERE doc_id % 2 = 1), ku AS (SELECT url FROM v WHERE doc_id % 10 = 0)"


@query("w19_preimport_reconcile", f"""WITH {_REC}, m AS (SELECT *, (sha IN (SELECT sha FROM k)) OR url IN (SELECT url FROM ku) AS dup FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY month, dup ORDER BY pub, url) AS place FROM m)
SELECT doc_id, CASE WHEN dup THEN 'already_in_current_database' WHEN CASE WHEN month = '2020-01' THEN 3 ELSE 0 END + place > 5 THEN 'current_month_quota_met' ELSE 'kept' END AS disposition FROM r""")
def reconcile(spark, d):
    i = F.col("doc_id")
    v = docs(spark, d).select("doc_id", F.concat(F.lit("u"), i.cast("string")).alias("url"), F.sha2("text", 256).alias("sha"), _month(i).alias("month"), (i % 28).alias("published_at"))
    base = spark.createDataFrame([("2020-01", 3)], "month string, n long")
    return ranking.reconcile(v.where(i % 2 == 0), v.where(i % 10 == 0), v.where(i % 2 == 1), base, 5).select("doc_id", "disposition")


@query("w20_content_duplicates", "SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_duplicates(spark, d):
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("w21_ordered_limit", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def ordered_limit(spark, d):
    return docs(spark, d).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)


@query("j04_unscreened", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unscreened(spark, d):
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("j05_lookup_enrichment", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def enrichment(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


_NEAR = """l AS (SELECT user_id, DATE '2024-01-10' + CAST(user_id % 10 AS INT) AS pub FROM (SELECT DISTINCT user_id FROM events)), c AS (SELECT user_id, CAST(ts AS DATE) AS cap, event_id FROM events WHERE event_type = 'view'),
r AS (SELECT l.user_id, event_id, date_diff('day', pub, cap) AS dd, row_number() OVER (PARTITION BY l.user_id ORDER BY CASE WHEN date_diff('day', pub, cap) >= 0 THEN 0 ELSE 1 END, abs(date_diff('day', pub, cap)), event_id) AS rk FROM l JOIN c ON c.user_id = l.user_id)"""


def _near(spark, d):
    ev = table(spark, d, "events")
    leads = ev.select("user_id").distinct().withColumn("published_day", F.date_add(F.lit("2024-01-10").cast("date"), (F.col("user_id") % 10).cast("int")))
    return ranking.kth_nearest(leads, ev.where("event_type = 'view'").select("user_id", F.to_date("ts").alias("capture_day"), F.col("event_id").alias("capture_id")), "user_id", 2)


@query("j06_nearest_capture", f"WITH {_NEAR} SELECT user_id, event_id AS capture_id FROM r WHERE rk = 2")
def nearest(spark, d):
    return _near(spark, d)[0].select("user_id", "capture_id")


@query("j06_unavailable_leads", f"WITH {_NEAR} SELECT user_id FROM l WHERE user_id NOT IN (SELECT user_id FROM r WHERE rk = 2)")
def unavailable(spark, d):
    return _near(spark, d)[1].select("user_id")


@query("j07_id_windows", "SELECT doc_id, CASE WHEN doc_id * 3 BETWEEN 253 AND 594 THEN '2020-01' WHEN doc_id * 3 BETWEEN 1810 AND 2040 THEN '2020-08' WHEN doc_id * 3 BETWEEN 2041 AND 2250 THEN '2020-09' END AS month FROM documents")
def id_windows(spark, d):
    w = spark.createDataFrame(list(vocab.ID_WINDOWS), "low long, high long, month string")
    return tables.in_windows(docs(spark, d).select("doc_id", (F.col("doc_id") * 3).alias("pid")), "pid", w).select("doc_id", "month")


@query("j08_existence_probe", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def existence(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j09_url_duplicates", "WITH v AS (SELECT page_id, lower(regexp_replace(url, '^([a-z]+://[^/]+)/', '\\1:80/')) AS u FROM pages WHERE page_id % 2 = 0) SELECT page_id FROM pages WHERE page_id % 3 = 0 AND lower(url) NOT IN (SELECT replace(u, ':80/', '/') FROM v)")
def url_duplicates(spark, d):
    p = table(spark, d, "pages")
    stored = p.where("page_id % 2 = 0").select(F.lower(F.regexp_replace("url", "^([a-z]+://[^/]+)/", "$1:80/")).alias("u")).select(F.replace("u", F.lit(":80/"), F.lit("/")).alias("k"))
    return p.where("page_id % 3 = 0").join(stored, F.lower("url") == F.col("k"), "left_anti").select("page_id")


@query("j10_base_merge", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def base_merge(spark, d):
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), "lang")


@query("k01_upsert_latest", "WITH n AS (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id % 2 = 1 GROUP BY 1), o AS (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type FROM n FULL JOIN o ON o.user_id = n.user_id")
def upsert(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return tables.upsert(ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1"), ["user_id"], "event_id").select("user_id", "event_type")


@query("g14_histograms", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def histograms(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("g15_hash_audit", "SELECT lang, count(*) AS rows, count(*) FILTER (doc_id % 10 <> 0) AS hash_match, count(*) FILTER (doc_id % 10 = 0) AS hash_mismatch FROM documents GROUP BY lang")
def hash_audit(spark, d):
    rows = docs(spark, d).withColumn("content_sha256", F.when(F.col("doc_id") % 10 != 0, F.sha2("text", 256)).otherwise("0"))
    return tables.audit_tallies(tables.verified(rows, "text"), ["lang"])


@query("g16_weighted_confidence", "SELECT l_shipmonth AS month, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_mean, round(avg(l_discount), 6) AS mean FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmonth, l_discount, l_quantity FROM lineitem) GROUP BY 1")
def weighted(spark, d):
    rows = table(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return tables.weighted_mean(rows, ["month"], "l_discount", "l_quantity").select("month", F.round("weighted_mean", 6).alias("weighted_mean"), F.round("mean", 6).alias("mean"))


@query("g17_ordered_distinct", "WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, '|' ORDER BY o) AS kinds FROM f GROUP BY user_id")
def ordered_distinct(spark, d):
    return tables.ordered_distinct(table(spark, d, "events"), ["user_id"], "event_id", "event_type").select("user_id", F.array_join("values", "|").alias("kinds"))


@query("g18_merged_counts", "WITH a AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), c AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1) SELECT coalesce(a.k, b.k, c.k) AS k, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) + coalesce(c.n, 0) AS n FROM a FULL JOIN b ON b.k = a.k FULL JOIN c ON c.k = coalesce(a.k, b.k)")
def merged(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "k")
    n = lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return tables.merged_counts(n(o), n(o.where("o_orderstatus = 'O'")), n(o.where("o_totalprice > 200000")), "k")


@query("c18_ledger_reconcile", "WITH r AS (SELECT doc_id, sha256(text) AS s FROM documents WHERE doc_id % 3 <> 0), l AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256(text) END AS s FROM documents WHERE doc_id % 4 <> 0), b AS (SELECT coalesce(r.doc_id, l.doc_id) AS doc_id, r.doc_id IS NULL AS nor, l.doc_id IS NULL AS nol, r.s AS rs, l.s AS ls FROM r FULL JOIN l ON l.doc_id = r.doc_id) SELECT doc_id, 'record_without_ledger' AS problem FROM b WHERE nol UNION ALL SELECT doc_id, 'missing_record' FROM b WHERE nor UNION ALL SELECT doc_id, 'hash_mismatch' FROM b WHERE rs <> ls")
def ledger(spark, d):
    i = F.col("doc_id")
    r = docs(spark, d).where(i % 3 != 0).select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    led = docs(spark, d).where(i % 4 != 0).select("doc_id", F.when(i % 5 == 0, "x").otherwise(F.sha2("text", 256)).alias("content_sha256"), F.lit("china_match").alias("status"))
    return tables.reconcile_ledger(r, led, "doc_id")


@query("c20_gap_audit", f"WITH q AS (SELECT doc_id, source, {_MONTH} AS month FROM documents) SELECT source, count(*) AS rows, count(*) FILTER (month IN ('2020-02','2020-05')) AS in_gap, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS unscreened, count(*) FILTER (month IN ('2020-02','2020-05') AND doc_id NOT IN (SELECT doc_id FROM labels)) AS unscreened_in_gap FROM q GROUP BY source")
def gap_audit(spark, d):
    q = docs(spark, d).select(F.col("doc_id").alias("url"), "source", _month(F.col("doc_id")).alias("month"))
    return tables.gap_audit(q, spark.createDataFrame([("2020-02",), ("2020-05",)], "month string"), table(spark, d, "labels").select(F.col("doc_id").alias("url")))


@query("c21_field_merge", "SELECT user_id, arg_max(event_type, event_id) FILTER (event_id % 3 <> 0) AS event_type, arg_max(props, event_id) AS props FROM events GROUP BY user_id")
def field_merge(spark, d):
    rows = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return tables.merge_fields(rows, "user_id", ["event_id"], ["event_type", "props"])


@query("e01_set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("e02_set_difference", "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).distinct().join(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("e03_array_intersection", "SELECT doc_id, list_has_any(list_filter(['the','der','la'], lambda t: contains(text, t)), ['der','la']) AS overlap FROM documents")
def array_intersection(spark, d):
    got = F.filter(F.array(*map(F.lit, ["the", "der", "la"])), lambda t: F.contains("text", t))
    return docs(spark, d).select("doc_id", F.arrays_overlap(got, F.array(F.lit("der"), F.lit("la"))).alias("overlap"))


@query("t01_look_back", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def look_back(spark, d):
    ev = table(spark, d, "events")
    return incremental.look_back(ev, "ts", ev.agg(F.max("ts")), 7).select("event_id")


@query("t02_month_cells", "SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1, 2")
def month_cells(spark, d):
    return incremental.month_cells(table(spark, d, "events"), "ts", ["event_type"])
