"""Window forms against plain folds, and table operators on small tables."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import archive_round, clustering, ranking, reports, tables


def article(i, **more):
    row = {"record_id": f"R{i:04d}", "source_code": "pasaxon", "source_article_id": str(i), "story_id": f"S{i}", "title_original": "t", "body_original": "b", "body_file": None, "published_at": "2014-05-01", "evidence_grade": "A1", "retrieval_tier": "T1_DIRECT_CHINA", "content_origin": "local_original", "topic_labels": ["x"], "metadata": "{}", "original_url": "u", "archive_url": None, "china_note_zh": "n", "language": "en"}
    return row | more


SCHEMA = "record_id string, source_code string, source_article_id string, story_id string, title_original string, body_original string, body_file string, published_at string, evidence_grade string, retrieval_tier string, content_origin string, topic_labels array<string>, metadata string, original_url string, archive_url string, china_note_zh string, language string"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def test_stories_are_shared_across_languages(spark):
    rows = [article(1, source_code="kpl_lao", source_article_id="0045"), article(2, source_code="kpl_english", source_article_id="45"), article(3), article(4, source_code="kpl_lao", source_article_id=None), article(5, source_code="kpl_lao", source_article_id="none")]
    got = {r["record_id"]: (r["story_id"], r["cluster_method"]) for r in clustering.assign_story_ids(frame(spark, rows)).collect()}
    assert got["R0001"] == got["R0002"] == ("KPL-STORY-000045", "shared_source_article_id")
    assert got["R0003"] == ("PASAXON-STORY-R0003", "single_record") and got["R0004"][1] == "single_record" and got["R0005"][0] == "KPL-STORY-000000"


def test_sample_matches_a_plain_fold(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        rows.append(article(i, story_id=f"S{rng.randrange(300)}", published_at=f"2014-{rng.randrange(1, 7):02d}-01", evidence_grade=rng.choice(["A1", "A2", "B1", "B2", "C1", "C2", "ZZ"]), content_origin=rng.choice(["xinhua", "local_original", "reprint", "unknown"]), body_original=rng.choice(["b", None, ""]), metadata=rng.choice(["{}", '{"second_corroboration":true}', '{"scope":"中老"}'])))
    df = frame(spark, rows)
    scored = {r["record_id"]: r for r in ranking.scored(df).collect()}
    best: dict = {}
    for r in sorted(rows, key=lambda r: r["record_id"]):
        key = (r["published_at"][:7], r["story_id"])
        if key not in best or scored[r["record_id"]]["score"] > scored[best[key]["record_id"]]["score"]:
            best[key] = r
    want = set()
    for month in sorted({m for m, _ in best}):
        ok = [r for (m, _), r in best.items() if m == month and (r["evidence_grade"] in ("A1", "A2", "B1", "B2") or (r["evidence_grade"] == "C1" and "second" in r["metadata"])) and r["body_original"]]
        ok.sort(key=lambda r: (-scored[r["record_id"]]["score"], r["record_id"]))
        chosen, later, n = [], [], 0
        for r in ok:
            synd = scored[r["record_id"]]["syndicated"]
            if synd and n >= 2:
                later.append(r)
            else:
                chosen.append(r)
                n += synd
        for k, r in enumerate((chosen + later)[:4] if len(chosen) < 4 else chosen[:4], 1):
            want.add((r["record_id"], k))
    assert {(r["record_id"], r["selection_rank"]) for r in ranking.monthly_sample(df).collect()} == want


def test_sample_caps_reprints(spark):
    rows = [article(i, content_origin="xinhua" if i < 4 else "unknown") for i in range(6)]
    got = ranking.monthly_sample(frame(spark, rows)).collect()
    assert len(got) == 4 and sum(int(r["record_id"][1:]) < 4 for r in got) == 2
    got = ranking.monthly_sample(frame(spark, rows[:4])).collect()
    assert sorted(r["quota_reason"] for r in got) == ["deterministic_priority"] * 2 + ["syndicated_fallback_insufficient_local"] * 2


def test_interleave_is_breadth_first(spark):
    rows = [("d1", 1), ("d1", 2), ("d2", 1)]
    got = ranking.interleave(spark.createDataFrame(rows, "day string, slot int"), ["day"], ["slot"]).orderBy("queue_pos").collect()
    assert [(r["day"], r["slot"]) for r in got] == [("d1", 1), ("d2", 1), ("d1", 2)]


def test_places_of_a_crowded_group_come_from_many_tasks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b"]), rng.choice([None, 1, 2, 3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(6)
    order = [F.desc("v"), "id"]
    want = {r["id"]: r["p"] for r in df.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy(*order))).collect()}
    assert {r["id"]: r["p"] for r in ranking.ranked(df, ["g"], order, "p").collect()} == want
    assert ranking.ranked(df.limit(0), ["g"], order, "p").collect() == []


def test_running_sums_by_group(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", None]), rng.choice([0, 1, None])) for i in range(1000)]
    want, had = {}, {}
    for i, g, v in rows:
        want[i] = had.get(g, 0)
        had[g] = had.get(g, 0) + (v or 0)
    got = ranking.running_before(spark.createDataFrame(rows, "pos long, g string, v int"), "v", "pos", "s", block=64, by=["g"])
    assert {r["pos"]: r["s"] for r in got.collect()} == want


def _queue(rng, n=120):
    return [(i, f"m{rng.randrange(5)}", f"c{rng.randrange(6)}", rng.randrange(2), rng.choice(["china_match", "not_china", "not_china", "failed", "contaminated_template"]), rng.random() < 0.1) for i in range(n)]


def test_scan_fold_and_window_agree_without_feedback(spark):
    for seed in range(4):
        rng = random.Random(seed)
        rows = [(p, m, c, {"m0": 0, "m1": 1}.get(m, 0), rng.choice(["china_match", "not_china"]), False) for p, m, c, *_ in _queue(rng)]
        q = spark.createDataFrame(rows, "queue_pos long, year_month string, category string, base long, result string, terminal boolean")
        fold = {r["queue_pos"]: r["outcome"] for r in archive_round.fold_scan(q, archive_round.Round(2012, 2020, quota=3, budget=25)).collect()}
        w = ranking.quota_scan(q.select("queue_pos", F.col("year_month").alias("month"), "base", (F.col("result") == "china_match").alias("match")), 3, 25)
        assert {r["queue_pos"]: r["outcome"] for r in w.collect()} == fold


def test_scan_blocks_categories_and_breaks(spark):
    rows = [(0, "a", "x", 0, "contaminated_template", False), (1, "a", "x", 0, "china_match", False), (2, "a", "y", 0, "failed", False), (3, "a", "y", 0, "failed", False), (4, "a", "y", 0, "china_match", False), (5, "a", "z", 0, "china_match", True)]
    q = spark.createDataFrame(rows, "queue_pos long, year_month string, category string, base long, result string, terminal boolean")
    got = [r["outcome"] for r in archive_round.fold_scan(q, archive_round.Round(2012, 2020, budget=9, breaker=2)).orderBy("queue_pos").collect()]
    assert got == ["contaminated_template", "blocked_contaminated_template_path", "failed", "failed", "archive_error_circuit_breaker", "archive_error_circuit_breaker"]


def test_breaker_opens_at_the_third_in_a_row(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.random() < 0.5) for k in range(20) for i in range(30)]
    want = {}
    for k in range(20):
        streak = 0
        for _, i, bad in sorted(r for r in rows if r[0] == k):
            streak = streak + 1 if bad else 0
            if streak == 3:
                want[k] = i + 1
                break
    got = ranking.consecutive_stop(spark.createDataFrame(rows, "k int, i int, bad boolean"), "k", ["i"], F.col("bad"), 3)
    assert {r["k"]: r["stop_pos"] for r in got.collect()} == want


def test_round_queue(spark):
    caps = spark.createDataFrame([("http://h/s/2014/01/02/1.html", "20150101000000"), ("http://www.h/s/2014/01/02/1.html", "20160101000000"), ("http://h/s/2014/02/02/1.html", "2015"), ("http://h/s/2011/02/02/1.html", "2015"), ("http://h/none.html", "2015")], "original_url string, timestamp string")
    config = archive_round.Round(2014, 2019)
    rows = archive_round.candidates(caps, config)
    assert {(r["canonical_url"], r["timestamp"]) for r in rows.collect()} == {("h/s/2014/01/02/1.html", "20160101000000"), ("h/s/2014/02/02/1.html", "2015")}
    q = archive_round.queue(rows, config, spark.createDataFrame([], "canonical_url string"), spark.createDataFrame([("2014-02",)], "year_month string"))
    assert [r["year_month"] for r in q.orderBy("queue_pos").collect()] == ["2014-02", "2014-01"]


def test_coverage_of_an_empty_corpus_is_dense(spark):
    a = frame(spark, [article(0)]).limit(0)
    s = ranking.monthly_sample(a)
    rows = reports.monthly_coverage(a, s).collect()
    assert len(rows) == 352 and {r["coverage_status"] for r in rows} == {"documented_gap"} and sum(r["partial_period"] for r in rows) == 2
    assert reports.yearly_status(a, s).count() == 30
    one = frame(spark, [article(1)])
    hist = {r["source"]: r["documented_gap"] for r in reports.historical_coverage(ranking.monthly_sample(one)).collect()}
    assert hist == {"KPL": 108, "PASAXON": 108}
    clean = reports.findings(reports.quality_checks(one, s, {"c": (one, "record_id")})).collect()
    assert [(r["check"], r["n"]) for r in clean] == [("coverage_gap_cells", 352)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k int, v string, keep string")
    new = spark.createDataFrame([(2, None, 1), (3, "d", 1), (3, "e", 2)], "k int, v string, o int")
    got = {r["k"]: r["v"] for r in tables.upsert(old, new, ["k"], "o").collect()}
    assert got == {1: "a", 2: None, 3: "e"}  # every column is replaced, also by nulls
    kept = {r["k"]: (r["v"], r["keep"]) for r in tables.upsert_preserving(old, new.where("o = 1").drop("o"), "k", ["v"], ["keep"]).collect()}
    assert kept == {1: ("a", "p"), 2: (None, "q"), 3: ("d", None)}


def test_reparse_demotes(spark):
    prev = spark.createDataFrame([("a", "china_match"), ("b", "not_china"), ("c", "china_match"), ("d", "http_error")], "k string, status string")
    parsed = spark.createDataFrame([("a", False, None), ("b", True, None), ("c", None, "x")], "k string, related boolean, error string")
    got = {r["k"]: r["status"] for r in archive_round.reparse(prev, parsed, "k").collect()}
    assert got == {"a": "not_china_after_body_reparse", "b": "china_match", "c": "parse_failure", "d": "http_error"}


def test_queue_gates(spark):
    import pytest

    from siltstone.operators import queues

    q = spark.createDataFrame([("http://h.org/s/2014/01/02/1.html", "2014-01-02", 0), ("http://www.h.org/s/2014/01/02/1.html", "2014-01-02", 1), ("http://h.org/s/2014/01/03/1.html", "2014-01-04", 2), ("http://h.org/x.html", None, 3)], "original_url string, published_at string, queue_pos int")
    good, bad = queues.valid_rows(q)
    assert [r["queue_pos"] for r in good.collect()] == [0] and {r["queue_pos"] for r in bad.collect()} == {1, 2, 3}
    assert queues.eligible_rows(q, ("h.org",)).count() == 3
    with pytest.raises(Exception, match="host not allowed"):
        queues.eligible_rows(q, ("other.org",)).collect()
    with pytest.raises(ValueError, match="lacks archive_url"):
        queues.checked_queue(q, ("archive_url",), "web.archive.org")
    with pytest.raises(Exception, match="not an archive address"):
        queues.checked_queue(q.withColumn("archive_url", F.col("original_url")), ("archive_url",), "web.archive.org").collect()
    assert queues.inside("/data", "a/../b/c") == "/data/b/c"
    for bad_path in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(ValueError):
            queues.inside("/data", bad_path)


def test_running_sum_crosses_blocks(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(5)) for i in range(500)]
    got = {r["p"]: r["s"] for r in ranking.running_before(spark.createDataFrame(rows, "p long, v long").repartition(7), "v", "p", "s", block=64).collect()}
    assert got == {i: sum(v for j, v in rows if j < i) for i, _ in rows}
