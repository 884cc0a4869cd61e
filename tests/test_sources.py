from __future__ import annotations

import gzip
import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from siltstone.operators import extract, staging
from siltstone.plans import acquire, bootstrap
from siltstone.sources import members, pages_ocr, planners, readers, sinks
from siltstone.sources.fetch import Fetched, Fetcher, Stopped
from siltstone.streaming import incremental


def test_index_rows(spark, tmp_path):
    rows = [{"url": "http://h/1", "timestamp": "20150101000000", "filename": "f.warc.gz", "offset": "10", "length": "5", "status": "200", "charset": "utf-8"}, {"url": "", "timestamp": "1", "filename": "f", "offset": "1", "length": "1"}, {"url": "u", "timestamp": "1", "filename": "f", "offset": "-1", "length": "1", "status": "x"}, {"url": "u", "timestamp": "1", "filename": "f", "offset": "a", "length": "1"}]
    path = tmp_path / "i.ndjson"
    path.write_text("\n".join(map(json.dumps, rows)) + "\n\nnot json\n")
    got = readers.range_columns(readers.index_rows(spark, str(path))).collect()
    assert [r["error"] for r in got] == [None, "missing required fields: url", "offset must be non-negative and length positive", "offset and length must be integers", "not a JSON object"]
    assert got[0]["extra"] == {"charset": "utf-8"} and got[0]["status"] == 200 and got[0]["range_header"] == "bytes=10-14" and got[2]["status"] is None
    with pytest.raises(Exception, match="missing required"):
        readers.strict(readers.index_rows(spark, str(path))).collect()
    assert readers.ndjson(spark, str(tmp_path / "none.ndjson"), "a string").count() == 0


def test_capture_lists(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text("﻿" + json.dumps([["timestamp", "original", "digest"], ["2014", "http://a", "D"], ["2015", "http://b", "E"]]))
    rows = readers.cdx(spark, str(p)).orderBy("pos").collect()
    assert [(r["timestamp"], r["original_url"], r["digest"], r["mimetype"]) for r in rows] == [("2014", "http://a", "D", None), ("2015", "http://b", "E", None)]
    text = sinks.cdx_json(readers.cdx(spark, str(p))).first()["value"]
    assert json.loads(text)[0] == ["timestamp", "original", "mimetype", "digest"] and len(json.loads(text)) == 3
    p.write_text("[]")
    assert readers.cdx(spark, str(p)).count() == 0
    p.write_text('[["x"],["y"]]')
    with pytest.raises(Exception, match="lacks timestamp"):
        readers.cdx(spark, str(p)).collect()


def test_members(spark):
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    warc = gzip.compress(b"WARC/1.0\r\nX: y\r\n\r\n" + http + gzip.compress(b"body"))
    arc = gzip.compress(b"http://h 1 2 text/html 3\n" + http + b"body")
    bad = [b"no gzip", gzip.compress(b"WARC/1.0\r\n"), gzip.compress(b"junk\nx"), gzip.compress(b"http://h\nHTTP/1.1 200"), gzip.compress(b"http://h\n" + http + b"\x1f\x8bxx"), gzip.compress(b"http://h\n" + http)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([warc, arc, *bad])] + [(99, None)], "i int, b binary")
    got = {r["i"]: r["e"] for r in df.select("i", members.extract_entity(F.col("b")).alias("e")).collect()}
    assert bytes(got[0]["content"]) == bytes(got[1]["content"]) == b"body" and got[99] is None
    assert all(got[i]["error"] and got[i]["content"] is None for i in range(2, 8)) and len({got[i]["error"] for i in range(2, 8)}) == 6
    assert members.decoded(b"\xef\xbb\xbf\xc3\xa9") == "é" and members.decoded(b"caf\xe9") == "café" and members.decoded('<meta charset="windows-1252">’'.encode("cp1252")) .endswith("’")
    assert members.entity_text(b"&#3720;&#3765;&#3737;") == "ຈີນ"


def test_raw_objects_csv_tsv_sitemap(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"x"))
    (tmp_path / "b.bin").write_bytes(b"y")
    assert {bytes(r["content"]) for r in readers.raw_objects(spark, str(tmp_path)).collect()} == {b"x", b"y"}
    csv = tmp_path / "m.csv"
    csv.write_text("source,year_month,candidate_story_count,eligible_story_count,qualified_body_story_count,sample_story_count,coverage_status,partial_period,gap_reason\nKPL,2014-01,3,2,1,0,documented_gap,0,x\n", encoding="utf-8-sig")
    assert readers.csv_table(spark, str(csv)).first()["candidate_story_count"] == 3
    tsv = tmp_path / "w.tsv"
    tsv.write_text("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t2\t0\t0\t1\t1\t50\tbb\n5\t1\t1\t1\t1\t1\t0\t0\t1\t1\t100\taa\n5\t1\t1\t1\t1\t3\t0\t0\t1\t1\t-1\t\n")
    r = readers.tsv_lines(spark, str(tsv)).first()
    assert (r["text"], r["confidence"]) == ("aa bb", 0.75)
    assert spark.createDataFrame([("<loc> http://a?x=1&amp;y </loc><loc>b</loc>",)], "x string").select(readers.sitemap(F.col("x")).alias("s")).first()["s"] == ["http://a?x=1&y", "b"]


def test_fetcher_is_polite():
    waits, now, calls = [], [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    def opener(url, headers, timeout):
        calls.append(url)
        if url == "busy" and calls.count("busy") < 3:
            raise urllib.error.HTTPError(url, 503, "x", {"Retry-After": "7"}, io.BytesIO())
        if url == "no":
            raise urllib.error.HTTPError(url, 403, "x", {}, io.BytesIO())
        return Fetched(url, 200, b"please solve the captcha" if url == "wall" else b"0123456789"[: 4 if "Range" in headers else None])

    f = Fetcher(opener, sleep=sleep, clock=lambda: now[0], budget=6)
    assert f.get("a").content and f.get("b").status == 200 and waits == [1.0]
    assert f.get("busy").status == 200 and waits.count(7.0) == 2
    assert f.get_range("r", 0, 4) == b"0123"
    with pytest.raises(ValueError, match="length mismatch"):
        f.get_range("r", 0, 5)
    with pytest.raises(Stopped):
        f.get("wall")
    with pytest.raises(Stopped, match="budget"):
        f.get("z")
    with pytest.raises(Stopped, match="403"):
        Fetcher(opener, sleep=sleep, clock=lambda: now[0]).get("no")
    with pytest.raises(Stopped, match="disk"):
        Fetcher(opener, least_free_bytes=1 << 60).get("a")


def test_acquisition_keeps_failures_as_rows(spark):
    page = '<main class="main-col"><article><h2><a href="/x-1.html">T</a></h2><time>04/01/2020 09:30</time></article><a href="/tags/q.html?page=2">more</a></main>'

    def opener(url, headers, timeout):
        if "page=2" in url:
            raise urllib.error.HTTPError(url, 404, "gone", {}, io.BytesIO())
        return Fetched(url, 200, page.encode())

    f = Fetcher(opener, spacing_s=0)
    cards, log = acquire.crawl_listing(spark, f, "http://h/tags/q.html", 5)
    assert [r["published_at"] for r in cards.collect()] == ["2020-01-04T09:30:00+07:00"]
    assert [r["status"] for r in log.orderBy("page").collect()] == ["success", "failed"]
    assert [r["status"] for r in acquire.fetch_pages(spark, Fetcher(opener, spacing_s=0, budget=1), ["http://h/a", "http://h/b"]).collect()] == ["success", "pending"]


def test_planners(spark):
    from datetime import date

    u = planners.search_url("https://h", "lao", "ຈີນ", date(2014, 1, 1), date(2014, 12, 31), 4)
    assert "search=%E0%BA%88%E0%BA%B5%E0%BA%99" in u and "fd=01%2F01%2F2014" in u and u.endswith("page=4")
    lao = planners.search_partitions(spark, "lao", ["a", " a ", ""], date(2014, 6, 1), date(2016, 2, 1)).orderBy("date_from").collect()
    assert [(r["date_from"], r["date_to"]) for r in lao] == [("2014-06-01", "2014-12-31"), ("2015-01-01", "2015-12-31"), ("2016-01-01", "2016-02-01")]
    assert planners.search_partitions(spark, "english", ["a", "b"], date(2012, 1, 1), date(2026, 1, 1)).count() == 2
    with pytest.raises(ValueError):
        planners.detail_url("https://h", "lo", "x")


def test_ocr_ladder():
    P = pages_ocr.Page
    assert pages_ocr.read_pages(b"", [lambda d: [P(1, "x" * 90)], lambda d: [P(1, "y" * 100)]]).text.startswith("y")
    assert pages_ocr.read_pages(b"", [lambda d: [P(1, "short")]]).status == "native_text_insufficient"
    assert pages_ocr.read_pages(b"", [lambda d: 1 / 0]).status == "ocr_unavailable"
    assert pages_ocr.read_pages(b"", [], lambda d: 1 / 0).status == "ocr_error"
    assert pages_ocr.read_pages(b"", [], lambda d: [P(1, "t", confidence=90)]).status == "ocr_complete"
    assert pages_ocr.read_pages(b"", [], lambda d: [P(1, "t", confidence=0.5)]).status == "ocr_review_required"


LISTING = """<main><p>found <b>999</b> results</p><div class="main-col search-results">
<article><figure><a href="/lao-china-19715.html"><img alt="A"></a></figure><h2><a href="/lao-china-19715.html">ລາວ-ຈີນ</a></h2></article>
<article><h2><a href="/rail-19758.html">B</a></h2></article><a href="/tags/q.html?page=2">more</a></div>
<aside><article><h2><a href="/other-20000.html">C</a></h2></article></aside></main>"""
ARTICLE = """<div class="breadcrumb"><h2 class="main">S</h2></div><div class="article"><h1 class="article__title">ຫົວຂໍ້ຂ່າວ</h1><div class="article__meta"><time>13:48 30/07/2026</time></div>
<figure><img alt="x"><figcaption>cap</figcaption></figure><div class="article__sapo">ນຳ</div><div class="article__body"><a>fb</a><p>ໜຶ່ງ</p><p>ໜຶ່ງ</p><p>ຂ່າວ: ນາງ</p></div></div>"""


def test_listing_and_article(spark):
    got = extract.card_listing(LISTING, "https://h/search/x.html")
    assert [i["source_article_id"] for i in got["items"]] == ["19715", "19758"] and got["displayed_total"] == 999 and got["next_url"] == "https://h/tags/q.html?page=2"
    paper = extract.card_listing('<div class="epaper-list"><article><h2><a href="/a-1.html">15.024(16-07-2026)</a></h2></article><a href="/epaper.html?page=3">m</a></div>', "https://h/epaper.html?page=2")
    assert (paper["items"][0]["issue_number"], paper["items"][0]["published_at"], paper["next_url"]) == ("15.024", "2026-07-16", "https://h/epaper.html?page=3")
    a = extract.site_article(ARTICLE, "https://h/t-19715.html")
    assert a["record_id"] == "PASAXON-LO-19715" and a["published_at"] == "2026-07-30T13:48:00+07:00" and a["body"] == "ນຳ\n\nໜຶ່ງ\n\nຂ່າວ: ນາງ" and a["evidence_grade"] == "A1"
    assert a["section"] == "S" and a["captions"] == ["cap"] and a["content_origin"] == "local_byline" and len(a["content_sha256"]) == 64
    assert extract.site_article('<h1 class="article__title">T</h1>', "https://h/t-1.html")["error"] == "no body"
    row = spark.createDataFrame([(ARTICLE, "https://h/t-19715.html"), (None, "x")], "p string, u string").select(extract.site_article_udf(F.col("p"), F.col("u")).alias("a")).collect()
    assert row[0]["a"]["record_id"] == "PASAXON-LO-19715" and row[1]["a"] is None


def test_agency_pages(spark):
    s = extract.search_listing("<script>var total = 12;</script><ul><li><h3><a href='detail.aspx?id=53'>T &amp; U</a></h3><p>24/06/2014 11:20</p><p>Sum.</p></li></ul>", "https://h/search.aspx?search=q")
    assert s["total"] == 12 and s["items"][0] == {"record_id": "KPL-LAO-000053", "source_article_id": "53", "title": "T & U", "published_at": "2014-06-24T11:20:00", "excerpt": "Sum."}
    assert extract.search_listing("x", "https://h/")["error"] and extract.search_listing("<script>var total=2</script>", "https://h/")["error"]
    d = extract.detail_article('<meta property="og:title" content="China &amp; Laos"><h1 class="uk-hidden">x</h1><span class="post-time a">22/07/2014 09:16</span><div class="post-ct-entry"><div class="post-summary">S</div><p>Body here.</p><img alt="cap"></div>', "https://h/En/detail.aspx?id=95")
    assert (d["title"], d["published_at"], d["excerpt"], d["captions"], d["error"]) == ("China & Laos", "2014-07-22T09:16:00", "S", ["cap"], None) and "Body here." in d["body"]
    assert extract.detail_article("<p>x</p>", "https://h/")["error"] == "no title"
    search = spark.createDataFrame([("KPL-EN-000095", "95", "en", "China  & Laos", "2014-07-19T09:16:00")], "record_id string, source_article_id string, language string, title string, published_at string")
    page = spark.createDataFrame([("95", "en", "China & Laos", "b", "2014-07-22T09:16:00")], "source_article_id string, language string, title string, body string, published_at string")
    m = extract.merge_detail(search, page).first()
    assert (m["date_delta_days"], m["evidence_grade"], m["published_at"]) == (3, "A1", "2014-07-19T09:16:00")
    old = extract.old_agency_article("<title>:: X</title><script>n</script><td>Domestic news</td><span>President receives governor</span><p>" + "word " * 30 + "</p><div>Back</div><div>Copyright © 1996</div>")
    assert old["title"] == "President receives governor" and old["error"] is None and "Copyright" not in old["body"]


def test_old_pages_and_issues():
    home = '<a href="conten/4-1-12/1.htm">one</a><a href="x.htm">two</a>'
    assert [x["url"] for x in extract.old_home_links(home, "http://h/")] == ["http://h/conten/4-1-12/1.htm"]
    body = "ສອງຝ່າຍໄດ້ພົບປະ ແລະ ປຶກສາຫາລືກ່ຽວກັບການຮ່ວມມືລະຫວ່າງລາວ ແລະ ຈີນ ໃນຫຼາຍຂົງເຂດ."
    page = f"<h1>ການຮ່ວມມື ລາວ-ຈີນ ຂະຫຍາຍຕົວ</h1><p>{body}</p><div>Copyright © 2012</div>"
    assert extract.titled_article(page, "ການຮ່ວມມື ລາວ-ຈີນ ຂະຫຍາຍຕົວ")["body"] == body
    assert extract.titled_article(page, "ການຮ່ວມມື ລາວ-ຈີນ ຂະ ...")["title"] and extract.titled_article(page, "nothing")["error"]
    d = extract.direct_article(page, "2012-01-04", "2012-01")
    assert d["error"] is None and d["published_at"] == "2012-01-04" and extract.direct_article(page, None, None)["error"] == "no date"
    php = f'<h4>T</h4><small>5/6/2021</small><div class="text-justify"><div class="cok">SPAM</div><p>{body * 2}</p></div>'
    got = extract.php_article(php)
    assert got["published_at"] == "2021-06-05" and "SPAM" not in got["body"] and got["error"] is None
    cards = extract.issue_cards('<div><img src="c.jpg"><a href="d.php?p_id=1">15.024 (16-07-2022)</a></div>', "http://h/")
    assert cards[0]["cover_url"] == "http://h/c.jpg" and cards[0]["published_at"] == "2022-07-16"
    assert extract.pdf_link('<a href="/f/x.PDF">p</a>', "http://h/") == "http://h/f/x.PDF"


def test_listing_refs():
    url = "http://p.org.la/showlistcooperation.php"
    link = lambda n, t: f'<a href="pasaxon-detail.php?p_id={n}&amp;act=cooperation-detail">{t}</a>'
    page = link(5, "ລາວ-ຈີນ one") + "<p>3/4/2021 08:00:00</p>" + link(6, "other") + "<p>2021-05-01</p>" + link(5, "ຈີນ two") + " <b>2022-06-05 09:00</b>"
    got = extract.listing_refs(page, url)
    assert [(r["p_id"], r["title"], r["published_at"], r["action"]) for r in got] == [(5, "ຈີນ two", "2022-06-05", "cooperation-detail")]
    assert got[0]["original_url"] == "http://p.org.la/pasaxon-detail.php?p_id=5&act=cooperation-detail"
    for bad in (link(1, "ຈີນ"), link(1, "ຈີນ") + "31/03/2020", link(1, "ອິນໂດຈີນ") + "31/03/2021", '<a href="d.php?p_id=5">ຈີນ</a> 3/4/2021', link(1, "ຈີນ") + "x" * 700 + "31/03/2021"):
        assert extract.listing_refs(bad, url) == []


def test_headlines_of_direct_articles():
    lead = "ສອງປະເທດສືບຕໍ່ພັດທະນາການພົວພັນ ແລະ ການຮ່ວມມືຮອບດ້ານໃຫ້ເຂັ້ມແຂງຂຶ້ນຕື່ມອີກ"
    page = lambda *lines: "".join(f"<p>{x}</p>" for x in lines)
    title = lambda p: (lambda a: (a["title"], a["body"], a["error"]))(extract.direct_article(p, "2012-11-01", None))
    assert title(page("<b>ລາວ-ຈີນ ຮ່ວມມື</b>", lead)) == ("ລາວ-ຈີນ ຮ່ວມມື", lead, None)
    assert title(page("ໜ້າຫຼັກ", "ສະໝັກ ສະມາຊິກ", "ຫົວຂໍ້ຂ່າວ", "12/8/2018 10:00", lead, "ລິຂະສິດ 2018")) == ("ຫົວຂໍ້ຂ່າວ", lead, None)
    assert title(page("<h1>ໜັງສືພິມ</h1>", "ຫົວຂໍ້ຂ່າວ", "12.8.2018", lead)) == ("ຫົວຂໍ້ຂ່າວ", lead, None)
    assert title(page("x", "ຫົວຂໍ້ ຂ່າວ", "ໃນ" + lead)) == ("ຫົວຂໍ້ ຂ່າວ", "ໃນ" + lead, None)
    assert extract.direct_article(page("ຫົວຂໍ້ຂ່າວ", "5/6/2019", lead), None, "2019-07")["error"] == "date conflicts with address"


def test_listing_kinds(spark):
    from siltstone.operators import queues

    addresses = ["http://p.org.la/showlistcooperation.php", "http://p.org.la/ShowListEconomic.php?x=1", "http://p.org.la/", "http://p.org.la", "http://p.org.la/showlistnotice_detail.php?p_id=1", None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(addresses)], "i int, u string").withColumn("k", queues.listing_kind(F.col("u")))
    assert [r["k"] and tuple(r["k"]) for r in rows.orderBy("i").collect()] == [("/showlistcooperation.php", 0), ("/showlisteconomic.php", 1), ("/index.php", 7), ("/index.php", 7), None, None]


def _staged(i, body="ເນື້ອໃນຂ່າວ ຈີນ", **more):
    import hashlib

    return {"title_original": "ຫົວຂໍ້", "body_original": body, "published_at": "2014-05-01", "original_url": f"http://h.org:80/a/{i}", "content_sha256": hashlib.sha256(body.encode()).hexdigest(), "raw_sha256": "0" * 64, "evidence_grade": "B1", "capture_timestamp": str(i)} | more


def test_import_verifies_skips_and_is_idempotent(spark):
    from siltstone import schemas

    empty = spark.createDataFrame([], schemas.ARTICLES)
    rows = [_staged(1), _staged(2, content_sha256="0" * 64), _staged(3, published_at="May"), _staged(4, title_original="")]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} string" for k in rows[0]))
    plan = staging.import_plan(df, empty, "X")
    assert plan["articles"].count() == 1 and plan["rejected"].count() == 3 and plan["evidence"].count() == 1
    again = staging.import_plan(df, plan["articles"], "X")
    assert again["articles"].count() == 1 and again["skipped"].count() == 1 and again["evidence"].count() == 0
    up = spark.createDataFrame([(plan["articles"].first()["record_id"], "ຫົວຂໍ້", "2014-05-01", "new body", __import__("hashlib").sha256(b"new body").hexdigest())], "record_id string, title_original string, published_at string, body_original string, content_sha256 string")
    better = staging.import_upgrades(up, plan["articles"])["articles"].first()
    assert better["body_original"] == "new body" and better["evidence_grade"] == "B1"
    leads = spark.createDataFrame([(7, "ຫົວຂໍ້ ຈີນ", "2021-02-03", "http://h/d.php?p_id=7", "http://h/l"), (8, "latin", "2021-02-03", "u", "l")], "p_id bigint, title_original string, published_at string, original_url string, listing_url string")
    got = staging.import_listings(leads, plan["articles"])
    assert got["articles"].where("evidence_grade = 'A2'").count() == 1 and got["rejected"].count() == 1


SEED = """# seed
### KPL-LAO-000045｜2014-06-17 03:37:00｜ຂ່າວ  ຈີນ
- 摘录：sum
- 范围初筛：中老双边
- 稿源线索：本地原创
- 证据：A1
- 原文：http://h/detail.aspx?id=45
- 检索页：http://h/search.aspx?search=%E0%BA%88%E0%BA%B5%E0%BA%99&page=1

### KPL-EN-000045｜2014-06-17 03:37:00｜China news
- 证据：无
"""


def test_bootstrap_twice_is_the_same(spark, tmp_path):
    from siltstone import cli

    seed = tmp_path / "seed.md"
    seed.write_text(SEED)
    ws = bootstrap.Workspace(spark, str(tmp_path / "ws"))
    first = json.loads(bootstrap.bootstrap(ws, str(seed), "2026-08-07"))
    assert first["counts"] == {"articles": 2, "sample_memberships": 0}
    rows = {r["record_id"]: r for r in ws.articles().collect()}
    assert rows["KPL-LAO-000045"]["matched_queries"] == ["ຈີນ"] and rows["KPL-LAO-000045"]["topic_labels"] == ["bilateral"] and rows["KPL-EN-000045"]["evidence_grade"] == "C2"
    assert rows["KPL-LAO-000045"]["story_id"] == rows["KPL-EN-000045"]["story_id"] == "KPL-STORY-000045"
    assert json.loads(bootstrap.bootstrap(ws, str(seed), "2026-08-07")) == first and ws.articles().exceptAll(spark.createDataFrame(list(rows.values()), ws.articles().schema)).count() == 0
    assert any(f["check"] == "coverage_gap_cells" for f in cli.main(["--root", str(tmp_path / "ws"), "quality"], spark))
    assert "## Years" in cli.main(["--root", str(tmp_path / "ws"), "status-report-artifact"], spark)
    assert len(cli.COMMANDS) >= 25
    seed.write_text(SEED + SEED)
    with pytest.raises(ValueError, match="seed holds"):
        bootstrap.import_seed(ws, str(seed))


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "k int, v string, at timestamp"
    batch = lambda rows: spark.createDataFrame(rows, "k int, v string, at string").withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(str(src))
    batch([(1, "a", "2024-01-01"), (2, "b", "2024-01-02")])

    def drain():
        q = spark.readStream.schema(schema).parquet(str(src)).writeStream.foreachBatch(incremental.upsert_sink(str(out), ["k"], "at")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    drain()
    batch([(2, "c", "2024-01-03"), (3, "d", "2024-01-03")])
    drain()
    drain()
    assert {r["k"]: r["v"] for r in incremental.latest(spark, str(out)).collect()} == {1: "a", 2: "c", 3: "d"}
    stream = incremental.streamed_cells(spark.readStream.schema(schema).parquet(str(src)), "at", ["k"])
    q = stream.writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM cells").first()[0] == 4


def test_versions_survive_restarts_and_crashes(spark, tmp_path):
    from siltstone.sources import versions

    path, schema = str(tmp_path / "t"), "k int, v string, at timestamp"
    rows = lambda k, v: spark.createDataFrame([(k, v)], "k int, v string").withColumn("at", F.current_timestamp())
    held = lambda: {r["k"]: r["v"] for r in incremental.latest(spark, path).collect()}
    incremental.upsert_sink(path, ["k"], "at", "one")(rows(1, "a"), 0)
    incremental.upsert_sink(path, ["k"], "at", "one")(rows(1, "again"), 0)  # the same batch after a restart
    assert held() == {1: "a"}
    incremental.upsert_sink(path, ["k"], "at", "two")(rows(2, "b"), 0)  # a stream with a new checkpoint
    assert held() == {1: "a", 2: "b"}
    rows(9, "lost").write.parquet(f"{path}/v-crashed")  # written, but the writer died before its marker
    assert held() == {1: "a", 2: "b"} and versions.read(spark, path, schema).count() == 2
    for i in range(1, 4):
        incremental.upsert_sink(path, ["k"], "at", "two")(rows(i, "c"), i)
    incremental.upsert_sink(path, ["k"], "at", "one")(rows(1, "old"), 0)  # its marker outlives its folder
    assert held() == {1: "c", 2: "c", 3: "c"}


def test_ledger_never_leaves_a_terminal_status(spark, tmp_path):
    path = str(tmp_path / "l")
    write = incremental.ledger_sink(path, ["k"], "at", query="q")
    batch = lambda *r: spark.createDataFrame(r, "k int, status string, at string").withColumn("at", F.to_timestamp("at"))
    write(batch((1, "pending", "2024-01-01"), (2, "china_match", "2024-01-01")), 0)
    write(batch((1, "not_china", "2024-03-01"), (2, "pending", "2030-01-01"), (3, "pending", "2024-01-01")), 1)
    write(batch((1, "china_match", "2031-01-01"), (3, "retry", "2024-02-01")), 2)
    assert {r["k"]: r["status"] for r in incremental.latest(spark, path).collect()} == {1: "not_china", 2: "china_match", 3: "retry"}


def test_exports(spark, tmp_path):
    a = spark.createDataFrame([("R1", "kpl_lao", "t", "b", "2014-05-01", None, ["x", "y"], "A1", "u")], "record_id string, source_code string, title_original string, body_original string, published_at string, body_file string, topic_labels array<string>, evidence_grade string, original_url string")
    filled = sinks.export_records(a, str(tmp_path / "r")).first()
    assert filled["body_file"] == "text/KPL/2014-05/R1.txt"
    sinks.export_csv(a, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["topic_labels"] == "x|y"
    s = spark.createDataFrame([("main", 1), ("other", 2)], "sample_id string, n int")
    sinks.replace_sample(s, str(tmp_path / "s"))
    sinks.replace_sample(s.where("n = 1").withColumn("n", F.lit(5)), str(tmp_path / "s"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "s")).select("sample_id", "n").collect()} == {("main", 5), ("other", 2)}


def test_pages_are_imported_by_their_hash_chain(spark):
    import hashlib

    from siltstone import schemas

    sha = lambda b: hashlib.sha256(b).hexdigest()
    pdf, body = b"%PDF-1.4 x", "ຂ່າວ ຈີນ"
    native = json.dumps({"pdf_sha256": sha(pdf), "pages": [{"page_num": 1}, {"page_num": 3}]})
    good = ("R1", "ຫົວຂໍ້", body, sha(body.encode()), bytearray(pdf), sha(pdf), native, sha(native.encode()), 3)
    rows = [good, ("R2", *good[1:8], 2), ("R3", *good[1:4], bytearray(b"nope"), *good[5:]), ("R4", *good[1:3], "0" * 64, *good[4:])]
    df = spark.createDataFrame(rows, "record_id string, title_original string, body_original string, content_sha256 string, pdf_content binary, raw_sha256 string, native_json string, native_json_sha256 string, page_num int")
    plan = staging.import_pages(df, spark.createDataFrame([], schemas.ARTICLES))
    assert [r["record_id"] for r in plan["articles"].collect()] == ["R1"]
    assert {r["record_id"]: r["problems"] for r in plan["rejected"].collect()} == {"R2": ["no such page"], "R3": ["no PDF", "PDF hash differs"], "R4": ["body hash differs"]}
