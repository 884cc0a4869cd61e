"""Command line over a workspace folder: python -m siltstone.cli --root FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import staging
from .plans import acquire, bootstrap
from .sources import planners, readers, sinks
from .sources.fetch import Fetcher
from .streaming import incremental

STAGED = "title_original string, body_original string, published_at string, original_url string, archive_url string, content_sha256 string, raw_sha256 string, payload_sha256 string, capture_timestamp string, source_code string, language string, evidence_grade string, retrieval_tier string, matched_queries array<string>, date_precision string, body_method string"
PAGES = "record_id string, story_id string, source_article_id string, title_original string, published_at string, body_original string, content_sha256 string, raw_file string, raw_sha256 string, native_json_file string, native_json_sha256 string, page_num int, original_url string"
LEADS = "p_id bigint, title_original string, published_at string, original_url string, listing_url string, source_code string, language string"


def _import(kind: str):
    def run(ws, a):
        rows = readers.ndjson(ws.spark, a.file, LEADS if kind == "listings" else schemas.ARTICLES + ", raw_sha256 string" if kind == "upgrades" else STAGED)
        if kind == "epaper":
            rows = readers.ndjson(ws.spark, a.file, PAGES)
            name = lambda c: F.element_at(F.split(c, "/"), -1)
            files = readers.raw_objects(ws.spark, a.folder).select(name("path").alias("name"), "content")
            pdf, pages = (files.select(F.col("name").alias(k), F.col("content").alias(v)) for k, v in (("pdf_name", "pdf_content"), ("json_name", "json_content")))
            rows = rows.withColumns({"pdf_name": name("raw_file"), "json_name": name("native_json_file")}).join(pdf, "pdf_name", "left").join(pages, "json_name", "left").withColumn("native_json", F.col("json_content").cast("string"))
            plan = staging.import_pages(rows, ws.articles())
        elif kind == "listings":
            plan = staging.import_listings(rows, ws.articles())
        elif kind == "upgrades":
            plan = staging.import_upgrades(rows, ws.articles())
        else:
            plan = staging.import_plan(rows, ws.articles(), "PASAXON-CC-LO" if kind == "commoncrawl" else "PASAXON-ARCH-LO", payload_hash=kind == "commoncrawl")
        ws.save("articles", plan["articles"])
        return {"rejected": plan["rejected"].count()}

    return run


def _pages(ws, a):
    acquire.fetch_pages(ws.spark, Fetcher(budget=a.budget), a.url).write.mode("append").json(ws.path("staging", "pages"))


def _listing(ws, a):
    cards, log = acquire.crawl_listing(ws.spark, Fetcher(budget=a.budget), a.url[0], a.pages)
    cards.write.mode("append").json(ws.path("staging", "cards"))
    log.write.mode("append").json(ws.path("staging", "partitions"))


def _index(ws, a):
    """Capture lists or index answers that were fetched before, as candidate rows."""
    (readers.strict(readers.index_rows(ws.spark, a.file)) if a.command == "discover-commoncrawl" else readers.cdx(ws.spark, a.file)).write.mode("overwrite").json(ws.path("staging", a.command))


def _plan_search(ws, a):
    planners.search_partitions(ws.spark, a.language, a.query, date.fromisoformat(a.first), date.fromisoformat(a.last)).write.mode("overwrite").json(ws.path("staging", "search_plan"))


def _incremental(ws, a):
    rows = ws.articles().withColumn("at", F.try_to_timestamp(F.substring("published_at", 1, 10)))
    as_of = ws.spark.createDataFrame([(a.as_of,)], "d string").select(F.col("d").cast("timestamp"))
    incremental.look_back(rows, "at", as_of, a.days).drop("at").write.mode("overwrite").json(ws.path("staging", "look_back"))


COMMANDS = {
    "init": lambda ws, a: bootstrap.init(ws),
    "import-preview": lambda ws, a: bootstrap.import_seed(ws, a.file),
    "cluster": lambda ws, a: bootstrap.cluster(ws),
    "plan-hydration": lambda ws, a: bootstrap.plan_hydration(ws, a.per_month),
    "sample": lambda ws, a: bootstrap.sample(ws, a.as_of, a.sample_id, a.target),
    "queue-translations": lambda ws, a: bootstrap.queue_translations(ws, a.as_of),
    "export": lambda ws, a: bootstrap.export(ws),
    "quality": lambda ws, a: [r.asDict() for r in bootstrap.quality(ws).collect()],  # a dozen rows
    "bootstrap": lambda ws, a: json.loads(bootstrap.bootstrap(ws, a.file, a.as_of)),
    "inventory": lambda ws, a: bootstrap.inventory(ws),
    "status-report-artifact": lambda ws, a: bootstrap.status_report(ws),
    "incremental-update": _incremental,
    "crawl-pasaxon": _listing,
    "crawl-pasaxon-history": _listing,
    "hydrate-kpl": _pages,
    "crawl-wayback-kpl": _pages,
    "crawl-wayback-pasaxon": _pages,
    "fetch-wayback-kpl-index": _index,
    "fetch-wayback-pasaxon-index": _index,
    "discover-commoncrawl": _index,
    "plan-search": _plan_search,
    "import-pasaxon-round2": _import("wayback"),
    "import-pasaxon-commoncrawl": _import("commoncrawl"),
    "import-pasaxon-listings": _import("listings"),
    "import-pasaxon-wayback-upgrades": _import("upgrades"),
    "import-pasaxon-epaper": _import("epaper"),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("--root", required=True)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--file")
    p.add_argument("--folder", help="saved PDFs and page texts")
    p.add_argument("--url", nargs="*", default=[])
    p.add_argument("--query", nargs="*", default=[])
    p.add_argument("--language", default="lo")
    p.add_argument("--first", default="2012-01-01")
    p.add_argument("--last", default="2026-08-07")
    p.add_argument("--as-of", default=date.today().isoformat())
    p.add_argument("--days", type=int, default=30)
    p.add_argument("--pages", type=int, default=3)
    p.add_argument("--budget", type=int, default=90)
    p.add_argument("--per-month", type=int, default=10)
    p.add_argument("--target", type=int, default=4)
    p.add_argument("--sample-id", default="main")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("siltstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = COMMANDS[a.command](bootstrap.Workspace(spark, a.root), a)
    if out is not None:
        print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, indent=2))
    return out


if __name__ == "__main__":
    main()
