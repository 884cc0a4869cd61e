"""Importers of staged records: verify, drop what is known, plan upserts and evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from .tables import upsert

_HEX = "^[0-9a-f]{64}$"


def _flag(bad: Column, name: str) -> Column:
    """The problem's name where bad is true or, for lack of a value, unknown."""
    return F.when(F.coalesce(bad, F.lit(True)), name)


def problems(rows: DataFrame, body_hash: bool = True, raw_hash: bool = True, payload_hash: bool = False) -> Column:
    """Array of what is wrong with a staged record: missing fields, bad hashes, no day."""
    checks = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"{c} missing") for c in ("title_original", "body_original", "published_at", "original_url") if c in rows.columns]
    checks.append(_flag(~F.col("published_at").rlike("^\\d{4}-\\d{2}-\\d{2}"), "published_at is no day"))
    if body_hash:
        checks.append(_flag(F.sha2("body_original", 256) != F.col("content_sha256"), "body hash differs"))
    for on, column, content in ((raw_hash, "raw_sha256", "raw_content"), (payload_hash, "payload_sha256", "payload_content")):
        if on:
            same = F.sha2(content, 256) == F.col(column) if content in rows.columns else F.col(column).rlike(_HEX)
            checks.append(F.when(~F.coalesce(same, F.lit(False)), f"{column} not verified"))
    return F.array_compact(F.array(*checks))


def verified(rows: DataFrame, **which) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with problems)."""
    marked = rows.withColumn("problems", problems(rows, **which))
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def import_plan(rows: DataFrame, articles: DataFrame, prefix: str, **which) -> dict[str, DataFrame]:
    """articles, evidence, skipped and rejected after an import.

    A record whose address (default ports and case aside) an article has is skipped. Ids come from the canonical
    address; the title is repaired from the body; equal ids within the batch go to the last by capture time.
    """
    good, bad = verified(rows, **which)
    good = good.withColumn("__u", F.lower(urls.staging(F.col("original_url"))))
    known = articles.where("original_url IS NOT NULL").select(F.lower(F.replace("original_url", F.lit(":80/"), F.lit("/"))).alias("__u")).distinct()
    fresh = good.join(known, "__u", "left_anti")
    made = fresh.withColumns({"record_id": text.stable_id(prefix, urls.staging(F.col("original_url"))), "title_original": text.usable_title(F.col("title_original"), F.col("body_original"))})
    merged = upsert(articles, made.select(*[c for c in articles.columns if c in made.columns], *(["capture_timestamp"] if "capture_timestamp" in made.columns and "capture_timestamp" not in articles.columns else [])), ["record_id"], "capture_timestamp" if "capture_timestamp" in made.columns else None)
    return {"articles": merged.select(*articles.columns), "evidence": evidence(made), "skipped": good.join(known, "__u", "left_semi").drop("__u"), "rejected": bad}


def evidence(rows: DataFrame, kind: str = "archived_official_html", mark: str = "") -> DataFrame:
    """Evidence rows keyed by record and hash."""
    url = F.coalesce(*[F.col(c) for c in ("archive_url", "original_url") if c in rows.columns])
    return rows.select(F.concat("record_id", F.lit(f":{mark}:" if mark else ":"), "content_sha256").alias("evidence_id"), "record_id", F.lit(kind).alias("evidence_type"), "evidence_grade", url.alias("evidence_url"), "content_sha256", F.lit(True).alias("title_match"), F.lit(True).alias("date_match"))


def import_listings(leads: DataFrame, articles: DataFrame, first_year: int = 2021, last_year: int = 2022, least_lao: int = 3) -> dict[str, DataFrame]:
    """Listing leads: known numbers only get evidence, new ones become A2 articles without a body."""
    year = F.substring("published_at", 1, 4).cast("int")
    ok = year.between(first_year, last_year) & (text.lao_count(F.col("title_original")) >= least_lao)
    known = articles.select(urls.query_value(F.col("original_url"), "p_id").cast("long").alias("p_id"), F.col("record_id").alias("known_id")).where("p_id IS NOT NULL").dropDuplicates(["p_id"])
    good = leads.where(ok).join(known, "p_id", "left")
    named = good.withColumn("record_id", F.coalesce("known_id", text.stable_id("PASAXON-CC-LIST-LO", F.concat(F.lit("pasaxon-listing:"), F.col("p_id").cast("string")))))
    new = named.where("known_id IS NULL").withColumns({"evidence_grade": F.lit("A2"), "date_precision": F.lit("official_listing_day"), "body_original": F.lit(None).cast("string")})
    return {"articles": upsert(articles, new.select(*[c for c in articles.columns if c in new.columns]), ["record_id"]).select(*articles.columns), "evidence": named.select(F.concat("record_id", F.lit(":listing:"), F.sha2("listing_url", 256)).alias("evidence_id"), "record_id", F.lit("A2").alias("evidence_grade"), F.col("listing_url").alias("evidence_url")), "rejected": leads.where(~F.coalesce(ok, F.lit(False)))}


def import_upgrades(upgrades: DataFrame, articles: DataFrame) -> dict[str, DataFrame]:
    """Bodies for A2 articles: id, day, title and hash must agree; equal hashes are skipped; the grade becomes B1."""
    u, a = upgrades.alias("u"), articles.alias("a")
    both = a.join(u, F.col("a.record_id") == F.col("u.record_id"))
    fits = (F.substring("a.published_at", 1, 10) == F.substring("u.published_at", 1, 10)) & (F.sha2("u.body_original", 256) == F.col("u.content_sha256")) & text.titles_agree(F.col("a.title_original"), F.col("u.title_original"))
    fresh = both.where(F.coalesce(F.col("a.content_sha256"), F.lit("")) != F.col("u.content_sha256"))
    better = fresh.where(fits).select(*[F.col(f"u.{c}") if c in upgrades.columns and c not in ("record_id", "evidence_grade") else F.lit("B1").alias(c) if c == "evidence_grade" else F.col(f"a.{c}") for c in articles.columns])
    return {"articles": upsert(articles, better, ["record_id"]).select(*articles.columns), "upgraded": better, "rejected": fresh.where(~F.coalesce(fits, F.lit(False))).select("u.*")}


def import_pages(rows: DataFrame, articles: DataFrame) -> dict[str, DataFrame]:
    """E-paper articles: a PDF by its first bytes, four hashes, and a page number among the pages that were read."""
    checks = F.array_compact(
        F.array(
            _flag(F.substring(F.col("pdf_content"), 1, 5).cast("string") != "%PDF-", "no PDF"),
            _flag(F.sha2("pdf_content", 256) != F.col("raw_sha256"), "PDF hash differs"),
            _flag(F.sha2("native_json", 256) != F.col("native_json_sha256"), "page text hash differs"),
            _flag(F.get_json_object("native_json", "$.pdf_sha256") != F.col("raw_sha256"), "page text is of another PDF"),
            _flag(F.sha2("body_original", 256) != F.col("content_sha256"), "body hash differs"),
            _flag(~F.coalesce(F.array_contains(F.from_json(F.get_json_object("native_json", "$.pages[*].page_num"), "array<int>"), F.col("page_num")), F.lit(False)) & (F.coalesce(F.get_json_object("native_json", "$.pages[*].page_num"), F.lit("")) != F.col("page_num").cast("string")), "no such page"),
        )
    )
    marked = rows.withColumn("problems", checks)
    good = marked.where(F.size("problems") == 0)
    return {"articles": upsert(articles, good.select(*[c for c in articles.columns if c in good.columns]), ["record_id"]).select(*articles.columns), "rejected": marked.where(F.size("problems") > 0)}
