"""Coverage, gap queue, inventories, quality findings and status: aggregates joined to a dense grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, screen, vocab
from .ranking import has_body


def grid(spark, first: str = vocab.SNAPSHOT_START, last: str = vocab.SNAPSHOT_END, families=vocab.FAMILIES) -> DataFrame:
    """(family, year_month) for every family and month: a few hundred rows, made on the spot."""
    return dates.months(spark, first, last).select(F.explode(F.array(*map(F.lit, families))).alias("family"), "year_month")


def dated(articles: DataFrame) -> DataFrame:
    return articles.withColumns({"family": screen.family(F.col("source_code")), "year_month": dates.year_month(F.col("published_at")), "year": F.substring("published_at", 1, 4)})


def full_text(articles: DataFrame) -> Column:
    """Reports count a body only if it isn't blank, unlike the sampler, which takes any. A column with_text says so without texts."""
    if "with_text" in articles.columns:
        return F.col("with_text")
    return F.coalesce(F.trim("body_original"), F.lit("")) != ""


def cells(articles: DataFrame) -> DataFrame:
    """Distinct stories of each family and month: discovered, eligible, and eligible with a body."""
    ok = screen.formal(F.col("evidence_grade"), F.col("metadata"))
    rows = dated(articles).where(F.col("published_at").isNotNull() & F.col("story_id").isNotNull())
    return rows.groupBy("family", "year_month").agg(F.countDistinct("story_id").alias("candidates"), F.countDistinct(F.when(ok, F.col("story_id"))).alias("eligible"), F.countDistinct(F.when(ok & has_body(articles), F.col("story_id"))).alias("qualified"))


def sample_cells(sample: DataFrame) -> DataFrame:
    return sample.groupBy(F.col("source_code").alias("family"), "year_month").agg(F.count(F.lit(1)).alias("sampled"))


def coverage_status(n: Column) -> Column:
    return F.when(n >= vocab.TARGET, "target_met").when(n >= vocab.MINIMUM, "minimum_met").otherwise("documented_gap")


def monthly_coverage(articles: DataFrame, sample: DataFrame, first: str = vocab.SNAPSHOT_START, last: str = vocab.SNAPSHOT_END) -> DataFrame:
    g = grid(articles.sparkSession, first, last).join(cells(articles), ["family", "year_month"], "left").join(sample_cells(sample), ["family", "year_month"], "left")
    g = g.fillna(0, ["candidates", "eligible", "qualified", "sampled"])
    r = vocab.GAP_REASONS
    reason = F.when(F.col("candidates") == 0, r[0]).when(F.col("eligible") == 0, r[1]).when(F.col("qualified") == 0, r[2]).when(F.col("sampled") < vocab.MINIMUM, r[3]).when(F.col("sampled") < vocab.TARGET, r[4]).otherwise(r[5])
    return g.select(F.col("family").alias("source"), "year_month", F.col("candidates").alias("candidate_story_count"), F.col("eligible").alias("eligible_story_count"), F.col("qualified").alias("qualified_body_story_count"), F.col("sampled").alias("sample_story_count"), coverage_status(F.col("sampled")).alias("coverage_status"), (F.col("year_month") == last[:7]).cast("int").alias("partial_period"), reason.alias("gap_reason"))


def backfill_queue(articles: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    """Priority and next steps of every grid cell by its discovered stories. partitions: source_code of earlier attempts."""
    found = dated(articles).where("published_at IS NOT NULL").groupBy("family", "year_month").agg(F.countDistinct("story_id").alias("n"))
    g = grid(articles.sparkSession).join(found, ["family", "year_month"], "left").fillna(0, ["n"])
    if partitions is None:
        g = g.withColumn("tried", F.lit(0).cast("long"))
    else:
        tried = partitions.groupBy(F.upper("source_code").alias("family")).agg(F.count(F.lit(1)).alias("tried"))
        g = g.join(tried, "family", "left").fillna(0, ["tried"])
    old = F.col("year_month") < vocab.HISTORICAL_BEFORE
    return g.select(
        F.col("family").alias("source"), "year_month", F.col("n").alias("candidate_story_count"),
        F.when(old & (F.col("n") < 2), "P0").when(F.col("n") < 4, "P1").otherwise("P2").alias("priority"),
        F.concat(F.lit("current_site_partitions="), F.col("tried").cast("string"), F.lit("; seed_import="), (F.col("family") == vocab.FAMILIES[0]).cast("int").cast("string")).alias("attempted_entry_points"),
        F.when(old, vocab.HISTORICAL_ENTRIES).otherwise(vocab.CURRENT_ENTRIES).alias("next_entry_points"),
        F.when(F.col("n") < 2, "backfill_required").when(F.col("n") < 4, "enrichment_required").otherwise("candidate_target_met").alias("status"),
    )


def _measures(articles: DataFrame) -> list[Column]:
    body = full_text(articles)
    grades = [F.count_if(F.col("evidence_grade") == g).alias(g.lower()) for g in vocab.GRADES]
    return [F.count(F.lit(1)).alias("records"), F.count_if(body).alias("bodies"), F.countDistinct("year_month").alias("candidate_months"), F.countDistinct(F.when(body, F.col("year_month"))).alias("body_months"), *grades, F.min(dates.day(F.col("published_at"))).alias("first_date"), F.max(dates.day(F.col("published_at"))).alias("last_date")]


def source_year_inventory(articles: DataFrame, sample: DataFrame) -> DataFrame:
    rows = dated(articles).where("published_at IS NOT NULL")
    picked = rows.join(sample.select("record_id"), "record_id").groupBy("source_code", "year").agg(F.count(F.lit(1)).alias("selected"))
    return rows.groupBy("family", "source_code", "year").agg(*_measures(articles)).join(picked, ["source_code", "year"], "left").fillna(0, ["selected"]).withColumnRenamed("family", "source_family")


def family_year_inventory(articles: DataFrame, sample: DataFrame) -> DataFrame:
    """Months are counted anew at the family's grain: its sources overlap."""
    rows = dated(articles).where("published_at IS NOT NULL")
    picked = rows.join(sample.select("record_id"), "record_id").groupBy("family", "year").agg(F.count(F.lit(1)).alias("selected"))
    return rows.groupBy("family", "year").agg(*_measures(articles)).join(picked, ["family", "year"], "left").fillna(0, ["selected"]).withColumnRenamed("family", "source_family")


def family_totals(articles: DataFrame) -> DataFrame:
    body = full_text(articles)
    return dated(articles).groupBy("family").agg(F.count(F.lit(1)).alias("records"), F.count_if(body).alias("bodies"), F.countDistinct(F.when(body, F.col("year_month"))).alias("body_months"), F.min(dates.day(F.col("published_at"))).alias("first_date"), F.max(dates.day(F.col("published_at"))).alias("last_date"))


def status_histogram(sample: DataFrame) -> DataFrame:
    return sample_cells(sample).groupBy(coverage_status(F.col("sampled")).alias("coverage_status")).agg(F.count(F.lit(1)).alias("n"))


def historical_coverage(sample: DataFrame, first: str = "2012-01-01", last: str = "2020-12-31") -> DataFrame:
    g = grid(sample.sparkSession, first, last).join(sample_cells(sample), ["family", "year_month"], "left").fillna(0, ["sampled"])
    return g.groupBy(F.col("family").alias("source")).agg(*[F.count_if(coverage_status(F.col("sampled")) == s).alias(s) for s in ("target_met", "minimum_met", "documented_gap")])


def yearly_status(articles: DataFrame, sample: DataFrame, first: int = 2012, last: int = 2026) -> DataFrame:
    """A row for each family and year, zeros included."""
    rows, body = dated(articles).where("published_at IS NOT NULL"), full_text(articles)
    facts = rows.groupBy(F.col("family").alias("source"), "year").agg(F.count(F.lit(1)).alias("records"), F.count_if(body).alias("bodies"), F.countDistinct(F.when(body, F.col("year_month"))).alias("body_months"), *[F.count_if(F.col("evidence_grade") == g).alias(g.lower()) for g in ("A1", "A2", "B1")])
    picked = sample.groupBy(F.col("source_code").alias("source"), F.substring("year_month", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("selected"))
    years = articles.sparkSession.range(first, last + 1).select(F.col("id").cast("string").alias("year"), F.explode(F.array(*map(F.lit, vocab.FAMILIES))).alias("source"))
    return years.join(facts, ["source", "year"], "left").join(picked, ["source", "year"], "left").fillna(0).select("source", "year", "records", "bodies", "body_months", "selected", "a1", "a2", "b1")


def coverage_by_year(sample: DataFrame, first: str = vocab.SNAPSHOT_START, last: str = vocab.SNAPSHOT_END) -> DataFrame:
    g = grid(sample.sparkSession, first, last).join(sample_cells(sample), ["family", "year_month"], "left").fillna(0, ["sampled"])
    return g.groupBy(F.col("family").alias("source"), F.substring("year_month", 1, 4).alias("year")).agg(*[F.count_if(coverage_status(F.col("sampled")) == s).alias(s) for s in ("target_met", "minimum_met", "documented_gap")])


def orphans(relations: dict[str, tuple[DataFrame, str]], articles: DataFrame) -> DataFrame:
    """(relation, n): rows whose record no article has."""
    ids, out = articles.select(F.col("record_id").alias("__id")), None
    for name, (df, column) in relations.items():
        one = df.join(ids, df[column] == ids["__id"], "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def quality_checks(articles: DataFrame, sample: DataFrame, relations: dict[str, tuple[DataFrame, str]], failed_partitions: DataFrame | None = None) -> DataFrame:
    """(check, severity, n) of every check, zeros included; findings() keeps those that found something."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    out_of_range = F.col("published_at").isNotNull() & ~dates.within(F.col("published_at"), vocab.SNAPSHOT_START, vocab.SNAPSHOT_END)
    whole = articles.agg(
        (F.count(F.lit(1)) - F.countDistinct("record_id")).alias("duplicate_record_ids"),
        (F.count_if(F.startswith(F.upper("source_code"), F.lit(vocab.FAMILIES[1]))) == 0).cast("long").alias("second_family_absent"),
        F.count_if(out_of_range).alias("out_of_range_dates"),
        F.count_if(~F.col("evidence_grade").isin(*vocab.GRADES)).alias("invalid_evidence_grades"),
        F.count_if(~F.col("retrieval_tier").isin(*vocab.TIERS)).alias("invalid_retrieval_tiers"),
        F.count_if(blank("title_original") | blank("source_code") | blank("language")).alias("required_fields_missing"),
    )
    picked = articles.join(sample.select("record_id"), "record_id").agg(
        F.count_if(~has_body(articles)).alias("sample_missing_body"), F.count_if(empty("original_url") & empty("archive_url")).alias("sample_missing_url"), F.count_if(blank("china_note_zh")).alias("sample_missing_note")
    )
    gaps = grid(articles.sparkSession).join(sample_cells(sample), ["family", "year_month"], "left").agg(F.count_if(F.coalesce("sampled", F.lit(0)) < vocab.MINIMUM).alias("coverage_gap_cells"))
    lost = orphans(relations, articles).agg(F.sum("n").alias("orphan_rows"))
    failed = (failed_partitions.where("status = 'failed'").agg(F.count(F.lit(1)).alias("failed_partitions"))) if failed_partitions is not None else articles.sparkSession.range(1).select(F.lit(0).cast("long").alias("failed_partitions"))
    one = whole.crossJoin(picked).crossJoin(gaps).crossJoin(lost).crossJoin(failed)  # one row each
    severity = {"duplicate_record_ids": "Critical", "orphan_rows": "Critical", "second_family_absent": "High", "sample_missing_body": "High", "sample_missing_url": "High", "sample_missing_note": "High", "coverage_gap_cells": "High", "failed_partitions": "Medium", "out_of_range_dates": "High", "invalid_evidence_grades": "High", "invalid_retrieval_tiers": "High", "required_fields_missing": "Critical"}
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(s).alias("severity"), F.col(k).cast("long").alias("n")) for k, s in severity.items()])
    return one.select(F.inline(rows))


def findings(checks: DataFrame) -> DataFrame:
    """Checks that found something; a single Low row if none did."""
    found = checks.where("n > 0")
    none = checks.agg(F.count_if(F.col("n") > 0).alias("c")).where("c = 0").select(F.lit("no_blocking_problem").alias("check"), F.lit("Low").alias("severity"), F.lit(0).cast("long").alias("n"))
    return found.unionByName(none)
