"""Upserts, audits and merges of tables that Parquet holds: a new table from the old one and a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Every column of a key's newest row wins; within the batch the last by order."""
    w = Window.partitionBy(*key).orderBy(F.desc("__new"), *([F.desc(order)] if order else []))
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def upsert_preserving(old: DataFrame, new: DataFrame, key: str, replaced: list[str], kept: list[str]) -> DataFrame:
    """Insert new keys; of known ones replace some columns and keep others."""
    o, n = old.alias("o"), new.alias("n")
    cols = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key)]
    cols += [F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in replaced]
    cols += [(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in new.columns else F.col(f"o.{c}")).alias(c) for c in kept]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols)


def fold_attempts(log: DataFrame, key: list[str], order: list[str], status: Column) -> DataFrame:
    """An event log of partitions as their state: attempts, last status and when."""
    last = F.struct(*order)
    return log.groupBy(*key).agg(F.count(F.lit(1)).alias("attempts"), F.max_by(status, last).alias("status"), F.max(order[0]).alias("last_checked_at"))


def retain_members(queue: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return queue.join(members.select(key).distinct(), key, "left_semi")


def translation_queue(articles: DataFrame, sample: DataFrame) -> DataFrame:
    """Distinct sampled records with the hash of their body; no body, no hash."""
    rows = articles.join(sample.select("record_id"), "record_id", "left_semi")
    digest = F.when(F.coalesce("body_original", F.lit("")) != "", F.sha2("body_original", 256))
    return rows.select("record_id", "story_id", F.col("language").alias("source_language"), digest.alias("body_sha256"), "body_file", F.lit("pending_provider_decision").alias("translation_status"))


def verified(rows: DataFrame, text: str = "body", claimed: str = "content_sha256") -> DataFrame:
    """rows with hash_ok: the text's SHA-256 against the claimed one; no text is not ok."""
    return rows.withColumn("hash_ok", F.coalesce(F.sha2(F.col(text), 256) == F.col(claimed), F.lit(False)))


def audit_tallies(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if("hash_ok").alias("hash_match"), F.count_if(~F.col("hash_ok")).alias("hash_mismatch"))


def reconcile_ledger(records: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """(key, problem): records without a ledger row, matches without a record, and hashes that differ."""
    r = records.select(key, F.col("content_sha256").alias("rs"), F.lit(True).alias("in_records"))
    led = ledger.select(key, F.col("content_sha256").alias("ls"), "status", F.lit(True).alias("in_ledger"))
    both = r.join(led, key, "full_outer")
    problems = F.array_compact(F.array(F.when(F.col("in_ledger").isNull(), "record_without_ledger"), F.when(F.col("in_records").isNull() & (F.col("status") == "china_match"), "missing_record"), F.when(F.col("rs") != F.col("ls"), "hash_mismatch")))
    return both.select(key, F.explode(problems).alias("problem"))


def merge_fields(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row a key; each field is its last non-null value in order."""
    at = F.struct(*order)
    return rows.groupBy(key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields])


def ordered_distinct(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Values of a key by first appearance, without repeats."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(order).alias("__o"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", value))), lambda p: p[value]).alias("values"))


def merged_counts(catalogue: DataFrame, database: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """max(catalogue, database) + staged of every key any of them has; each has key and n."""
    both = catalogue.withColumnRenamed("n", "c").join(database.withColumnRenamed("n", "d"), key, "full_outer").join(staged.withColumnRenamed("n", "s"), key, "full_outer")
    return both.select(key, (F.greatest(F.coalesce("c", F.lit(0)), F.coalesce("d", F.lit(0))) + F.coalesce("s", F.lit(0))).alias("n"))


def in_windows(rows: DataFrame, value: str, windows: DataFrame) -> DataFrame:
    """rows with the label of the window low..high that holds the value. windows is a list of a few rows."""
    return rows.join(F.broadcast(windows), F.col(value).between(F.col("low"), F.col("high")), "left").drop("low", "high")


def weighted_mean(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"), F.avg(value).alias("mean"))


def gap_audit(queue: DataFrame, gaps: DataFrame, screened: DataFrame) -> DataFrame:
    """(rows, in_gap, unscreened, unscreened_in_gap) by source of a queue: url, month, source."""
    q = queue.join(gaps.select("month", F.lit(True).alias("g")).distinct(), "month", "left").join(screened.select("url", F.lit(True).alias("d")).distinct(), "url", "left")
    gap, todo = F.col("g").isNotNull(), F.col("d").isNull()
    return q.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(gap).alias("in_gap"), F.count_if(todo).alias("unscreened"), F.count_if(gap & todo).alias("unscreened_in_gap"))
