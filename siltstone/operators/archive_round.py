"""Archive rounds as one configurable pipeline: candidates, one capture an address, known ones out, interleaving, budgeted scan."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from . import ranking


@dataclass(frozen=True)
class Round:
    first_year: int
    last_year: int
    prefer: str = "latest"  # or earliest
    quota: int = 2
    budget: int = 90
    php: bool = False
    gap_first: bool = True
    breaker: int = 0  # failures in a row that stop the scan; 0: none


#: Rounds by name. Years, preference, quota and budget are fixed values.
ROUNDS = {
    "replay_2012_2013": Round(2012, 2013, budget=120),
    "replay_2014_2020": Round(2014, 2020, budget=93),
    "replay_gaps": Round(2012, 2020, budget=90, breaker=3),
    "index_2014_2019": Round(2014, 2019),
    "index_2021_2022": Round(2021, 2022, budget=120, php=True, breaker=5),
    "listings": Round(2021, 2022, prefer="earliest", php=True),
}


def candidates(captures: DataFrame, config: Round) -> DataFrame:
    """One capture of each address that its own text dates into the years (or numbers, where allowed).

    captures: original_url, timestamp and what else is to be kept.
    """
    who = urls.identity(F.col("original_url"))
    rows = captures.withColumns({"identity": who, "canonical_url": urls.dedupe_key(F.col("original_url")), "category": urls.source_path(F.col("original_url"))})
    year = F.substring(F.coalesce("identity.day", "identity.month"), 1, 4).cast("int")
    fits = year.between(config.first_year, config.last_year)
    fits = F.coalesce(fits, F.lit(False)) | (F.col("identity").isNotNull() & year.isNull()) if config.php else F.coalesce(fits, F.lit(False))
    order = [F.desc("timestamp") if config.prefer == "latest" else F.asc("timestamp"), "original_url"]
    return ranking.first_by(rows.where(fits), ["canonical_url"], order).withColumns({"year_month": F.col("identity.month"), "slot": F.col("identity.slot")})


def queue(rows: DataFrame, config: Round, known: DataFrame, gaps: DataFrame) -> DataFrame:
    """Unknown candidates in breadth-first order of months, gap months first. known: canonical_url; gaps: year_month."""
    todo = rows.join(known.select("canonical_url").distinct(), "canonical_url", "left_anti")
    todo = todo.join(gaps.select("year_month", F.lit(0).alias("g")).distinct(), "year_month", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    return ranking.interleave(todo, ["year_month"], ["slot", "canonical_url"], ["g", "year_month"] if config.gap_first else ["year_month"]).drop("g")


def fold_scan(queued: DataFrame, config: Round) -> DataFrame:
    """The exact outcome of a scan with feedback: quota of a month, blocked categories, budget and breaker.

    queued: queue_pos, year_month, category, base, result (what fetching gives: china_match, not_china,
    contaminated_template or failed), terminal. Adds outcome. A queue has one reader, so this runs in one task over
    the few columns it needs; for rows without feedback ranking.quota_scan() is the distributed form.
    """

    def run(batches):
        had: dict = {}
        blocked: set = set()
        spent = streak = 0
        over: str | None = None
        for pdf in batches:
            out = []
            for month, category, base, result, terminal in zip(pdf["year_month"], pdf["category"], pdf["base"], pdf["result"], pdf["terminal"], strict=True):
                if over is not None:
                    out.append(over)
                elif terminal:
                    out.append("terminal")
                elif base + had.get(month, 0) >= config.quota:
                    out.append("month_quota_met")
                elif category in blocked:
                    out.append("blocked_contaminated_template_path")
                elif spent >= config.budget:
                    over = "range_budget_exhausted"
                    out.append(over)
                else:
                    spent += 1
                    out.append(result)
                    streak = streak + 1 if result == "failed" else 0
                    if result == "contaminated_template":
                        blocked.add(category)
                    elif result == "china_match":
                        had[month] = had.get(month, 0) + 1
                    if config.breaker and streak >= config.breaker:
                        over = "archive_error_circuit_breaker"
            yield pd.DataFrame({"queue_pos": pdf["queue_pos"], "outcome": out})

    slim = queued.select(F.col("queue_pos").cast("long").alias("queue_pos"), "year_month", "category", F.col("base").cast("long").alias("base"), "result", "terminal")
    told = slim.repartition(1).sortWithinPartitions("queue_pos").mapInPandas(run, "queue_pos long, outcome string")
    return queued.join(told, "queue_pos")


def supplemental(matches: DataFrame, quota: int) -> DataFrame:
    """matches with status: beyond a month's quota a match is supplemental. matches: month, base, queue_pos."""
    place = F.row_number().over(Window.partitionBy("month").orderBy("queue_pos"))
    return matches.withColumn("status", F.when(F.col("base") + place > quota, "china_match_non_gap").otherwise("china_match"))


def reparse(previous: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Status after a new parser went over saved pages: matches that no longer match are demoted, new ones promoted.

    previous: key, status; parsed: key, related, error.
    """
    both = previous.join(parsed, key, "left")
    status = (
        F.when(F.col("related").isNull() & F.col("error").isNull(), F.col("status"))
        .when(F.col("error").isNotNull(), "parse_failure")
        .when((F.col("status") == "china_match") & ~F.col("related"), "not_china_after_body_reparse")
        .when(F.col("related"), "china_match")
        .otherwise("not_china")
    )
    return both.select(key, F.col("status").alias("prior_status"), status.alias("status"))
