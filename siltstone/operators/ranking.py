"""Scores, best versions, quotas, interleaving: windows instead of loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, screen, vocab
from .shared import written


def has_body(articles: DataFrame) -> Column:
    """Whether there is a body in the row or in a file. A table that knows it in a column with_body needn't carry texts."""
    if "with_body" in articles.columns:
        return F.col("with_body")
    return (F.coalesce("body_original", F.lit("")) != "") | (F.coalesce("body_file", F.lit("")) != "")


def scored(articles: DataFrame) -> DataFrame:
    """articles with score, syndicated, with_body, eligible, family and year_month.

    What the samplers ask of texts is settled here as flags, so no text goes through their shuffles.
    """
    grade = F.create_map(*[F.lit(x) for kv in vocab.GRADE_SCORES.items() for x in kv])
    scope = F.coalesce(F.get_json_object("metadata", "$.scope"), F.lit(""))
    bilateral = F.contains(scope, F.lit(vocab.BILATERAL_SCOPE)) | F.arrays_overlap("topic_labels", F.array(*map(F.lit, vocab.BILATERAL_LABELS)))
    synd = F.coalesce(F.col("content_origin").isin(*vocab.SYNDICATED), F.lit(False))
    score = (
        F.coalesce(F.try_element_at(grade, F.col("evidence_grade")), F.lit(vocab.OTHER_GRADE_SCORE)).cast("double")
        + F.when(bilateral, 45).otherwise(0)
        + F.when(has_body(articles), 20).otherwise(0)
        + F.when(F.col("content_origin").isin(*vocab.LOCAL), 12).otherwise(0)
        - F.when(synd, 8).otherwise(0)
        + F.least(F.length(F.coalesce("title_original", F.lit(""))), F.lit(80)) / F.lit(1000.0)
    )
    ok = screen.formal(F.col("evidence_grade"), F.col("metadata"))
    return articles.withColumns({"score": score, "syndicated": synd, "with_body": has_body(articles), "eligible": ok, "family": screen.family(F.col("source_code")), "year_month": dates.year_month(F.col("published_at"))})


def best_versions(articles: DataFrame, first: str = vocab.SNAPSHOT_START, last: str = vocab.SNAPSHOT_END) -> DataFrame:
    """The best version of each story in its month; ties go to the least record_id."""
    rows = scored(articles).where(F.col("story_id").isNotNull() & dates.within(F.col("published_at"), first, last))
    w = Window.partitionBy("family", "year_month", "story_id").orderBy(F.desc("score"), "record_id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def hydration_candidates(articles: DataFrame, per_month: int = 10) -> DataFrame:
    w = Window.partitionBy("family", "year_month").orderBy(F.desc("score"), "record_id")
    return best_versions(articles).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_month)


def monthly_sample(articles: DataFrame, target: int = vocab.TARGET, require_body: bool = True) -> DataFrame:
    """The monthly quota: at most half of the target is syndicated unless nothing else is left.

    Eligibility is looked at after the best version is chosen, so a story whose best version isn't eligible is out.
    """
    cap = -(-target // 2)
    rows = best_versions(articles).where("eligible")
    rows = rows.where("with_body") if require_body else rows
    # Whatever is chosen is among the first `target` of its kind, so a crowded month goes on with twice that many rows.
    kind = Window.partitionBy("family", "year_month", "syndicated").orderBy(F.desc("score"), "record_id")
    rows = rows.withColumn("k", F.row_number().over(kind)).where(F.col("k") <= target)
    group = Window.partitionBy("family", "year_month")
    places = rows.withColumn("r", F.row_number().over(group.orderBy(F.desc("score"), "record_id")))
    counted = places.withColumn("sr", F.sum(F.col("syndicated").cast("int")).over(group.orderBy("r")))
    later = F.when(F.col("syndicated") & (F.col("sr") > cap), 1).otherwise(0)
    chosen = counted.withColumn("selection_rank", F.row_number().over(group.orderBy(later, "r"))).where(F.col("selection_rank") <= target)
    reason = F.when(F.col("syndicated") & (F.col("selection_rank") > cap), "syndicated_fallback_insufficient_local").otherwise("deterministic_priority")
    return chosen.select("story_id", "record_id", F.col("family").alias("source_code"), "year_month", "selection_rank", "score", reason.alias("quota_reason"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right's row of the same keys; nulls are equal."""
    other = right.select(*[F.col(k).alias(f"__{k}__") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on &= left[k].eqNullSafe(other[f"__{k}__"])
    return left.join(other, on).drop(*[f"__{k}__" for k in keys])


def ranked(rows: DataFrame, group: list[str], order: list, out: str) -> DataFrame:
    """rows with their place within the group, from 1, as row_number() gives it, for groups of any size; out may not be a column yet.

    A global sort deals group and order by range, so a crowded group lies in many tasks; places are counted within a
    task, and the rows that earlier tasks hold of the group are added: a table of at most groups + tasks rows. The
    sorted rows are written once, so give narrow ones. order should be total; ties go as the sort leaves them.
    """
    at = written(rows.orderBy(*group, *order).withColumn("__at", F.monotonically_increasing_id()), "ranked").withColumn("__task", F.shiftright("__at", 33))
    runs = at.groupBy(*group, "__task").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    earlier = F.sum("__n").over(Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    shift = runs.select(*group, "__task", (F.coalesce(earlier, F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    return _null_safe(at, shift, [*group, "__task"]).withColumn(out, F.col("__at") + F.col("__shift")).drop("__at", "__task", "__shift")


def interleave(rows: DataFrame, group: list[str], order: list, groups_order: list | None = None) -> DataFrame:
    """Breadth first over groups: depth within the group, then the groups' order; adds depth and queue_pos.

    No task sees the whole queue or a whole group: depths come from ranked(), places within a depth are counted by
    depth, which holds a row a group, and the rows of smaller depths come from a histogram of depths in blocks.
    """
    deep = ranked(rows, group, order, "depth")
    sizes = deep.groupBy("depth").agg(F.count(F.lit(1)).alias("__n"))
    before = running_before(sizes, "__n", "depth", "__before").select("depth", "__before")
    place = F.row_number().over(Window.partitionBy("depth").orderBy(*(groups_order or group)))
    return deep.join(before, "depth").withColumn("queue_pos", F.col("__before") + place).drop("__before")


def running_before(rows: DataFrame, value: str, position: str, out: str, block: int = 1 << 16, by: list[str] | None = None) -> DataFrame:
    """rows with the sum of value over all smaller positions (of its group): within blocks of positions, and over the blocks' sums."""
    keys = [*(by or []), "__b"]
    blocked = rows.withColumn("__b", F.floor(F.col(position) / block))
    inner = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(*keys).agg(F.sum(value).alias("__s"))
    outer = (Window.partitionBy(*by).orderBy("__b") if by else Window.orderBy("__b")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, F.coalesce(F.sum("__s").over(outer), F.lit(0)).alias("__o"))
    own = blocked.withColumn("__i", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return _null_safe(own, before, keys).withColumn(out, F.col("__i") + F.col("__o")).drop("__b", "__i", "__o")


def first_by(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key: latest, earliest, first seen or best, as order says."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_by(rows: DataFrame, key: list[str], order: list, k: int | Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def kth_nearest(leads: DataFrame, captures: DataFrame, on: str, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """(selected, unavailable): each lead's k-th nearest capture, those after publication first.

    leads: on, published_day; captures: on, capture_day, capture_id.
    """
    both = leads.join(captures, on).withColumn("distance", dates.capture_distance(F.col("capture_day"), F.col("published_day")))
    near = both.withColumn("rank", F.row_number().over(Window.partitionBy(on).orderBy("distance", "capture_id")))
    chosen = near.where(F.col("rank") == k)
    return chosen, leads.join(chosen, on, "left_anti")


def quota_scan(queue: DataFrame, quota: int, budget: int) -> DataFrame:
    """Outcomes of a scan that stops a month at its quota and the whole at its budget; no feedback between months.

    queue: queue_pos, month, base (matches had before), match (what fetching the row would find). A row is fetched
    while the month has fewer than quota matches and fewer than budget rows before it were; the first row past the
    budget and all after it are pending. Neither a month nor the queue lies in one task.
    """
    # Each sum reads its rows twice, so queue and gates are written before they are summed.
    had = running_before(written(queue.withColumn("__m", F.col("match").cast("int")), "scan-queue"), "__m", "queue_pos", "__prior", by=["month"])
    open_ = written(had.withColumn("wanted", (F.col("base") + F.col("__prior") < quota).cast("int")).drop("__m", "__prior"), "scan-gates")
    spent = running_before(open_, "wanted", "queue_pos", "spent")
    # The budget ends the scan at the first wanted row after it is spent.
    stop = spent.where((F.col("wanted") == 1) & (F.col("spent") >= budget)).agg(F.min("queue_pos").alias("stop"))
    out = spent.crossJoin(F.broadcast(stop))  # one row
    outcome = (
        F.when(F.col("queue_pos") >= F.coalesce("stop", F.lit((1 << 62))), "range_budget_exhausted").when(F.col("wanted") == 0, "month_quota_met").when(F.col("match"), "china_match").otherwise("not_china")
    )
    return out.withColumn("outcome", outcome).drop("stop")


def consecutive_stop(rows: DataFrame, key: str, order: list, bad: Column, n: int) -> DataFrame:
    """(key, stop_pos): the place of the n-th bad row in a row, where a breaker opens; keys without one are absent."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("pos", F.row_number().over(w)).withColumn("bad", bad.cast("int"))
    runs = marked.withColumn("run", F.sum(1 - F.col("bad")).over(w))
    long = runs.where("bad = 1").withColumn("n", F.row_number().over(Window.partitionBy(key, "run").orderBy("pos")))
    return long.where(F.col("n") == n).groupBy(key).agg(F.min("pos").alias("stop_pos"))


def reconcile(rows: DataFrame, known_urls: DataFrame, known_hashes: DataFrame, base: DataFrame, quota: int) -> DataFrame:
    """rows with disposition: already known by URL or content, month quota met, or kept.

    rows: url, sha, month, published_at; known_urls: url; known_hashes: sha; base: month, n.
    """
    marked = rows.join(known_urls.select("url", F.lit(True).alias("ku")).distinct(), "url", "left").join(known_hashes.select("sha", F.lit(True).alias("ks")).distinct(), "sha", "left")
    dup = F.coalesce("ku", F.lit(False)) | F.coalesce("ks", F.lit(False))
    placed = ranked(marked.withColumn("dup", dup), ["month", "dup"], ["published_at", "url"], "place").join(base, "month", "left")
    out = F.when(F.col("dup"), "already_in_current_database").when(F.coalesce("n", F.lit(0)) + F.col("place") > quota, "current_month_quota_met").otherwise("kept")
    return placed.withColumn("disposition", out).drop("ku", "ks", "dup", "n", "place")
