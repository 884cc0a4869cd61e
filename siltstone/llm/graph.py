"""Connected components by alternating large-star and small-star steps, every step a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
    return tuple(row)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, root) for every id of an edge list (a, b) but the roots: root is the least id reachable from it.

    Ids are longs; loops and repeated edges don't matter. An id with many edges is no burden: minima are combined
    before the shuffle and joins on a crowded id are split at run time. Rounds grow with the logarithm of the longest
    chain. No component is ever gathered in one place.
    The result can be given to discard(). Without edges it is empty.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = _signature(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = materialise(small, label)
        seen = _signature(after)
        discard(now)
        now, stable = after, seen == mark
        mark = seen
        if stable:
            break
    out = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out._stage_path = now._stage_path
    return out
