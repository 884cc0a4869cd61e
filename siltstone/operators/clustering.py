"""Story clustering: language versions of one source article share a story."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab


def assign_story_ids(articles: DataFrame, shared_family: str = vocab.FAMILIES[0]) -> DataFrame:
    """articles with story_id and cluster_method: the shared family's article number makes the story, else the record does."""
    up = F.upper("source_code")
    sid = F.col("source_article_id")
    shared = F.startswith(up, F.lit(shared_family)) & (F.coalesce(sid, F.lit("")) != "")
    number = F.coalesce(F.nullif(F.regexp_replace(sid, "\\D", ""), F.lit("")), F.lit("0")).try_cast("long")
    story = F.when(shared, F.format_string(f"{shared_family}-STORY-%06d", number)).otherwise(F.concat(up, F.lit("-STORY-"), F.col("record_id")))
    return articles.withColumn("story_id", story).withColumn("cluster_method", F.when(shared, "shared_source_article_id").otherwise("single_record"))


def clusters(articles: DataFrame) -> DataFrame:
    """One row a story; the least record_id represents it."""
    return articles.groupBy("story_id").agg(F.min_by(F.upper("source_code"), "record_id").alias("source_code"), F.min("record_id").alias("representative_record_id"), F.min_by("cluster_method", "record_id").alias("cluster_method"), F.lit(1.0).alias("confidence"))


def keep_known(known: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-or-ignore: clusters that exist stay as they are."""
    return known.unionByName(new.join(known, "story_id", "left_anti"), allowMissingColumns=True)
