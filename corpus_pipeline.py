"""The corpus pipeline: screen, deduplicate lines and documents, decontaminate, pack.

STAGES are (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns rows with the columns of documents, the last one the packed pieces with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.deploy import ship
from siltstone.llm import decontam, line_dedup, packing, simhash, toxicity
from siltstone.llm.common import LAST_ID, materialise, table
from siltstone.llm.queries import word_tokenizer_path


def screen_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of this input's labels predicts to be toxic go."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows. Documents stay, without text at worst."""
    ship(spark)
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays. Rows of one id stay or go together."""
    ship(spark)
    key = F.coalesce("doc_id", F.lit(LAST_ID))
    first = simhash.near_duplicates(docs).where(F.col("component") == key).select(key.alias("__id")).distinct()
    return docs.withColumn("__id", key).join(first.hint("shuffle_hash"), "__id", "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values, go."""
    ship(spark)
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in near-equal windows, with their ids."""
    ship(spark)
    return packing.pack(docs, word_tokenizer_path())


STAGES = [
    ("toxicity", screen_toxicity),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]
#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
