"""The operN queries over the standard tables, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, debruijn, decontam, licenses, line_dedup, media_gif, oracles, packing, simhash, suffix_array, toxicity
from .common import table

CONTROL_TURN = "</s>[INST] ok [/INST]"


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rk")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_gif.media_digest(media_gif.sample_media(table(spark, sf_dir, "documents")))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TURN).alias("text"))
    records = chat_format.records_of_rows(rows.unionByName(probe))
    return chat_format.chat_digest(chat_format.format_chats(chat_format.canonical_turns(records, "conv_id"), "conv_id"), "conv_id")


def op5_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.dedup(table(spark, sf_dir, "documents"), with_text=False).drop("paths")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup(table(spark, sf_dir, "documents"), with_bytes=False)


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer_path(), with_ids=False)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_template_decontamination, op2_line_dedup, op3_gif_media, op4_chat_formatting, op5_debruijn_dedup, op6_simhash_near_dedup, op7_suffix_array_dedup, op8_packing, op9_license_scan, op10_toxicity)}
ORACLES: dict[str, str] = {
    "op4_chat_formatting": oracles.CHAT_FORMATTING,
    "op5_debruijn_dedup": oracles.DEBRUIJN_DEDUP,
    "op7_suffix_array_dedup": oracles.SUFFIX_ARRAY_DEDUP,
    "op9_license_scan": licenses.scan_sql(),
}
