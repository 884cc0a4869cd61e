"""Readers: tables, line-delimited JSON, archive indexes, CSV, seeds, raw objects, OCR words, sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates, screen


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(p)
    return found is not None and len(found) > 0


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a missing file has no rows."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def index_rows(spark: SparkSession, path: str) -> DataFrame:
    """Archive index rows with typed columns, further keys in extra, and error where a row breaks a rule (else null)."""
    known = [c.split()[0] for c in schemas.INDEX_ROW.split(", ")]
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = lines.select(F.from_json("value", schemas.INDEX_ROW).alias("r"), F.from_json("value", "map<string,string>").alias("m"))
    blank = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit("")) == ""
    offset, length = F.col("r.offset").try_cast("bigint"), F.col("r.length").try_cast("bigint")
    missing = F.array_join(F.array_compact(F.array(*[F.when(blank(c), c) for c in ("url", "timestamp", "filename", "offset", "length")])), ", ")
    error = F.when(F.col("m").isNull(), "not a JSON object").when(missing != "", F.concat(F.lit("missing required fields: "), missing)).when(offset.isNull() | length.isNull(), "offset and length must be integers").when((offset < 0) | (length <= 0), "offset must be non-negative and length positive")
    extra = F.map_filter("m", lambda k, v: ~k.isin(*known))
    return row.select("r.url", "r.timestamp", "r.filename", offset.alias("offset"), length.alias("length"), F.col("r.status").try_cast("int").alias("status"), "r.mime", "r.digest", "r.urlkey", "r.languages", extra.alias("extra"), error.alias("error"))


def range_columns(rows: DataFrame, base: str = "https://data.commoncrawl.org/") -> DataFrame:
    """rows with warc_url and range_header of their member."""
    return rows.withColumns({"warc_url": F.concat(F.lit(base), "filename"), "range_header": F.concat(F.lit("bytes="), F.col("offset").cast("string"), F.lit("-"), (F.col("offset") + F.col("length") - 1).cast("string"))})


def strict(rows: DataFrame, error: str = "error") -> DataFrame:
    """rows without their error column; the first error raises."""
    return rows.where(F.when(F.col(error).isNull(), F.lit(True)).otherwise(F.raise_error(F.col(error)).isNull())).drop(error)


def cdx(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, original_url, digest, mimetype) of a capture list whose first row names the columns."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json(F.regexp_replace("value", "^﻿", ""), "array<array<string>>").alias("rows")).where(F.size("rows") > 0)
    head = F.element_at("rows", 1)
    at = lambda c: F.array_position(F.col("head"), c).cast("int")
    body = whole.select(head.alias("head"), F.posexplode(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).alias("pos", "row"))
    need = F.when((at("timestamp") == 0) | (at("original") == 0), F.raise_error(F.lit("capture list lacks timestamp or original"))).otherwise(F.lit(None).cast("string"))
    value = lambda c: F.when(at(c) > 0, F.try_element_at(F.col("row"), F.when(at(c) > 0, at(c)).otherwise(F.lit(1))))
    return body.select(F.coalesce(need, value("timestamp")).alias("timestamp"), value("original").alias("original_url"), value("digest").alias("digest"), value("mimetype").alias("mimetype"), "pos")


def arquivo(spark: SparkSession, path: str) -> DataFrame:
    rows = ndjson(spark, path, schemas.ARQUIVO_ROW)
    bad = (F.coalesce("url", F.lit("")) == "") | (F.coalesce("timestamp", F.lit("")) == "")
    return strict(rows.withColumn("error", F.when(bad, "capture row lacks url or timestamp")))


def csv_table(spark: SparkSession, path: str, schema: str = schemas.COVERAGE_CSV) -> DataFrame:
    """A CSV file with a header; a byte order mark before it is ignored, as columns go by place."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True)


_HEADING = r"### ([A-Z]+-(?:LAO|EN)-\d+)｜([^｜\n]*)｜([^\n]*)"


def seed(spark: SparkSession, path: str) -> DataFrame:
    """Article rows of a Markdown seed: a heading of id, time and title, then `- key：value` lines."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.split("value", r"(?=### [A-Z]+-(?:LAO|EN)-\d+｜)"), lambda s: s.rlike("^" + _HEADING))).alias("b"))
    h = lambda i: F.regexp_extract("b", _HEADING, i)
    field = lambda k: F.regexp_extract("b", rf"(?m)^- {k}：([^\n]*)$", 1)
    lao = F.contains(h(1), F.lit("-LAO-"))
    scope, search = field("范围初筛"), F.nullif(F.trim(field("检索页")), F.lit(""))
    q = F.try_url_decode(F.regexp_extract(search, "[?&]search=([^&#]*)", 1))
    labels = F.when(F.contains(scope, F.lit("中老双边")) | F.contains(scope, F.lit("中国在老挝")), F.array(F.lit("bilateral"))).otherwise(F.array(F.lit("china_general")))
    return text.select(
        h(1).alias("record_id"), F.when(lao, "kpl_lao").otherwise("kpl_english").alias("source_code"), F.regexp_extract(h(1), "(\\d+)$", 1).cast("long").cast("string").alias("source_article_id"),
        F.when(lao, "lo").otherwise("en").alias("language"), F.trim(F.regexp_replace(h(3), "\\s+", " ")).alias("title_original"), F.nullif(F.trim(field("摘录")), F.lit("")).alias("excerpt_original"),
        dates.timestamp(h(2))["value"].alias("published_at"), F.lit("indexed_timestamp").alias("date_precision"), labels.alias("topic_labels"), screen.content_origin(field("稿源线索")).alias("content_origin"),
        F.array_compact(F.array(F.nullif(F.trim(q), F.lit("")))).alias("matched_queries"), F.nullif(F.trim(field("原文")), F.lit("")).alias("original_url"), search.alias("search_url"),
        screen.grade_in(field("证据")).alias("evidence_grade"), F.lit("T1_DIRECT_CHINA").alias("retrieval_tier"), F.to_json(F.struct(scope.alias("scope"))).alias("metadata"),
    )


def seed_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("parsed"), F.countDistinct("record_id").alias("unique"), F.count_if(F.col("language") == "lo").alias("lo"), F.count_if(F.col("language") == "en").alias("en"))


def raw_objects(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content, sha256) of files, gunzipped where they are gzip; error where that fails."""
    from .members import gunzip

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    one = files.withColumn("g", gunzip("content"))
    return one.select("path", F.col("g.content").alias("content"), F.sha2("content", 256).alias("sha256"), F.col("g.error").alias("error"))


def tsv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(page_num, block_num, par_num, line_num, text, confidence) of OCR words; confidence weighs words by length."""
    words = spark.read.schema(schemas.TSV_WORDS).csv(path, sep="\t", header=True, quote="").where((F.col("conf") >= 0) & (F.trim("text") != ""))
    line = ["page_num", "block_num", "par_num", "line_num"]
    return words.groupBy(*line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "text"))), lambda w: w["text"]), " ").alias("text"), (F.sum(F.col("conf") * F.length("text")) / F.sum(F.length("text")) / 100).alias("confidence"))


def sitemap(xml) -> DataFrame:
    """Addresses of a sitemap's <loc> elements, as an array column."""
    return F.transform(F.regexp_extract_all(xml, F.lit("(?is)<loc>\\s*([^<]*?)\\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
