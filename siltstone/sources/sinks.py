"""Writers: exports, ledgers, failure logs, capture lists, manifests and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates, screen
from . import versions


def export_json(articles: DataFrame, path: str) -> None:
    articles.orderBy("published_at", "source_code", "record_id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_csv(articles: DataFrame, path: str) -> None:
    """Sixteen fields, labels joined by a bar; a byte order mark before the header of each file tells that it is UTF-8."""
    have = [c for c in schemas.EXPORT_FIELDS if c in articles.columns]
    rows = articles.orderBy("published_at", "source_code", "record_id").select(*[F.array_join(c, "|").alias(c) if c == "topic_labels" else F.col(c) for c in have])
    rows = rows.withColumnRenamed(have[0], "\ufeff" + have[0]) if have else rows
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def markdown(articles: DataFrame) -> Column:
    head = F.concat(F.lit("# "), F.coalesce("title_original", F.lit("")), F.lit("\n\n"))
    line = lambda k: F.concat(F.lit(f"- {k}: "), F.coalesce(F.col(k), F.lit("")), F.lit("\n"))
    return F.concat(head, line("record_id"), line("published_at"), line("evidence_grade"), line("original_url"), F.lit("\n"), F.coalesce("body_original", F.lit("")))


def export_records(articles: DataFrame, path: str) -> DataFrame:
    """Records in folders of family and month, each with its Markdown; returns articles with body_file filled where a body exists."""
    rows = articles.withColumns({"family": screen.family(F.col("source_code")), "year_month": F.coalesce(dates.year_month(F.col("published_at")), F.lit("undated")), "markdown": markdown(articles)})
    rows.write.mode("overwrite").partitionBy("family", "year_month").option("ignoreNullFields", "false").json(path)
    made = F.concat_ws("/", F.lit("text"), screen.family(F.col("source_code")), F.coalesce(dates.year_month(F.col("published_at")), F.lit("undated")), F.concat("record_id", F.lit(".txt")))
    return articles.withColumn("body_file", F.when((F.coalesce("body_file", F.lit("")) == "") & (F.coalesce("body_original", F.lit("")) != ""), made).otherwise(F.col("body_file")))


def rewrite_ledger(rows: DataFrame, path: str) -> str:
    """A whole ledger as a new version: readers of versions.read(..., "json") see the old or the new one, also after a crash."""
    return versions.write(rows, path, kind="json")


def append_failures(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replace_sample(sample: DataFrame, path: str) -> None:
    """The rows of the given sample_ids are replaced, others stay."""
    sample.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id").parquet(path)


def cdx_json(captures: DataFrame) -> DataFrame:
    """One value: the JSON rows of a capture list, header first, in order of time."""
    row = F.struct("timestamp", "original_url", F.array("timestamp", "original_url", "mimetype", "digest").alias("r"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"])
    head = F.array(*map(F.lit, ("timestamp", "original", "mimetype", "digest")))
    return captures.agg(F.to_json(F.array_insert(rows, 1, head), {"ignoreNullFields": "false"}).alias("value"))


def manifest(parts: dict[str, DataFrame], notes: dict | None = None) -> str:
    """Row counts of tables and notes as JSON."""
    counts = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    found = {r["name"]: r["n"] for r in counts.collect()} if counts is not None else {}  # one row a table
    return json.dumps({"counts": dict(sorted(found.items())), **(notes or {})}, ensure_ascii=False, indent=2, sort_keys=True)


def report(title: str, tables: dict[str, DataFrame], rows: int = 1000) -> str:
    """Small aggregates as a Markdown page. A table of more than `rows` rows is an error: a page is no export."""
    out = [f"# {title}"]
    for name, df in tables.items():
        out += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        found = df.limit(rows + 1).collect()
        if len(found) > rows:
            raise ValueError(f"{name} has more than {rows} rows")
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found]
    return "\n".join(out) + "\n"
