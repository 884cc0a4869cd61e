"""Search, detail, tag and index addresses, and plans of partitions."""

from __future__ import annotations

from datetime import date
from urllib.parse import quote, urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = {"lo": "lo", "lao": "lo", "laos": "lo", "en": "en", "english": "en", "eng": "en"}  # fixed values


def language(name: str) -> str:
    try:
        return LANGUAGES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown language {name!r}") from None


def search_url(base: str, lang: str, query: str, first: date, last: date, page: int = 1) -> str:
    if page < 1:
        raise ValueError("pages begin at 1")
    folder = "" if language(lang) == "lo" else "/En"
    return f"{base}{folder}/search.aspx?" + urlencode({"cat": 1, "search": query, "fd": f"{first:%d/%m/%Y}", "td": f"{last:%d/%m/%Y}", "page": page})


def detail_url(base: str, lang: str, number: str | int) -> str:
    text = str(number).strip()
    if not text.isdigit():
        raise ValueError(f"no article number: {number!r}")
    return f"{base}{'' if language(lang) == 'lo' else '/En'}/detail.aspx?id={int(text)}"


def tag_url(base: str, query: str, page: int = 1) -> str:
    return f"{base}/tags/{quote(query)}.html" + (f"?page={page}" if page > 1 else "")


def search_partitions(spark: SparkSession, lang: str, queries: list[str], first: date, last: date) -> DataFrame:
    """(language, query, date_from, date_to): a row for each query and calendar year; English ignores dates and has one."""
    if last < first:
        raise ValueError("the last day is before the first")
    lang = language(lang)
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(dict.fromkeys(q.strip() for q in queries if q.strip()))], "pos int, query string")
    years = F.array(F.lit(None).cast("int")) if lang == "en" else F.sequence(F.lit(first.year), F.lit(last.year))
    f, t = F.lit(first.isoformat()), F.lit(last.isoformat())
    y = F.col("year").cast("string")
    return rows.select("pos", "query", F.explode(years).alias("year")).select(
        F.lit(lang).alias("language"), "query", F.coalesce(F.greatest(f, F.concat(y, F.lit("-01-01"))), f).alias("date_from"), F.when(F.col("year").isNull(), t).otherwise(F.least(t, F.concat(y, F.lit("-12-31")))).alias("date_to")
    )


def index_query(base: str, index: str, pattern: str, page_size: int = 200) -> str:
    return f"{base}/{index}-index?" + urlencode({"url": pattern, "output": "json", "pageSize": page_size})


def cdx_query(base: str, pattern: str, first: str, last: str, limit: int | None = None) -> str:
    return f"{base}?" + urlencode({"url": pattern, "output": "json", "from": first, "to": last, "fl": "timestamp,original,mimetype,digest", "filter": "statuscode:200", **({"limit": limit} if limit else {})})
