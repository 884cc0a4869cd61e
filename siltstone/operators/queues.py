"""Gates on queues of archive captures: kinds of listings, dated rows, allowed hosts, required columns, safe paths."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

# Listing pages by path, the most telling first.
LISTING_PRIORITY = {
    "/showlistcooperation.php": 0,
    "/showlisteconomic.php": 1,
    "/showlistpolitic.php": 2,
    "/showlistforigner.php": 3,
    "/showlistfinance.php": 4,
    "/showlistagriculture.php": 5,
    "/showlisttechnology.php": 6,
    "/index.php": 7,
}


def listing_kind(url: Column, priority: dict[str, int] = LISTING_PRIORITY) -> Column:
    """struct(kind, priority) of a listing page by its lower-case path, a bare host being its index; else null."""
    path = F.regexp_replace(F.lower(F.coalesce(urls.part(url, "path"), F.lit(""))), "/+$", "")
    path = F.when(url.isNull(), None).when(path == "", "/index.php").otherwise(path)
    rank = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    found = F.try_element_at(rank, path)
    return F.when(found.isNotNull(), F.struct(path.alias("kind"), found.alias("priority")))


def valid_rows(queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rows whose address tells the day they claim, the first of each canonical address by queue_pos.

    queue: original_url, published_at, queue_pos. valid has canonical_url and year_month.
    """
    day, key = urls.identity(F.col("original_url"))["day"], urls.dedupe_key(F.col("original_url"))
    marked = queue.withColumns({"__ok": F.coalesce(day == F.col("published_at"), F.lit(False)), "canonical_url": key})
    first = F.row_number().over(Window.partitionBy("canonical_url", "__ok").orderBy("queue_pos")) == 1
    ranked = marked.withColumn("__keep", F.col("__ok") & first)
    return ranked.where("__keep").withColumn("year_month", F.substring("published_at", 1, 7)).drop("__ok", "__keep"), ranked.where(~F.col("__keep")).select(*queue.columns)


def eligible_rows(queue: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """Rows with a day and no numbered detail page; a host outside the list raises."""
    host = F.regexp_replace(urls.host(F.col("original_url")), "^www\\.", "")
    php = urls.query_value(F.col("original_url"), "p_id").isNotNull() | F.endswith(F.lower(urls.part(F.col("original_url"), "path")), F.lit(urls.DETAIL))
    good = queue.where(~php & F.col("published_at").rlike("^\\d{4}-\\d{2}-\\d{2}$"))
    return good.where(F.when(host.isin(*hosts), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("host not allowed: "), host)).isNotNull()))


def checked_queue(queue: DataFrame, required: tuple[str, ...], archive_host: str) -> DataFrame:
    """The queue, if it has the columns and every archive address is on the archive's host; else an error."""
    if missing := [c for c in required if c not in queue.columns]:
        raise ValueError(f"queue lacks {', '.join(missing)}")
    host = urls.host(F.col("archive_url"))
    return queue.where(F.when(host == archive_host, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not an archive address: "), F.coalesce("archive_url", F.lit("null")))).isNotNull()))


def inside(root: str, relative: str) -> str:
    """The path below root; ValueError if it leaves root."""
    parts: list[str] = []
    for p in PurePosixPath(relative).parts:
        if p == "..":
            if not parts:
                raise ValueError(f"{relative} leaves its root")
            parts.pop()
        elif p == "/":
            raise ValueError(f"{relative} is absolute")
        elif p != ".":
            parts.append(p)
    return "/".join([root.rstrip("/"), *parts])
