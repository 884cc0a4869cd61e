"""Incremental loads: look-back windows, month cells, exactly-once ledgers and upsert sinks for streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators.tables import upsert
from ..sources import versions


def look_back(rows: DataFrame, at: str, as_of: DataFrame, days: int = 30) -> DataFrame:
    """Rows of the last days before as_of, a one-row frame with one column."""
    limit = as_of.select(F.col(as_of.columns[0]).alias("__as_of"))
    return rows.crossJoin(F.broadcast(limit)).where(F.col(at) >= F.col("__as_of") - F.make_dt_interval(F.lit(days))).drop("__as_of")


def month_cells(rows: DataFrame, at: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, F.date_format(at, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def streamed_cells(stream: DataFrame, at: str, by: list[str], late: str = "30 days", size: str = "1 day") -> DataFrame:
    """Tumbling counts of a stream; rows later than the watermark are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count(F.lit(1)).alias("n"))


def once(stream: DataFrame, key: list[str], at: str, late: str = "30 days") -> DataFrame:
    """Each key once within the watermark; keys older than that are forgotten. For a ledger that never forgets: ledger_sink()."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def ledger_sink(path: str, key: list[str], order: str, status: str = "status", terminal: tuple[str, ...] = vocab.LEDGER_TERMINAL, query: str = ""):
    """A foreachBatch function that keeps a resumable ledger: a key in a terminal status is never changed again.

    Any other status is replaced by the latest of later batches. Versions and restarts are those of upsert_sink().
    """
    query = query or uuid.uuid4().hex

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = versions.newest(spark, path, query)
        if done is not None and int(done["batch"]) >= batch_id:
            return
        current = latest(spark, path)
        if current is None:
            current = batch.limit(0)
        ended = F.col(status).isin(*terminal)
        # Within a batch the first terminal row of a key counts, else the last row.
        rank = F.struct(F.when(ended, 1).otherwise(0), F.when(ended, -F.col(order).cast("timestamp").cast("double")).otherwise(F.col(order).cast("timestamp").cast("double")))
        new = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), rank).alias("__row")).select("__row.*")
        kept = current.where(F.coalesce(ended, F.lit(False)))
        rest = current.where(~F.coalesce(ended, F.lit(False)))
        merged = kept.unionByName(new.join(kept.select(*key), key, "left_anti")).unionByName(rest.join(new.select(*key), key, "left_anti"))
        versions.write(merged, path, query, batch_id)

    return write


def upsert_sink(path: str, key: list[str], order: str, query: str = ""):
    """A foreachBatch function that upserts into a versioned Parquet table (see sources.versions).

    A version's marker names the stream and batch that made it. A batch that the newest version of its stream already
    holds is skipped; query names the stream, so that a stream started anew, with batches from 0 again, says another
    name (by default one for each call) and loses nothing. A crash at any point leaves the last whole version.
    """
    query = query or uuid.uuid4().hex

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = versions.newest(spark, path, query)
        if done is not None and int(done["batch"]) >= batch_id:
            return
        current = latest(spark, path)
        merged = upsert(current if current is not None else batch.limit(0), batch, key, order)
        versions.write(merged, path, query, batch_id)

    return write


def latest(spark, path: str) -> DataFrame | None:
    """The table an upsert sink has written last, if any."""
    found = versions.newest(spark, path)
    return spark.read.parquet(found["folder"]) if found else None
