"""Tables, shared folders and materialised stages used by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: With it, Spark removes the shuffle files of a finished write at once; its rows are in the written table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to a Python worker at once while a stage is written: whole texts are large.
BATCH_ROWS = "1000"
#: Where doc_id is null a row sorts after all others.
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine without it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def materialise(df: DataFrame, label: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, lost executors cost nothing, shuffle files go.

    conf: session settings for this write alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    own = {_CLEANUP: "true", _BATCH: BATCH_ROWS} | (conf or {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(*stages: DataFrame) -> None:
    """Remove tables of materialise() that nothing reads any more."""
    for df in stages:
        p, fs = _path(df.sparkSession, df._stage_path)
        fs.delete(p, True)


def doc_key():
    """Identity of a row: its id and text, so that rows with one id and different texts stay apart."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))
