"""Tables that are replaced whole: a folder for each version, a marker for each, and nothing is overwritten.

A version counts once its marker exists; the marker is written under a new name after the version's rows, so readers see
the old table or the new one, and a crash in between leaves a folder that nothing names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_MARK = "_version-"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def newest(spark: SparkSession, path: str, query: str | None = None) -> dict | None:
    """The greatest marker (of one query): number, folder, query, batch; None if there is none."""
    p, fs = _files(spark, path)
    if not fs.exists(p):
        return None
    names = sorted((f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith(_MARK)), reverse=True)
    for name in names:
        _, number, q, batch, folder = name.split("~")
        if query is None or q == query:
            return {"number": int(number), "folder": f"{path}/{folder}", "query": q, "batch": batch}
    return None


def write(df: DataFrame, path: str, query: str = "", batch: int = 0, kind: str = "parquet", keep: int = 2) -> str:
    """Write df as the next version, mark it, and remove versions before the last `keep`; the version's folder."""
    spark = df.sparkSession
    last = newest(spark, path)
    number, folder = (last["number"] if last else 0) + 1, f"v-{uuid.uuid4().hex}"
    df.write.format(kind).save(f"{path}/{folder}")
    _, fs = _files(spark, path)
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_MARK}~{number:012d}~{query}~{batch}~{folder}")
    if not fs.createNewFile(mark):
        raise OSError(f"version {number} of {path} was written by another writer")
    _forget(spark, path, keep)
    return f"{path}/{folder}"


def _forget(spark: SparkSession, path: str, keep: int) -> None:
    """Folders of old versions go first, then their markers; the newest marker of each query stays."""
    p, fs = _files(spark, path)
    names = sorted((f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith(_MARK)), reverse=True)
    seen = set()
    for i, name in enumerate(names):
        _, _, query, _, folder = name.split("~")
        if i >= keep:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}"), True)
            if query in seen:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), False)
        seen.add(query)


def read(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The newest version, or an empty table of the schema."""
    found = newest(spark, path)
    return spark.read.format(kind).schema(schema).load(found["folder"]) if found else spark.createDataFrame([], schema)
