"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session, whose driver and tasks share a disk, has a folder in its
    warehouse; a cluster has none that all machines see, and must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stage"


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def stage(df: DataFrame) -> DataFrame:
    """df as a written table. Its files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    _held.append(path)
    return out


def unstage(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in staged:
        where, fs = _path(df.sparkSession, df._staged)
        fs.delete(where, True)
        if df._staged in _held:
            _held.remove(df._staged)


#: Paths of staged tables that are still there.
_held: list[str] = []


def mark() -> int:
    """A place among the staged tables, for release."""
    return len(_held)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete what was staged since a mark, but for some tables: nothing that is read later may come from the others."""
    kept = {getattr(df, "_staged", None) for df in keep}
    for path in _held[since:]:
        if path not in kept:
            where, fs = _path(spark, path)
            fs.delete(where, True)
            _held.remove(path)
