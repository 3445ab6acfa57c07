"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[tempfile.TemporaryDirectory] = []


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir if set; else the warehouse on a cluster, and on one machine (as in tests) a temporary folder."""
    conf = spark.sparkContext.getConf()
    if shared := conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    if conf.get("spark.master", "local").split("[")[0] != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    if not _own:
        _own.append(tempfile.TemporaryDirectory(prefix="tessera-"))
        atexit.register(_own[0].cleanup)
    return f"file://{_own[0].name}"


#: Paths of the tables that this process has written and not dropped.
_paths: dict[str, None] = {}


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there, and the loss of an executor costs no recomputation."""
    path = f"{work_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths[path] = None
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more, such as those of earlier rounds."""
    for df in tables:
        remove(df.sparkSession, getattr(df, "written_at", None))


def drop_all(spark: SparkSession) -> None:
    """Removes every table that this process has written, once no result is to be read."""
    for path in list(_paths):
        remove(spark, path)


def remove(spark: SparkSession, path: str | None) -> None:
    if _paths.pop(path, 0) is None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Any path that Spark can read; nothing is opened by Python."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
