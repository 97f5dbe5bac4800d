"""Written tables and folders that go when Python ends, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and one machine is all there is, a temporary folder, else the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _own.setdefault("local", f"file://{tempfile.mkdtemp(prefix='rangeloom-')}")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's own part of the shared folder, which goes when Python ends."""
    session = f"{shared_dir(spark)}/rangeloom-rest-{spark.sparkContext.applicationId}"
    if session not in _own:
        _own[session] = session
        atexit.register(_delete, spark, session)
    return f"{session}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write as Parquet and read again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
