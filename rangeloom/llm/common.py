"""Shared helpers: the shared scratch folder, written tables, row sizes."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and tab to carriage return.
WS = "\\x20\\x09-\\x0D"


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and one machine is all there is, as in
    tests, a temporary folder; on a cluster that is an error, since no folder of one machine will do."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault("local", f"file://{tempfile.mkdtemp(prefix='rangeloom-')}")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's own part of the shared folder, which goes when Python ends."""
    session = f"{shared_dir(spark)}/rangeloom-{spark.sparkContext.applicationId}"
    if session not in _own:
        _own[session] = session
        atexit.register(delete, spark, session)
    return f"{session}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path with all in it, if that can be."""
    with contextlib.suppress(Exception):  # the JVM may have ended before
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read again, so that a lost executor costs one read."""
    spark = df.sparkSession
    path = scratch(spark, name)
    w = df.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def utf8(col: str = "text") -> Column:
    return text_or_empty(col).cast("binary")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts(spark: SparkSession, rows: int, most: int) -> int:
    """How many partitions: as many as Spark shuffles to, and more where one would get more than so many rows."""
    return max(1, parallelism(spark), -(-rows // most))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until the table has none like them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out
