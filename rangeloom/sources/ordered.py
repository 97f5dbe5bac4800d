"""Lines with their number over all files of a path, in the order in which an ordered sink wrote them.

Spark names a task's file by the task's number, so that the files of a total sort, in the order of those numbers, hold its rows in
order. Lines are counted by split where they are read; a split's first number is a prefix sum over one row for each split (of
`spark.sql.files.maxPartitionBytes`), and a line's place in its split is the scan's own. Lines are neither shuffled nor sorted, and
a file of any length is several tasks'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import written


def file_order(path: Column) -> list[Column]:
    """By folder, number of the part that a task wrote, number of its file, and name; files that no task named come first."""
    name = F.substring_index(path, "/", -1)
    number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(-1).cast("long"))
    return [F.regexp_replace(path, "[^/]*$", ""), number(r"^part-(\d+)"), number(r"-c(\d+)"), name]


def numbered_lines(spark: SparkSession, path: str | list[str], kept: Callable[[Column], Column] | None = None) -> DataFrame:
    """line_no (from 0, gapless), value. kept: which lines count; others go. An empty folder has none.

    Files come in `file_order`, whatever the order of several paths. Reads the lines twice: to count them, and when they are used.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    if kept is not None:
        lines = lines.where(kept(F.col("value")))
    lines = lines.withColumn("place", F.monotonically_increasing_id())
    splits = written(lines.groupBy("file", "at").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("n")), "splits")
    before = Window.orderBy(*file_order(F.col("file")), "at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    firsts = splits.select("file", "at", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    return lines.join(firsts, ["file", "at"]).select((F.col("place") + F.col("shift")).alias("line_no"), "value")
