"""Intervals as tab-separated text."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bgzf


def line() -> Column:
    """chrom, start, end, rest by tabs; the tab before an empty rest stays."""
    return F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce("rest", F.lit("")))


def display() -> Column:
    """start, end and, if there is one, rest by tabs."""
    bare = F.concat_ws("\t", F.col("start").cast("string"), F.col("end").cast("string"))
    return F.when(F.coalesce("rest", F.lit("")) == "", bare).otherwise(F.concat_ws("\t", bare, "rest"))


def write_tsv(rows: DataFrame, path: str, mode: str = "errorifexists", ordered: bool = False) -> None:
    """A folder of text files, gzip if the path ends in .gz, block gzip if in .bgz. ordered: by chrom, start, end over all files."""
    if ordered:
        rows = rows.orderBy("chrom", "start", "end")
    if path.endswith(".bgz"):
        return bgzf.write_lines(rows.select(line().alias("value")), path, mode=mode)
    writer = rows.select(line().alias("value")).write.mode(mode)
    (writer.option("compression", "gzip") if path.endswith(".gz") else writer).text(path)


def print_tsv(rows: DataFrame, to: TextIO | None = None) -> int:
    """Lines to a stream (standard output if none is given), a partition at a time; returns how many."""
    n, to = 0, to or sys.stdout
    for r in rows.select(line().alias("value")).toLocalIterator():
        to.write(r.value + "\n")
        n += 1
    return n
