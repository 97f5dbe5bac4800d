"""Tab-separated interval files: chrom, start, end, and the rest of the line as it is."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bgzf
from .ordered import numbered_lines

SCHEMA = "chrom string, start long, end long, rest string"


def _counts(line: Column, comment: str) -> Column:
    """Whether a line is neither blank nor a comment."""
    return (line != "") & ~line.startswith(comment) if comment else line != ""


def parse_lines(lines: DataFrame, comment: str = "#", one_based: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Lines (column value) to intervals. Blank and comment lines go; a line that is none fails the query. keep: further columns.

    start is 0-based; one_based input has it moved down by one, and a start below 1 is an error.
    """
    line = F.rtrim(F.col("value"), F.lit("\r"))
    kept = lines.where(_counts(line, comment))
    parts = F.split(line, "\t", 4)
    field = lambda i: F.get(parts, F.lit(i))
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), line))

    def number(i: int) -> Column:
        good = field(i).rlike("^[0-9]{1,18}$")
        return F.when(good, field(i).try_cast("long")).otherwise(fail("not an interval").cast("long"))

    start = number(1)
    if one_based:
        start = F.when(start < 1, fail("start below 1").cast("long")).otherwise(start - 1)
    end = number(2)
    end = F.when(end > start, end).otherwise(fail("end not above start").cast("long"))
    chrom = F.when(field(0) != "", field(0)).otherwise(fail("no sequence name"))
    return kept.select(chrom.alias("chrom"), start.alias("start"), end.alias("end"), F.coalesce(field(3), F.lit("")).alias("rest"), *keep)


def read_bed(spark: SparkSession, path: str | list[str], comment: str = "#", one_based: bool = False) -> DataFrame:
    """Plain or, by the name's ending, compressed files. Plain files are split among tasks, gzip files can't be."""
    return parse_lines(spark.read.text(path), comment, one_based)


def _opened(path: str):
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)
    return system.open_input_stream(unquote(at))


def read_bed_sniffed(spark: SparkSession, path: str | list[str], comment: str = "#", one_based: bool = False, split: int = bgzf.SPLIT) -> DataFrame:
    """As read_bed, for gzip files whatever their names: of each file the first bytes are looked at.

    Block gzip is split among tasks (`bgzf`). Of other gzip files those whose names say so, and plain files, are read as read_bed
    does; the rest is decompressed as it streams, some lines at a time.
    """

    def sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for p in b.column(0).to_pylist():
                with _opened(p) as f:
                    first = f.read(64)
                found.append("blocks" if bgzf.is_block_gzip(first) else "gzip" if first[:2] == b"\x1f\x8b" else "plain")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], names=["path", "length", "kind"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                with _opened(p) as f, io.TextIOWrapper(gzip.GzipFile(fileobj=f), "utf-8", "replace", newline="\n") as text:
                    while some := list(islice(text, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\n") for x in some])], names=["value"])

    # a row for each file, as its listing has, too
    files = spark.read.format("binaryFile").load(path).select("path", "length").mapInArrow(sniff, "path string, length long, kind string").collect()
    plain = [r.path for r in files if r.kind == "plain" or r.kind == "gzip" and r.path.endswith(".gz")]
    packed = [(r.path,) for r in files if r.kind == "gzip" and not r.path.endswith(".gz")]
    blocks = [(r.path, r.length) for r in files if r.kind == "blocks"]
    found = spark.read.text(plain) if plain else spark.createDataFrame([], "value string")
    if packed:
        found = found.union(spark.createDataFrame(packed, "path string").repartition(len(packed)).mapInArrow(lines, "value string"))
    if blocks:
        found = found.union(bgzf.read_lines(spark, spark.createDataFrame(blocks, "path string, length long"), split))
    return parse_lines(found, comment, one_based)


def read_regions(spark: SparkSession, path: str | list[str], comment: str = "#") -> DataFrame:
    """A file of regions (0-based, half-open; further columns are ignored): qid, chrom, qstart, qend. qid numbers the regions over all lines and files, in `ordered.file_order`."""
    lines = numbered_lines(spark, path, lambda value: _counts(F.rtrim(value, F.lit("\r")), comment))
    return parse_lines(lines, comment, keep=("line_no",)).select(F.col("line_no").alias("qid"), "chrom", F.col("start").alias("qstart"), F.col("end").alias("qend"))


def has_header(spark: SparkSession, path: str, expect: str) -> bool:
    """Whether the first line begins with the text."""
    first = spark.read.text(path).limit(1).first()
    return first is not None and first[0].startswith(expect)


# The sequences of random files.
CHROMS = ["chr1", "chr2", "chr3", "chr4", "chr5", "chrX", "chrY"]
#: Words for their further fields.
KINDS = ["alpha", "beta", "gamma", "delta", "theta", "lambda", "sigma", "omega"]


def random_bed(spark: SparkSession, n: int = 1_000_000, seed: int | None = None, partitions: int | None = None) -> DataFrame:
    """n random intervals, sorted: start below 1,000,000, length 100 to 9,999, up to five further fields of four kinds."""
    base = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    draw = iter(range(1, 1000))

    def below(most: int) -> Column:
        return F.floor(F.rand(None if seed is None else seed * 1000 + next(draw)) * most).cast("int")

    def pick(values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), below(len(values)) + 1)

    def field() -> Column:
        kind = below(4)
        number = below(1000).cast("string")
        pair = F.concat_ws("=", pick(KINDS), below(100).cast("string"))
        return F.when(kind == 0, pick(KINDS)).when(kind == 1, number).when(kind == 2, pick(["+", "-"])).otherwise(pair)

    rows = base.select(pick(CHROMS).alias("chrom"), below(1_000_000).cast("long").alias("start"), (below(9_900) + 100).cast("long").alias("__len"), below(6).alias("__k"), F.array(*(field() for _ in range(5))).alias("__f"))
    rest = F.array_join(F.slice("__f", F.lit(1), F.col("__k")), "\t")
    return rows.select("chrom", "start", (F.col("start") + F.col("__len")).alias("end"), rest.alias("rest")).orderBy("chrom", "start", "end")
