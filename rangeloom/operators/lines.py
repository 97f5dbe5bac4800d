"""What regions find, with the place of each pair in the regions' order, without a sort of the pairs.

Rows are written once more in the order of an index walk: files of one sequence and one level of bins, sorted by start, end and the
further columns. A piece is some rows of a file. A region's pairs come piece by piece, and inside of a piece in its rows' order; how many
there are is a difference of two binary searches, over the starts and over the ends. So a prefix sum over one row for each region and
piece that it reaches, in the order of the regions' keys and of the pieces, gives the number of the first pair there. With that the
regions go to the pieces again, tasks give each row with the numbers of its pairs with some regions, and Spark makes the pairs. No more
than rows, regions and their pieces is shuffled, however many pairs there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, LongType, StructField, StructType

from ..functions.bins import Bins
from ..scratch import folder, written
from . import layout, overlap

#: Most rows of a piece; rows and regions that are looked at together.
PIECE, STRIP, ONES = 1 << 14, 1 << 11, 1 << 7


def _walk(rows: DataFrame, bins: Bins) -> tuple[DataFrame, int]:
    """The rows in the order of an index walk, as files with `layout.reached`'s columns and their number in that order."""
    level, spark = overlap._free(rows.columns, "__level"), rows.sparkSession
    ties = [f"`{f.name}`" for f in rows.schema.fields if isinstance(f.dataType, AtomicType) and f.name not in ("chrom", "start", "end")]
    order, at = ["chrom", level, "start", "end", *ties], folder(spark, "walk")
    leveled = rows.withColumn(level, bins.level_of(bins.bin_of(F.col("start"), F.col("end"))))
    leveled.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("chrom", level).parquet(at)
    found = spark.read.schema(leveled.schema).parquet(at).select("chrom", F.col(level).alias("level"), "start", "end", F.col("_metadata.file_path").alias("file"))
    files = found.groupBy("file", F.col("chrom").alias("seq"), "level").agg(F.min("start").alias("first"), F.max("end").alias("past"))
    part = F.regexp_extract(F.substring_index("file", "/", -1), r"^part-(\d+)", 1).cast("long")  # a total sort's tasks are numbered in its order
    no = F.row_number().over(Window.orderBy(F.col("level").desc(), part, "file"))  # a row for each file
    files = written(files.select("file", "seq", "first", "past", F.array(F.struct("first", "past")).alias("classes"), no.alias("no")), "walked")
    return files, files.count()


def _pieces(path: str, columns: list[str], wanted) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The place of a piece's first row in its file, its rows, their starts and ends. wanted: whether a row group's places and metadata are."""
    import pyarrow.parquet as pq

    with layout._open(path) as source:
        file, at = pq.ParquetFile(source), 0
        for g in range(file.num_row_groups):
            group, place = file.metadata.row_group(g), at
            at += group.num_rows
            if wanted(place, at, group, file.schema_arrow.names):
                for rows in file.iter_batches(PIECE, row_groups=[g], columns=columns):
                    if rows.num_rows:
                        yield place, rows, rows.column("start").to_numpy(), rows.column("end").to_numpy()
                    place += rows.num_rows


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Neighbours of one file (column 0), at most about `most` at a time."""
    path, held, size = None, [], 0
    for b in batches:
        names = b.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                if held and (names[lo] != path or size >= most):
                    yield path, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size = [], 0
                path = names[lo]
                held.append(b.slice(lo, hi - lo))
                size += hi - lo
    if held:
        yield path, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _numbers(counted: DataFrame, order: list[str]) -> DataFrame:
    """The rows with `base`, the sum of n over those before in the order: sums by ranges, and inside of each a window."""
    held = written(counted.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "counted")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = held.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carried"))
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = held.withColumn("base", F.coalesce(F.sum("n").over(own), F.lit(0)))
    return sums.join(F.broadcast(carried), "part").withColumn("base", F.col("base") + F.col("carried")).drop("part", "carried")


def placed(found: DataFrame) -> DataFrame:
    """line_no and the columns of rows that are in a total order: places in a task, and sums over the tasks."""
    place = overlap._free(found.columns, "__place")
    held = written(found.withColumn(place, F.monotonically_increasing_id()), "placed")
    part, number = F.shiftright(place, 33), F.col(place).bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    carried = held.groupBy(part.alias("part")).count().select(F.col("part").alias(f"{place}_part"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(f"{place}_carried"))
    return held.join(F.broadcast(carried), part == F.col(f"{place}_part")).select((number + F.col(f"{place}_carried")).alias("line_no"), *(F.col(f"`{c}`") for c in found.columns))


def numbered(rows: DataFrame, bins: Bins, regions: DataFrame, chrom: str, start: str, end: str, key: str) -> DataFrame:
    """line_no (from 0, gapless) and the rows' columns, for each overlapping pair, in the order of the regions' keys and an index walk.

    No key is two regions'. regions: checked, with the columns chrom, start, end and key.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    files, n_files = _walk(rows, bins)
    asked = regions.select(F.col(chrom).alias("__c"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.col(key).alias("key"))
    found = layout.reached(files, n_files, asked, "__c", "s", "e").drop("__c").join(files.select("file", "no"), "file").select("file", "no", "s", "e", "key")
    dealt = overlap._by_place(found, max(1, math.ceil(found.count() / layout.DEALT)), "file", "s")
    fields = [f for f in rows.schema.fields if f.name != "chrom"]
    stored, types = [f.name for f in fields], StructType([*found.schema.fields, StructField("piece", LongType()), StructField("n", LongType())])
    arrow = to_arrow_schema(types)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, own in _groups(batches, layout.HELD):
            qs, qe = own.column(2).to_numpy(), own.column(3).to_numpy()
            for place, _, s, e in _pieces(path, stored, lambda a, b, group, names, qs=qs, qe=qe: layout.may_hold(group, names, qs, qe)):
                n = np.searchsorted(s, qe, "left") - np.searchsorted(np.sort(e), qs, "right")
                if len(hit := np.flatnonzero(n > 0)):
                    some = own.take(pa.array(hit))
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*some.columns, pa.array(np.full(len(hit), place)), pa.array(n[hit])], arrow, strict=True)], schema=arrow)

    based = _numbers(dealt.mapInArrow(count, types), ["key", "no", "piece"]).join(files.select("file", "seq"), "file")
    based = written(based.select("file", "piece", "s", "e", "base", "seq"), "based")
    again = based.repartitionByRange(max(1, math.ceil(based.count() / layout.DEALT)), "file", "piece", "s", "base").sortWithinPartitions("file", "piece", "s")
    made = StructType([rows.schema["chrom"], *fields, StructField("__lines", ArrayType(LongType(), False), False)])
    packed = to_arrow_schema(made)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, own in _groups(batches, layout.HELD):
            pieces, qs, qe, base = (own.column(i).to_numpy() for i in range(1, 5))
            for place, rows, s, e in _pieces(path, stored, lambda a, b, *_, pieces=pieces: np.searchsorted(pieces, b) > np.searchsorted(pieces, a)):
                lo, hi = np.searchsorted(pieces, place, "left"), np.searchsorted(pieces, place, "right")
                for i in range(lo, hi, ONES):
                    at = slice(i, min(i + ONES, hi))
                    for hit, n, numbers in _placed(s, e, qs[at], qe[at], base[at]):
                        some = rows.take(pa.array(hit))
                        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(numbers))
                        columns = [pa.repeat(own.column(5)[i], len(hit)), *(some.column(c) for c in stored), lists]
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, packed, strict=True)], schema=packed)

    # no list is empty, and an outer generator isn't filtered by sizes before
    return again.mapInArrow(number, made).select(F.explode_outer("__lines").alias("line_no"), *(F.col(f"`{c}`") for c in rows.columns))


def _placed(s: np.ndarray, e: np.ndarray, qs: np.ndarray, qe: np.ndarray, base: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of rows (sorted by start) that overlap, with how many of the regions, and these pairs' numbers row by row: base is the first of each region."""
    at = base.copy()
    first, past = np.searchsorted(s, qs.min() - (e - s).max(), "right"), np.searchsorted(s, qe.max(), "left")
    for lo in range(first, past, STRIP):
        hi = min(lo + STRIP, past)
        hits = (s[lo:hi, None] < qe) & (e[lo:hi, None] > qs)
        n = hits.sum(1)
        if n.any():
            yield lo + np.flatnonzero(n), n[n > 0], (np.cumsum(hits, 0, dtype=np.int64) + (at - 1))[hits]
            at += hits.sum(0)
