"""The bins of stored rows as a table on disk: which rows of which file a bin holds.

    chrom, level, bin_id, file, first_row, past_row, n, first, past

A row for each bin of a file: places of its first row and past its last (other bins' rows may lie between), how many it has, and
their least start and greatest end. Files are sorted by start and a level's bins lie one after another, so the rows of any range of
bins of a level are one range of a file. The table is dealt out by ranges of (chrom, bin) and sorted, so a lookup's comparisons
prune its files and row groups; of the store itself only those files are opened, and those row groups read, in which the table has
a row that may overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.bins import Bins
from ..operators import layout

SCHEMA = "chrom string, level int, bin_id long, file string, first_row long, past_row long, n long, first long, past long"
_ORDER = ["chrom", "bin_id", "file"]
#: Reached files for a task, where there are many.
FILES = 16


def build(stored: DataFrame, bins: Bins) -> DataFrame:
    """The table of rows read from a store's files, dealt out and sorted. Rows past the scheme's range are an error."""
    rows = stored.select("chrom", "start", "end", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = rows.withColumn("bin_id", bins.bin_of(F.col("start"), F.col("end")))
    own = rows.groupBy("chrom", "bin_id", "file").agg(
        F.min("row").alias("first_row"), (F.max("row") + 1).alias("past_row"), F.count("*").alias("n"), F.min("start").alias("first"), F.max("end").alias("past")
    )
    return own.withColumn("level", bins.level_of(F.col("bin_id"))).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)


def reach(table: DataFrame, bins: Bins, chrom: str, start: int, end: int, bin_id: int | None = None) -> DataFrame:
    """file, spans: ranges of rows, one a level at most, outside which nothing overlaps. bin_id: of this bin alone."""
    lo, hi = max(start, 0), min(end, bins.limit) - 1
    ids = [(own + (lo >> sh), own + (hi >> sh)) for _, own, sh in bins.finest_first] if hi >= lo else []
    touched = F.lit(False)
    for a, b in ids if bin_id is None else [(bin_id, bin_id)]:
        touched = touched | F.col("bin_id").between(a, b)
    near = table.where((F.col("chrom") == chrom) & (F.col("first") < end) & (F.col("past") > start) & touched)
    of = lambda level, c: F.when(F.col("level") == level, F.col(c))
    spans = [F.struct(F.min(of(i, "first_row")).alias("first"), F.max(of(i, "past_row")).alias("past")) for i in range(bins.levels)]
    return near.groupBy("file").agg(F.filter(F.array(*spans), lambda s: s["first"].isNotNull()).alias("spans"))


def _rows(path: str, spans: list[tuple[int, int]], columns: list[str], start: int, end: int) -> Iterator[pa.RecordBatch]:
    """Of one file: the rows that overlap, from row groups that a span meets."""
    import pyarrow.parquet as pq

    with layout._open(path) as source:
        file = pq.ParquetFile(source)
        at = 0
        for g in range(file.num_row_groups):
            group = file.metadata.row_group(g)
            met = any(a < at + group.num_rows and b > at for a, b in spans)
            at += group.num_rows
            if met and layout.may_hold(group, file.schema_arrow.names, start, end):
                for rows in file.iter_batches(layout.BATCH, row_groups=[g], columns=columns):
                    s, e = (rows.column(c).to_numpy() for c in ("start", "end"))
                    found = (s < end) & (e > start)
                    if found.any():
                        yield rows.filter(pa.array(found))


def read(reached: DataFrame, n_files: int, schema: StructType, chrom: str, start: int, end: int) -> DataFrame:
    """The stored rows (schema) of a sequence that overlap, from the reached files. n_files: how many there are at most."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, stored = to_arrow_schema(schema), [f.name for f in schema.fields if f.name != "chrom"]
    # a row for each file, which stands for a file to read: dealt by a key of its own, or Spark takes the groups' few bytes for one task
    tasks = max(int(reached.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_files // FILES)
    dealt = reached.repartition(max(1, min(n_files, tasks)), F.xxhash64("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for rows in _rows(path, [(s["first"], s["past"]) for s in spans], stored, start, end):
                    columns = [pa.repeat(pa.scalar(chrom), rows.num_rows) if f.name == "chrom" else rows.column(f.name) for f in schema.fields]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(run, schema)
