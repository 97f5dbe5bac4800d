"""Contiguous balanced shards from global byte-size prefix sums.

Rows are put in doc_id order by a range partitioning that only carries doc_id, size and CRC. Each range partition
gives one total; the totals' prefix sums (a table of as many rows as there are partitions) shift the sums within the
partitions to global ones, and cutting the byte axis at equal targets assigns shards. No task sees more than its
range, and nothing but the totals meets in one place.

Defined results: a null text has 0 bytes, a null doc_id sorts first, rows that repeat a doc_id are ordered by CRC and
size and equal rows share their ranks out in any order; a document larger than a target leaves later shards smaller
or empty; an empty table gives no rows. Other columns are kept by `apply` and ignored by `assign`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, parts, scratch, text_or_empty, utf8, written

#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Most rows, about, of a range partition, and bytes of text, about, of a file.
RANGE_ROWS, FILE_BYTES = 1 << 20, 64 << 20


def assign(docs: DataFrame, shards: int = 40, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (in the shard), global_slot, start_byte."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty()) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(utf8()).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    n = parts(docs.sparkSession, rows.count(), RANGE_ROWS)
    dealt = written(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "shard-ranges")

    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as range partitions
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    within = Window.partitionBy("part").orderBy(*order)
    local = dealt.withColumn("local_end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("local_row", F.row_number().over(within) - 1)
    placed = local.join(offsets, "part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("rows_before") + F.col("local_row")).cast("long").alias("global_slot"),
        (F.col("bytes_before") + F.col("local_end") - F.col("size")).cast("long").alias("start_byte"),
        "all_bytes",
    )
    # a document belongs to the shard that holds its middle byte; decimals keep the product exact at any size
    middle = (F.col("start_byte") * 2 + F.col("size")).cast("decimal(38,0)") * shards
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / (F.col("all_bytes") * 2).cast("decimal(38,0)")).cast("int")))
    placed = written(placed, "shard-rows")
    firsts = placed.groupBy("shard").agg(F.min("global_slot").alias("first"))
    return placed.join(firsts, "shard").select("doc_id", "size", "text_crc32", F.col("shard").cast("int"), (F.col("global_slot") - F.col("first")).alias("slot"), "global_slot", "start_byte")


def apply(docs: DataFrame, shards: int = 40, path: str | None = None) -> DataFrame:
    """Write the documents as one folder per shard, and read them again with shard and slot. A shard is written by as many tasks as it
    has times `FILE_BYTES`, each a file of slots that follow each other, in order."""
    spark = docs.sparkSession
    path = path or scratch(spark, "shards")
    # equal rows are interchangeable: they are numbered alike on both sides
    i, crc, size, tie, no, shard, slot, piece = free_names(docs, "__id", "__crc", "__size", "__tie", "__no", "__shard", "__slot", "__piece")
    number = F.row_number().over(Window.partitionBy(i, crc, size).orderBy(tie))
    left = docs.withColumns({i: F.col("doc_id").cast("long"), crc: F.crc32(utf8()), size: (F.octet_length(text_or_empty()) + OVERHEAD).cast("long"), tie: F.monotonically_increasing_id()}).withColumn(no, number)
    assigned = written(assign(docs, shards), "assigned")
    right = assigned.select(F.col("doc_id").alias(i), F.col("text_crc32").alias(crc), F.col("size").alias(size), F.col("shard").alias(shard), F.col("slot").alias(slot), F.col("slot").alias(tie), F.floor(F.col("start_byte") / FILE_BYTES).alias(piece)).withColumn(no, number).drop(tie)
    on = [left[i].eqNullSafe(right[i])] + [left[c] == right[c] for c in (crc, size, no)]
    joined = left.join(right, on).select(*(left[c] for c in docs.columns), right[shard], right[slot], right[piece])
    total = assigned.agg(F.coalesce(F.max("start_byte"), F.lit(0))).first()[0]
    joined.repartition(shards + total // FILE_BYTES, shard, piece).sortWithinPartitions(shard, slot).drop(piece).write.mode("errorifexists").partitionBy(shard).parquet(path)
    return spark.read.parquet(path)
