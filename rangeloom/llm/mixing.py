"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a hash and laid end to end; that stream of words is cut into equal blocks.
Slot i of the mix maps the golden-ratio point frac(i * phi) through the sources' cumulative shares to a source; the
slot's rank among that source's slots says which block it takes, pass after pass over the source. Joining slots to
blocks and blocks to documents gives the words that the mix takes of each document.

Ranks and stream positions have three levels: counts per chunk, prefix sums over groups of chunks and within each group,
then ranks within a chunk. So a source with a third of all rows is never one task's, nor is the table of its chunks: a task
holds a row for each group of a source, or for each chunk of a group. All of it is DataFrame functions.

Targets share all words by weight; none exceeds 3 times its source's words, and what a capped source leaves is shared
by the others by weight. With the sources ordered by cap over weight this is one running sum: sources are capped
up to the first whose cap over weight exceeds (words left) / (weight left).

Defined results: a null text has no words; a null source is a source of its own, last in order; documents without
words and sources without words take nothing; rows that repeat a doc_id are documents of their own; an empty table
gives none. Other columns are kept by `apply` and ignored by `mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, parts, text_or_empty, written

#: No document is taken more often than this.
MOST = 3
#: round(2**31 / phi): multiples of it modulo 2**31 are golden-ratio points in whole numbers.
GOLDEN, MODULUS = 1_327_217_885, 1 << 31
#: Words of a block, whatever the corpus.
BLOCK = 64
#: Slots of a chunk, and documents of one, about.
CHUNK, DOC_CHUNK = 1 << 15, 1 << 12
#: Chunks of a group.
GROUP = 1 << 12


def words(col: str = "text"):
    """Number of runs of [^\\x20\\x09-\\x0D]."""
    spaced = F.translate(text_or_empty(col), "\t\n\x0b\x0c\r", "     ")
    trimmed = F.trim(spaced)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " +"))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """From source, source_size (a row for each source): with weight and target."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long")).withColumn("cap", (F.col("source_size") * MOST).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # what a unit of weight gets if all sources before this one are capped; the first not capped settles it
    s = s.withColumn("unit", left / weight_left).withColumn("free", F.col("cap") > F.col("unit") * F.col("weight"))
    level = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("unit").alias("u")))).over(everything)["u"]
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap")))
    return s.select("source", "source_size", "weight", "target")


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and row_no, source."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size")
    )
    return _mix(written(rows, "mix-sizes"))


def _mix(rows: DataFrame) -> DataFrame:
    # sources get numbers by name; their table has a row for each source and is written, so that its size is known
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    s = targets(sizes).join(sizes.select(F.col("source").alias("__s"), "n"), _same("source", "__s")).drop("__s")
    s = s.withColumn("sid", (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1).cast("long"))
    s = s.withColumn("block", F.lit(BLOCK).cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    # a source's last block may be short: slots in proportion to target / (words of a mean block)
    s = s.withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0)))
    total = F.sum("slots").over(Window.partitionBy())
    upto = F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("hi", F.when(total > 0, F.when(upto >= total * (1 - 1e-12), F.lit(1.0)).otherwise(upto / total)).otherwise(F.lit(0.0))).withColumn("all_slots", F.round(F.coalesce(total, F.lit(0.0))).cast("long"))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0)))
    s = written(s, "mix-sources")

    takes = schedule(s).groupBy("sid", "block_no").agg(F.count(F.lit(1)).alias("takes"))
    pieces = blocks_of(stream(rows, s), s)
    got = pieces.join(takes, ["sid", "block_no"]).groupBy("row_no").agg(F.sum(F.col("takes") * F.col("overlap")).alias("taken"))
    head = s.select(F.col("source").alias("__s"), "source_size", "target")
    return (
        rows.join(head, _same("source", "__s"))
        .join(got, "row_no", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "row_no", "source")
    )


def _firsts(chunks: DataFrame, value: str) -> DataFrame:
    """sid, chunk, first: the sum over a source's chunks before this one."""
    chunks = written(chunks.withColumn("group", F.floor(F.col("chunk") / GROUP)), "mix-chunks")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = chunks.groupBy("sid", "group").agg(F.sum(value).alias("of_group"))
    heads = groups.select("sid", "group", F.coalesce(F.sum("of_group").over(before("sid").orderBy("group")), F.lit(0)).alias("head"))
    own = chunks.withColumn("in_group", F.coalesce(F.sum(value).over(before("sid", "group").orderBy("chunk")), F.lit(0)))
    return own.join(heads, ["sid", "group"]).select("sid", "chunk", (F.col("head") + F.col("in_group")).alias("first"))


def schedule(s: DataFrame) -> DataFrame:
    """The mix in order: slot, sid, rank (among the source's slots), block_no."""
    spark = s.sparkSession
    n = int(s.agg(F.coalesce(F.max("all_slots"), F.lit(0))).first()[0])  # one number
    chunks = max(1, n // CHUNK)
    slots = spark.range(0, n, 1, min(parts(spark, n, 1 << 20), chunks)).select(F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    point = ((F.col("slot") % MODULUS) * GOLDEN) % MODULUS / F.lit(float(MODULUS))
    # each slot meets the one source whose share holds its point: shares are dealt to cells of the unit interval
    cells = 1 << 10
    slots = slots.withColumn("point", point).withColumn("cell", F.floor(F.col("point") * cells).cast("int"))
    shares = s.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells).cast("int"), F.least(F.lit(cells - 1), F.floor(F.col("hi") * cells).cast("int")))))
    at = slots.join(shares.select("cell", "lo", "hi", "sid", "blocks"), "cell").where("point >= lo AND point < hi")
    at = at.select("slot", "chunk", "sid", "blocks")
    firsts = _firsts(at.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n")), "n")
    within = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = at.withColumn("in_chunk", within).join(firsts, ["sid", "chunk"]).withColumn("rank", F.col("first") + F.col("in_chunk"))
    # points may give a source at its cap a slot too many
    return ranked.where(F.col("rank") < F.col("blocks") * MOST).select("slot", "sid", "rank", (F.col("rank") % F.col("blocks")).alias("block_no"))


def stream(rows: DataFrame, s: DataFrame) -> DataFrame:
    """The shuffled sources: row_no, sid, size, start (in the source's stream)."""
    number = s.select(F.col("source").alias("__s"), "sid", "n", "block")
    order = F.md5(F.concat_ws(":", F.lit("mix"), F.col("doc_id")).cast("binary"))
    r = rows.where("size > 0").join(number, _same("source", "__s")).withColumn("h", order)
    # chunks of a source: by the hash's first 32 bits, as many as its rows ask for
    first = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    r = r.withColumn("chunk", F.floor(first * (F.floor(F.col("n") / DOC_CHUNK) + 1) / F.lit(4294967296.0)))
    firsts = _firsts(r.groupBy("sid", "chunk").agg(F.sum("size").alias("words")), "words")
    upto = F.sum("size").over(Window.partitionBy("sid", "chunk").orderBy("h", "doc_id", "size", "row_no").rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("end", upto).join(firsts, ["sid", "chunk"])
    return r.select("row_no", "sid", "size", "block", (F.col("first") + F.col("end") - F.col("size")).alias("start"))


def blocks_of(r: DataFrame, s: DataFrame) -> DataFrame:
    """Every block that a document touches: row_no, sid, block_no, overlap (words)."""
    end = F.col("start") + F.col("size")
    numbers = F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((end - 1) / F.col("block")))
    r = r.withColumn("block_no", F.explode(numbers))
    overlap = F.least(end, (F.col("block_no") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("block_no") * F.col("block"))
    return r.select("row_no", "sid", "block_no", overlap.alias("overlap"))


def apply(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken (to the nearest whole), with all their columns."""
    row, size, times, copy = free_names(docs, "__row", "__size", "__times", "__copy")
    sized = written(docs.withColumns({row: F.monotonically_increasing_id(), size: words()}), "mix-docs")
    rows = sized.select(F.col(row).alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(size).alias("size"))
    n = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = _mix(rows).where("taken > 0").select(F.col("row_no").alias(row), n.alias(times)).where(F.col(times) > 0)
    return sized.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
