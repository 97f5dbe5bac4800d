"""The index as DataFrames: bins of features, and the linear index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import UnsortedFeaturesError
from ..functions.bins import DEFAULT, Bins, scheme
from ..scratch import written


def bin_index(features: DataFrame, bins: Bins | str = DEFAULT, start: str = "start", end: str = "end") -> DataFrame:
    """The features with level (0 coarsest) and bin_id."""
    bins = scheme(bins)
    out = features.withColumn("bin_id", bins.bin_of(F.col(start), F.col(end)))
    return out.withColumn("level", bins.level_of(F.col("bin_id")))


def sequence_index(features: DataFrame, chrom: str, bins: Bins | str = DEFAULT) -> DataFrame:
    """The index of one sequence; empty where there is none of that name."""
    return bin_index(features.where(F.col("chrom") == chrom), bins)


#: Log2 of how many windows, or blocks of windows, make a block of the next level.
_BLOCK = 6


def _blocks(first: Column, last: Column, levels: int, level: int = 0) -> list[Column]:
    """Windows first to last as few blocks: arrays of (level, number). A block of a level is 2**_BLOCK of the level below."""
    listed = lambda a, b: F.when(b >= a, F.transform(F.sequence(a, b), lambda x: F.struct(F.lit(level).alias("level"), x.alias("no")))).otherwise(F.array().cast("array<struct<level:int,no:bigint>>"))
    if level + 1 == levels:
        return [listed(first, last)]
    a, b = F.shiftright(first + ((1 << _BLOCK) - 1), _BLOCK), F.shiftright(last + 1, _BLOCK)  # whole blocks: a to b - 1
    whole = b > a
    # what stands before and after the whole blocks; without any, all of it
    before = listed(first, F.when(whole, F.shiftleft(a, _BLOCK) - 1).otherwise(last))
    after = listed(F.when(whole, F.shiftleft(b, _BLOCK)).otherwise(last + 1), last)
    return [before, after, *_blocks(a, b - 1, levels, level + 1)]


def linear_index(features: DataFrame, bins: Bins | str = DEFAULT, order: str = "ord", start: str = "start", end: str = "end") -> DataFrame:
    """chrom, win, min_ord: the first feature, by order, that touches each window.

    A feature gives at most 2**7 rows for each level of blocks, however long it is; blocks are reduced to one row each before
    they are opened to those of the level below, so long features that lie over each other aren't listed window by window.
    """
    shift = scheme(bins).linear_shift
    if shift is None:
        raise ValueError("this bin scheme has no linear index")
    first, last = F.shiftright(F.col(start).cast("long"), shift), F.shiftright(F.col(end).cast("long") - 1, shift)
    longest = features.agg(F.max(last - first + 1)).first()[0] or 1
    levels = 1
    while longest >> _BLOCK * levels:
        levels += 1
    wins = F.concat(*_blocks(F.col("__a"), F.col("__b"), levels))
    rows = features.select("chrom", F.col(order).alias("__o"), first.alias("__a"), last.alias("__b")).select("chrom", "__o", F.explode(wins).alias("w"))
    own = rows.groupBy("chrom", "w.level", "w.no").agg(F.min("__o").alias("min_ord"))
    found = own.where(F.col("level") == levels - 1).select("chrom", "no", "min_ord")
    for level in reversed(range(levels - 1)):
        opened = found.select("chrom", F.explode(F.sequence(F.shiftleft("no", _BLOCK), F.shiftleft("no", _BLOCK) + ((1 << _BLOCK) - 1))).alias("no"), "min_ord")
        found = own.where(F.col("level") == level).select("chrom", "no", "min_ord").union(opened).groupBy("chrom", "no").agg(F.min("min_ord").alias("min_ord"))
    return found.withColumnRenamed("no", "win")


def linear_lookup(regions: DataFrame, linear: DataFrame, bins: Bins | str = DEFAULT) -> DataFrame:
    """Each region with min_ord of the window in which it starts (null: no feature touches that window)."""
    shift = scheme(bins).linear_shift
    return regions.withColumn("win", F.shiftright(F.col("qstart"), shift)).join(linear, ["chrom", "win"], "left").drop("win")


#: Log2 of how many windows' bounds are found together.
_BOUND_BLOCK = 16


def linear_bounds(features: DataFrame, bins: Bins | str = DEFAULT, order: str = "ord", start: str = "start", end: str = "end") -> DataFrame:
    """chrom, first_win, win, bound: for a region that starts in a window from first_win to win no feature before the bound, by order, overlaps it.

    The bound is the least order of all features that end in the window or a later one, so it loses no row, whatever windows are empty
    and however features are ordered; where they are ordered by start it skips those that end long before. No row covers the windows
    after the last in which a feature ends. Suffix minima run within blocks of windows, and over the blocks' minima.
    """
    shift = scheme(bins).linear_shift
    if shift is None:
        raise ValueError("this bin scheme has no linear index")
    last = F.shiftright(F.col(end).cast("long") - 1, shift)
    own = features.where(F.col("chrom").isNotNull()).select("chrom", last.alias("win"), F.col(order).alias("o")).where("win IS NOT NULL").groupBy("chrom", "win").agg(F.min("o").alias("o"))
    own = own.withColumn("block", F.shiftright("win", _BOUND_BLOCK))
    after = Window.partitionBy("chrom").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("chrom", "block").agg(F.min("o").alias("o"), F.max("win").alias("ends"))
    before = Window.partitionBy("chrom").orderBy("block")
    blocks = blocks.select("chrom", "block", F.min("o").over(after).alias("later"), F.lag("ends").over(before).alias("ended"))
    within = Window.partitionBy("chrom", "block").orderBy(F.desc("win")).rowsBetween(Window.unboundedPreceding, 0)
    previous = F.lag("win").over(Window.partitionBy("chrom", "block").orderBy("win"))
    found = own.withColumns({"least": F.min("o").over(within), "previous": previous}).join(blocks, ["chrom", "block"])
    return found.select("chrom", (F.coalesce("previous", "ended") + 1).alias("first_win"), "win", F.least("least", "later").alias("bound"))


def linear_bound_lookup(regions: DataFrame, bounds: DataFrame, bins: Bins | str = DEFAULT, start: str = "qstart") -> DataFrame:
    """Each region with the bound of the window in which it starts; null where no feature ends there or later. Regions need names (qid)."""
    from .overlap import overlap_left

    shift = scheme(bins).linear_shift
    # a bound's windows as an interval, the region's window as another
    spans = bounds.select("chrom", F.coalesce("first_win", F.least(F.col("win"), F.lit(-(1 << 50)))).alias("start"), (F.col("win") + 1).alias("end"), "bound")
    own = F.shiftright(F.col(start).cast("long"), shift)
    asked = regions.withColumns({"__win": own, "__past": own + 1})
    found = overlap_left(spans, asked, region_start="__win", region_end="__past")
    return found.drop("__win", "__past", "start", "end", "region_start", "region_end")


def bounded_lookup(features: DataFrame, bounds: DataFrame, chrom: str, qstart: int, qend: int, bins: Bins | str = DEFAULT, order: str = "ord", start: str = "start", end: str = "end") -> DataFrame:
    """The features that overlap one interval, read from the bound on: a comparison of the order that reaches the scan."""
    from .overlap import lookup

    win = qstart >> scheme(bins).linear_shift
    row = bounds.where((F.col("chrom") == chrom) & (F.col("win") >= win)).orderBy("win").select("bound").first()
    found = lookup(features, chrom, qstart, qend, start=start, end=end)
    return found.where(F.col(order) >= row.bound) if row else found.limit(0)


#: About how many features are looked at together.
ORDERED = 1 << 20


def unsorted(features: DataFrame, order: str = "ord", start: str = "start") -> DataFrame:
    """The features that start before the one before them in their sequence, with that one's start as previous.

    Features of one order come by their starts, so that they are not held to be out of order among themselves and every run says
    the same. Features are dealt out by ranges of (chrom, order) and written, so that a sequence is many
    tasks'; a range's first feature of a sequence is held against the last start of that sequence in the nearest range before that
    has one, from a table of a row for each range and sequence in it.
    """
    part, last, lag, c, p = ("__" + x * 3 for x in ("part", "last", "lag", "chrom", "at"))
    n = max(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), features.count() // ORDERED + 1)
    rows = written(features.repartitionByRange(n, "chrom", order).withColumn(part, F.spark_partition_id()), "ordered")
    lasts = rows.groupBy("chrom", part).agg(F.max_by(F.struct(F.col(start).alias("s")), F.struct(F.col(order), F.col(start))).alias(last))
    lasts = lasts.select(F.col("chrom").alias(c), F.col(part).alias(p), F.lag(last).over(Window.partitionBy("chrom").orderBy(part)).alias(last))
    rows = rows.withColumn(lag, F.lag(F.struct(F.col(start).alias("s"))).over(Window.partitionBy("chrom", part).orderBy(order, start)))
    rows = rows.join(lasts, F.col("chrom").eqNullSafe(F.col(c)) & (F.col(part) == F.col(p)))
    previous = F.coalesce(lag, last)["s"].alias("previous")
    return rows.select(*features.columns, previous).where(F.col("previous") > F.col(start))


def check_sorted(features: DataFrame, order: str = "ord", start: str = "start") -> None:
    """Raise where features are out of order. Nothing here needs sorted input; this is for callers that do."""
    row = unsorted(features, order, start).select("chrom", "previous", start).first()
    if row:
        raise UnsortedFeaturesError(f"{row[0]}: a feature at {row[2]} follows one at {row[1]}")
