"""Figures of overlaps without the pairs: prefix sums over positions.

Of half-open intervals, those that overlap [a, b) are those that begin before b less those that end at or before a; the bases that
they have in common with it are a difference of the same kind. So a row needs no more than running sums over the intervals' ends
(marks) at its own two ends. Positions are dealt out by tiles of 2**`TILE`; what lies before a tile comes from prefix sums over the
tiles' totals, and a window runs over the marks and rows inside. The work is a sort of both sides, however many pairs there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Log2 of a tile's positions.
TILE = 14
#: At one position ends come first, then rows that ask, then starts: intervals that only touch do not overlap.
_CARRIED, _END, _ASKED, _START = -1, 0, 1, 2


def _figures(*names: str) -> dict[str, Column]:
    """Sums over marks: intervals that began, that ended, and (spanned) their ends less their starts."""
    mark = lambda end, start: F.when(F.col("rank") == _END, end).when(F.col("rank") == _START, start).otherwise(F.lit(0))
    every = {"began": mark(F.lit(0), F.lit(1)).cast("long"), "ended": mark(F.lit(1), F.lit(0)).cast("long"), "spanned": mark(F.col("at"), -F.col("at")).cast("decimal(20,0)")}
    return {name: every[name] for name in names}


def marks(intervals: DataFrame, chrom: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """chrom, at, rank of the starts and ends, or of one of them."""
    ends = [F.struct(F.col(c).cast("long").alias("at"), F.lit(rank).alias("rank")) for c, rank in ((start, _START), (end, _END)) if c]
    return intervals.select(F.col(chrom).alias("chrom"), F.explode(F.array(*ends)).alias("m")).select("chrom", "m.*")


def running(marks: DataFrame, rows: DataFrame, chrom: Column, at: Column, figures: dict[str, Column], over: Callable[[Column], Column] = F.sum) -> DataFrame:
    """The rows, as struct row, with sums of the figures over the marks of their sequence before `at`, and the ends that lie there. over: other than sums."""
    asked = rows.select(chrom.alias("chrom"), at.cast("long").alias("at"), F.lit(_ASKED).alias("rank"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    every = marks.withColumn("row", F.lit(None).cast(asked.schema["row"].dataType)).unionByName(asked, allowMissingColumns=True)
    every = every.withColumn("tile", F.shiftright("at", TILE))
    totals = every.groupBy("chrom", "tile").agg(*(over(c).alias(name) for name, c in figures.items()))
    before = Window.partitionBy("chrom").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("chrom", "tile", F.lit(_CARRIED).alias("rank"), F.struct(*(over(F.col(name)).over(before).alias(name) for name in figures)).alias("carried"))
    own = Window.partitionBy("tile", "chrom").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = (over(F.coalesce(F.col(f"carried.{name}"), c)).over(own).alias(name) for name, c in figures.items())
    # a tile's carried row has no position, and so comes first
    return every.unionByName(carried, allowMissingColumns=True).select("row", *sums).where("row IS NOT NULL")


def summed(intervals: DataFrame, rows: DataFrame, keys: list[str], bounds: tuple[str, str, str], own: tuple[str, str, str], bases: bool = False) -> DataFrame:
    """n, the intervals that overlap rows of equal keys, and (bases) the bases they have in common. bounds, own: chrom, start and end of both, none null."""
    chrom, start, end = own
    side = lambda c, sign: F.struct(F.col(f"`{c}`").cast("long").alias("x"), F.lit(sign).alias("sign"))
    asked = rows.select(*(F.col(f"`{c}`") for c in keys), F.col(f"`{chrom}`").alias("__chrom"), F.explode(F.array(side(start, -1), side(end, 1))).alias("__side"))
    figures = _figures("began", "ended", *(["spanned"] if bases else []))
    found = running(marks(intervals, *bounds), asked, F.col("__chrom"), F.col("__side.x"), figures)
    at, sign = F.col("row.__side.x"), F.col("row.__side.sign")
    out = [F.sum(F.when(sign > 0, F.col("began")).otherwise(-F.col("ended"))).alias("n")]
    if bases:  # of what began before x, the bases before x
        past = at.cast("decimal(20,0)") * (F.col("began") - F.col("ended")).cast("decimal(18,0)") + F.col("spanned")
        out.append(F.sum(past.cast("decimal(38,0)") * sign.cast("decimal(1,0)")).cast("long").alias("bases"))
    return found.groupBy(*(F.col(f"row.`{c}`").alias(c) for c in keys)).agg(*out)


def counted(intervals: DataFrame, rows: DataFrame, bounds: tuple[str, str, str], own: tuple[str, str, str]) -> DataFrame:
    """Each row, as struct row, with n, the intervals that overlap it. bounds, own: chrom, start and end of both, none null."""
    chrom, start, end = own
    qchrom, qstart, qend = bounds
    first = running(marks(intervals, qchrom, qstart), rows, F.col(f"`{chrom}`"), F.col(f"`{end}`"), _figures("began"))
    second = running(marks(intervals, qchrom, None, qend), first, F.col(f"row.`{chrom}`"), F.col(f"row.`{start}`"), _figures("ended"))
    return second.select(F.col("row.row").alias("row"), (F.col("row.began") - F.col("ended")).alias("n"))


def alone(intervals: DataFrame, rows: DataFrame, bounds: tuple[str, str, str], own: tuple[str, str, str]) -> DataFrame:
    """The rows that no interval overlaps: of those that begin before a row's end none ends after its start. So one greatest end
    before a position does, and the rows are dealt out once. bounds, own: chrom, start and end of both, none null."""
    (chrom, start, end), (qchrom, qstart, qend) = own, bounds
    begun = intervals.select(F.col(f"`{qchrom}`").alias("chrom"), F.col(f"`{qstart}`").cast("long").alias("at"), F.lit(_START).alias("rank"), F.col(f"`{qend}`").cast("long").alias("past"))
    found = running(begun, rows, F.col(f"`{chrom}`"), F.col(f"`{end}`"), {"past": F.col("past")}, F.max)
    return found.where(F.coalesce(F.col("past") <= F.col(f"row.`{start}`"), F.lit(True))).select("row.*")


def repeated(counted: DataFrame, run: int = 4096) -> DataFrame:
    """The rows of `counted`, each n times, made some at a time."""
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(run).cast("long")))
    some = counted.where(F.col("n") > 0).select("row", "n", runs.alias("from"))
    one = F.explode(F.array_repeat(F.lit(True), F.least(F.col("n") - F.col("from"), F.lit(run)).cast("int")))
    return some.select("row.*", one.alias("__one")).drop("__one")
