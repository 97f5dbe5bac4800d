"""Index statistics, as DataFrames; the text report formats one row of them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bins import DEFAULT, Bins, scheme
from .index import bin_index


def bin_occupancy(features: DataFrame, bins: Bins | str = DEFAULT, **names) -> DataFrame:
    """chrom, level, bin_id, n."""
    return bin_index(features, bins, **names).groupBy("chrom", "level", "bin_id").agg(F.count(F.lit(1)).alias("n"))


def level_stats(features: DataFrame, bins: Bins | str = DEFAULT, **names) -> DataFrame:
    """A row for each level in use: bins over all sequences; utilization is of one sequence's bins times the sequences."""
    return levels_of(bin_occupancy(features, bins, **names), bins)


def levels_of(occupied: DataFrame, bins: Bins | str = DEFAULT) -> DataFrame:
    """level_stats from counts by bin (chrom, level, bin_id, n), which are gone through once."""
    bins = scheme(bins)
    total = F.element_at(F.array(*(F.lit(n).cast("long") for n in bins.sizes)), F.col("level") + 1)
    per_chrom = occupied.groupBy("chrom", "level").agg(F.count(F.lit(1)).alias("bins_used"), F.sum("n").alias("features_count"), F.max("n").alias("most"))
    # a sequence counts at its first level, so that the levels' counts add up to the sequences
    first = F.col("level") == F.min("level").over(Window.partitionBy("chrom"))
    per = per_chrom.withColumn("own", first.cast("long")).groupBy("level").agg(F.sum("bins_used").alias("bins_used"), F.sum("features_count").alias("features_count"), F.max("most").alias("max_features_in_bin"), F.sum("own").alias("own"))
    per = per.withColumn("chroms", F.sum("own").over(Window.partitionBy()))  # a row for each level
    return per.select(
        "level",
        "bins_used",
        total.alias("total_bins"),
        "features_count",
        (F.col("bins_used") / (total * F.col("chroms")) * 100.0).alias("utilization"),
        (F.col("features_count") / F.col("bins_used")).alias("avg_features_per_bin"),
        "max_features_in_bin",
    )


#: Log2 of the ranges that sizes of a number of bits are put into for their prefix sums.
_RANGE_BITS = 16


def size_counts(features: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """size, n."""
    size = F.col(end).cast("long") - F.col(start).cast("long")
    return features.select(size.alias("size")).where("size IS NOT NULL").groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def _range(size: Column) -> Column:
    """The range of a size: a number that rises with it, of at most 2**17 values for each number of bits."""
    shift = lambda x: F.greatest(F.length(F.bin(x)) - F.lit(_RANGE_BITS + 1), F.lit(0))
    place = lambda x: shift(x).cast("long") * (2 << _RANGE_BITS) + F.call_function("shiftright", x, shift(x))
    return F.when(size < 0, -place(-(size + 1)) - 1).otherwise(place(size))


def quantiles_of(counts: DataFrame, quantiles: list[float]) -> DataFrame:
    """quantile, size: from counts by size (size, n), for each quantile the least size that at least that share of all has reached.

    Prefix sums run over the counts of ranges, at most a few million however many sizes there are, and within the ranges that
    hold an answer; ranges and sizes come from one exchange of the counts.
    """
    ranged = counts.select("size", "n", _range(F.col("size")).alias("range"))
    every, before = Window.partitionBy(), Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(F.sum("n").alias("held"))
    totals = totals.select("range", "held", F.sum("held").over(every).alias("all"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("quantile"), F.greatest(F.ceil(F.lit(Decimal(str(p))) * F.col("all").cast("decimal(20,0)")), F.lit(1)).cast("long").alias("rank")) for i, p in enumerate(quantiles)))
    asked = totals.select("range", "before", F.explode(F.filter(wanted, lambda w: (w["rank"] > F.col("before")) & (w["rank"] <= F.col("before") + F.col("held")))).alias("w"))
    within = ranged.join(F.broadcast(asked), "range").select("size", "n", "w.*", "before")  # a row for each quantile
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("i").orderBy("size"))
    return within.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select("quantile", "size")


def size_quantiles(features: DataFrame, quantiles: list[float], start: str = "start", end: str = "end") -> DataFrame:
    """quantile, size, for any list of quantiles at once; no rows without features."""
    return quantiles_of(size_counts(features, start, end), quantiles)


def size_stats(features: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row: min_size, max_size, mean_size, median_size (the upper one of two middle sizes); zeros without features."""
    return sizes_of(size_counts(features, start, end))


def sizes_of(counts: DataFrame) -> DataFrame:
    """size_stats from counts by size (size, n)."""
    # the upper median is what half of all reach, counted from the greatest
    down = quantiles_of(counts.select((-F.col("size")).alias("size"), "n"), [0.5]).select((-F.col("size")).alias("median"))
    zero = F.lit(0).cast("long")
    own = counts.agg(F.min("size").alias("a"), F.max("size").alias("b"), F.sum(F.col("size").cast("decimal(38,0)") * F.col("n")).alias("total"), F.sum("n").alias("all"))
    return own.join(F.broadcast(down.agg(F.max("median").alias("median")))).select(  # one row each
        F.coalesce("a", zero).alias("min_size"),
        F.coalesce("b", zero).alias("max_size"),
        F.coalesce((F.col("total") / F.col("all")).cast("double"), F.lit(0.0)).alias("mean_size"),
        F.coalesce("median", zero).alias("median_size"),
    )


def size_histogram(features: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """bucket, n: by floor of log2 of the size; size 0 counts as bucket 0."""
    size = F.col(end) - F.col(start)
    bucket = F.when(size <= 0, F.lit(0)).otherwise(F.floor(F.log2(size.cast("double"))).cast("int"))
    return features.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def bin_summary(features: DataFrame, bins: Bins | str = DEFAULT, start: str = "start", end: str = "end") -> DataFrame:
    """One row of totals: features, bins in use, utilization, density, bins touched per feature, share below the top level."""
    touched = scheme(bins).fan_out(F.col(start), F.col(end))
    return summary_of(bin_index(features, bins, start, end).groupBy("chrom", "level", "bin_id").agg(F.count(F.lit(1)).alias("n"), F.sum(touched).alias("touched")), bins)


def summary_of(per_bin: DataFrame, bins: Bins | str = DEFAULT) -> DataFrame:
    """bin_summary from counts by bin (chrom, level, bin_id, n, touched)."""
    bins = scheme(bins)
    zero = F.lit(0).cast("long")
    total, used = F.coalesce(F.sum("n"), zero), F.count_distinct("bin_id")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return per_bin.agg(
        total.alias("total_features"),
        used.alias("total_bins_used"),
        F.count(F.lit(1)).alias("chrom_bins_used"),
        F.count_distinct("chrom").alias("chroms"),
        F.lit(bins.total).cast("long").alias("total_possible_bins"),
        (ratio(used, F.lit(bins.total)) * 100.0).alias("bin_utilization"),
        ratio(total, used).alias("bin_density"),
        ratio(F.sum("touched"), total).alias("feature_overlap"),
        ratio(F.sum(F.when(F.col("level") > 0, F.col("n")).otherwise(zero)), total).alias("level_overhead"),
    )


def partials(rows: DataFrame, bins: Bins | str, file: Column, start: str = "start", end: str = "end") -> DataFrame:
    """What statistics and joins need of stored rows, in one pass: counts by bin, by size, and by file and class of length.

    kind (bins, sizes, files), chrom, level, bin_id, size, file, class, n, touched, first (least start), last (greatest start), past
    (greatest end). Rows beyond the scheme's range have no bin (level and bin_id null).
    """
    bins = scheme(bins)
    s, e = F.col(start), F.col(end)
    inside = (s >= 0) & (e <= bins.limit)
    own = F.when(inside, bins.bin_of(s, e))
    base = rows.select("chrom", s.alias("start"), e.alias("end"), own.alias("bin_id"), file.alias("file"), bins.fan_out(s, e).alias("touched"))
    base = base.select("*", F.when(F.col("bin_id").isNotNull(), bins.level_of(F.col("bin_id"))).alias("level"), (F.col("end") - F.col("start")).alias("size"), F.length(F.bin(F.col("end") - F.col("start") - 1)).alias("class"))
    sets = [["chrom", "level", "bin_id"], ["size"], ["file", "chrom", "class"]]
    kind = F.when(F.grouping("size") == 0, "sizes").when(F.grouping("file") == 0, "files").otherwise("bins")
    found = base.groupingSets(sets, "chrom", "level", "bin_id", "size", "file", "class")
    return found.agg(kind.alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("touched").alias("touched"), F.min("start").alias("first"), F.max("start").alias("last"), F.max("end").alias("past"))


def describe(bins: Bins | str) -> dict[str, object]:
    bins = scheme(bins)
    return {"schema": bins.label, "base_shift": bins.base_shift, "level_shift": bins.level_shift, "levels": bins.levels, "linear_index": bins.linear_shift is not None}


def descriptors(*schemes: Bins | str, spark: SparkSession) -> DataFrame:
    """A row for each scheme: its label, shifts, levels, bins, and whether it has a linear index."""
    rows = [(*describe(b).values(), scheme(b).total) for b in schemes]
    return spark.createDataFrame(rows, "scheme string, base_shift int, level_shift int, levels int, linear_index boolean, total_bins long")


def bins_by_chrom(features: DataFrame, bins: Bins | str = DEFAULT, **names) -> DataFrame:
    """chrom, bin_id: the bins in use of each sequence, a row for each, in order."""
    return bin_index(features, bins, **names).select("chrom", "bin_id").distinct().orderBy("chrom", "bin_id")


def _summary(s: Row, bins: Bins) -> str:
    return "\n".join(
        [
            f"scheme            {bins.label}, {bins.levels} levels",
            f"features          {s.total_features}",
            f"bins in use       {s.bin_utilization:.2f}%",
            f"features per bin  {s.bin_density:.2f}",
            f"bins per feature  {s.feature_overlap:.2f}",
            f"below top level   {s.level_overhead:.2f}",
        ]
    )


def summary(features: DataFrame, bins: Bins | str = DEFAULT) -> str:
    """Six lines on the index."""
    return summary_text(bin_summary(features, bins), bins)


def summary_text(totals: DataFrame, bins: Bins | str) -> str:
    """The six lines, from a row of bin_summary."""
    return _summary(totals.first(), scheme(bins))


def report(features: DataFrame, bins: Bins | str = DEFAULT) -> str:
    """The summary, a line for each level, the sizes, and remarks on what stands out."""
    return report_text(bin_summary(features, bins), level_stats(features, bins), size_stats(features), bins)


def report_text(totals: DataFrame, levels: DataFrame, sizes: DataFrame, bins: Bins | str) -> str:
    """The report, from bin_summary, level_stats and size_stats."""
    bins = scheme(bins)
    s, z = totals.first(), sizes.first()
    lines = [_summary(s, bins), "", "level  bins used       of  features  per bin   most"]
    lines += [f"{r.level:5d}  {r.bins_used:9d} {r.total_bins:8d}  {r.features_count:8d}  {r.avg_features_per_bin:7.2f}  {r.max_features_in_bin:5d}" for r in levels.orderBy("level").collect()]
    lines += ["", f"sizes: {z.min_size} to {z.max_size}, mean {z.mean_size:.2f}, median {z.median_size}", ""]
    return "\n".join(lines + [f"- {text}" for text in remarks(s, bins)])


def remarks(s: Row, bins: Bins | str) -> list[str]:
    """What stands out in a row of bin_summary."""
    label = scheme(bins).label
    # fixed values: the limits above or below which a figure is remarked on
    found = [
        (s.bin_density > 100, "bins are crowded: finer bins would help"),
        (s.bin_density < 10, "bins hold few features each: space is well divided, at some cost in bins"),
        (s.level_overhead > 2.0, "most features lie below the top level"),
        (label == "Dense" and s.bin_utilization < 30, "few of the dense bins are in use: the scheme may be too fine"),
        (label == "Sparse" and s.bin_density > 50, "sparse bins are crowded: expect hot bins"),
        (label not in ("Dense", "Sparse") and s.feature_overlap > 3, "features touch several bins each: many are large"),
    ]
    return [text for holds, text in found if holds]
