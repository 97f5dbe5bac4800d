"""Overlap joins on half-open intervals.

A range join has no equality, so Spark alone would pair everything of a sequence. Here features are put into classes by
length: class k holds lengths up to 2**k, a class for every `STEP`-th k, and a feature's bin is its start >> k. A region visits, for each class in use,
the bins in which a feature that overlaps it may start, that is those of [qstart - 2**k + 1, qend). Features and
regions join on (sequence, class, bin) with the exact overlap condition as residual. A feature has one bin and a region
visits a bin once, so no pair comes twice, and a region meets about the features that begin within a length of it.

A region that would visit more than `FAN_OUT` bins of a class visits bins 2**8 times as wide, or wider still; features
have a code for each width in use. Which classes, widths and how many visits there are is measured: one aggregate over
the features' starts and ends (`Spread`; a store keeps it) and one over the regions' lengths, which bounds the visits to
each class from above. Visits of at most `BROADCAST_BYTES` by that bound are broadcast; others are shuffled as the features are and merged, and Spark splits hot bins.
Visits are most of what is shuffled: regions are dealt out by place before, so that equal names and near places lie together and take less room.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from ..errors import InvalidIntervalError
from ..functions.bins import DEFAULT, Bins, scheme
from ..functions.regions import parse_region
from . import sweep

#: Most bins of a class that a region visits, and the step to wider bins, in bits.
FAN_OUT, WIDER = 512, 8
#: Log2 of how many times as long the features of the next class may be. Fewer classes are fewer visits, and more rows that are looked at for a pair.
STEP = 2
#: Log2 of the finest bins: at least, and where the regions' lengths aren't known.
FINEST, BASE = 9, 14
#: Most bytes of visits that are broadcast.
BROADCAST_BYTES = 8 << 20
#: Most visits that the regions of a task are to become.
DEALT = 1 << 18
#: What the columns of regions and of their visits are called by inside a join: these, with further underscores where features have such names.
_Q, _V = "__q_", "__v_"


def overlaps(start: Column, end: Column, qstart: Column, qend: Column) -> Column:
    """Half-open: intervals that only touch do not overlap."""
    return (start < qend) & (end > qstart)


def checked(start: Column, end: Column) -> Column:
    """start, or an error where end is not above it."""
    text = F.concat(F.lit("invalid interval: "), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(end <= start, F.raise_error(text).cast("long")).otherwise(start)


@dataclass(frozen=True)
class Spread:
    """What a join needs to know of its features: log2 of the lengths in use, rounded up, and the least and greatest start."""

    classes: tuple[int, ...] = ()
    first: int = 0
    last: int = -1


def _class_of(start: Column, end: Column) -> Column:
    """log2 of the length, rounded up (1 at least); an error where end is not above start."""
    text = F.concat(F.lit("invalid interval: "), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.length(F.bin(F.when(end <= start, F.raise_error(text).cast("long")).otherwise(end - start - 1)))


def measure(features: DataFrame, start: str = "start", end: str = "end") -> Spread:
    """One aggregate over the starts and ends, of at most 64 rows."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    rows = [r for r in features.select(_class_of(s, e).alias("k"), s.alias("s")).groupBy("k").agg(F.min("s").alias("a"), F.max("s").alias("b")).collect() if r.k is not None]
    return Spread(tuple(sorted(r.k for r in rows)), min(r.a for r in rows), max(r.b for r in rows)) if rows else Spread()


#: Classes and widths in use, each as (class, width, whether it is the class's widest); width 0 is the finest.
Kinds = list[tuple[int, int, bool]]


def kinds_of(spread: Spread, base: int) -> Kinds:
    """All that regions may need, with no class below base: the features' greatest class, and from there every `STEP`-th."""
    out: Kinds = []
    top = max((base, *spread.classes))
    for k in sorted({k + (top - k) % STEP for k in (max(base, k) for k in spread.classes)}):
        n = 1
        while ((spread.last - spread.first) >> k + WIDER * (n - 1)) + 2 > FAN_OUT:
            n += 1
        out += [(k, j, j == n - 1) for j in range(n)]
    return out


@dataclass(frozen=True)
class _Sides:
    """Both sides, to be given codes: a bin, its class and its width in one number."""

    features: DataFrame
    regions: DataFrame
    spread: Spread
    cols: tuple[str, ...]  # chrom, start, end, qchrom, qstart, qend
    kinds: Kinds
    small: bool | None = None  # None: not known

    def visits(self) -> DataFrame:
        """Each region with the classes and widths that it uses: __a and __b, its first and last bin, and __kind."""
        qs, qe = (F.col(c).cast("long") for c in self.cols[4:])
        first, last = (F.lit(x).cast("long") for x in (self.spread.first, self.spread.last))
        kinds = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(k + WIDER * j).alias("sh"), F.lit(j).alias("j"), F.lit(widest).alias("widest")) for k, j, widest in self.kinds))
        out = self.regions.withColumn(_V + "kind", F.explode(kinds if self.kinds else F.expr("CAST(array() AS array<struct<k:int,sh:int,j:int,widest:boolean>>)")))
        k, sh, j = (F.col(f"{_V}kind.{c}") for c in ("k", "sh", "j"))
        # where a feature of the class that overlaps the region may start
        a = F.greatest(F.greatest(qs, first) - F.call_function("shiftleft", F.lit(1).cast("long"), k) + 1, first)
        out = out.withColumns({_V + "a": a, _V + "b": F.least(qe - 1, last)})
        shifted = lambda x, sh: F.call_function("shiftright", F.col(_V + x), sh)
        few = shifted("b", sh) - shifted("a", sh) < FAN_OUT
        many = shifted("b", sh - WIDER) - shifted("a", sh - WIDER) >= FAN_OUT
        out = out.where((F.col(_V + "b") >= F.col(_V + "a")) & (F.col(f"{_V}kind.widest") | few) & ((j == 0) | many))
        return out.withColumns({_V + "a": shifted("a", sh), _V + "b": shifted("b", sh), _V + "kind": k * 8 + j})

    def coded_features(self, code: str) -> DataFrame:
        s, e = (F.col(c).cast("long") for c in self.cols[1:3])
        least = F.lit(min((k for k, *_ in self.kinds), default=BASE))
        k = F.greatest(_class_of(s, e), least)
        k = k + F.pmod(least - k, F.lit(STEP))
        # never null, so that no check for it is computed beside it; no region visits the least number
        codes = [F.coalesce(F.call_function("shiftright", s, k + WIDER * j) * 512 + (k * 8 + j), F.lit(-(1 << 63)).cast("long")) for j in sorted({j for _, j, _ in self.kinds}) or [0]]
        return self.features.withColumn(code, codes[0] if len(codes) == 1 else F.explode(F.array(*codes)))

    def coded_regions(self, code: str) -> DataFrame:
        at = lambda x: F.col(_V + x) * 512 + F.col(_V + "kind")
        out = self.visits().withColumn(code, F.explode(F.sequence(at("a"), at("b"), F.lit(512).cast("long")))).drop(_V + "a", _V + "b", _V + "kind")
        return out if self.small is None else F.broadcast(out) if self.small else out.hint("merge")

    def join(self, how: str) -> DataFrame:
        chrom, start, end, qchrom, qstart, qend = self.cols
        code, qcode = (_free(self.features.columns + self.regions.columns, x) for x in ("__code", _V + "code"))
        f, q = self.coded_features(code), self.coded_regions(qcode)
        on = (F.col(code) == F.col(qcode)) & (F.col(chrom) == F.col(qchrom)) & overlaps(F.col(start), F.col(end), F.col(qstart), F.col(qend))
        return f.join(q, on, how).drop(code, qcode)

    def by_width(self) -> list[_Sides]:
        """The same, one width at a time: a feature has one code in each."""
        return [replace(self, kinds=[k for k in self.kinds if k[1] == j]) for j in sorted({j for _, j, _ in self.kinds}) or [0]]


def _free(taken: list[str], name: str) -> str:
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def _width(df: DataFrame) -> Column:
    """About the bytes of a row."""
    total = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            total = total + F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))) + 16
        else:
            total = total + 8
    return total.cast("long")


def _within(features: DataFrame, bins: Bins | str | None, start: str, end: str) -> DataFrame:
    """The features; one beyond the scheme's range is an error."""
    if bins is None:
        return features
    text = F.concat(F.lit("interval does not fit the bin scheme: "), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))
    out = (F.col(start) < 0) | (F.col(end) > scheme(bins).limit)
    return features.withColumn(start, F.when(out, F.raise_error(text).cast(features.schema[start].dataType)).otherwise(F.col(start)))


def _sides(features: DataFrame, regions: DataFrame, bins: Bins | str | None, cols: tuple[str, ...], spread: Spread | None) -> _Sides:
    """Measure both sides. bins: a scheme beyond whose range a feature is an error."""
    start, end, qstart, qend = cols[1], cols[2], cols[4], cols[5]
    spread = spread or measure(features, start, end)
    features = _within(features, bins, start, end)
    if regions.isStreaming:
        return _Sides(features, regions, spread, cols, kinds_of(spread, BASE))
    regions = regions.where(F.col(qstart).isNotNull() & F.col(qend).isNotNull())
    lengths = _lengths(regions, qstart, qend, spread)
    # bins about as long as a middling region; a few very long ones say nothing of the others
    every = kinds_of(spread, max(FINEST, _middling(lengths) - 1) if lengths else BASE)
    found = {kind: most for kind in every if (most := _most_visits(lengths, *kind)) is not None}
    visits, tasks = sum(n for n, _ in found.values()), max((r.tasks for r in lengths), default=1)
    if visits > DEALT * tasks:  # few tasks hold the regions: deal them out before each becomes many rows
        regions = _by_place(regions, math.ceil(visits / DEALT), cols[3], qstart)
    return _Sides(features, regions, spread, cols, list(found), sum(n for _, n in found.values()) <= BROADCAST_BYTES)


def _by_place(regions: DataFrame, tasks: int, chrom: str, start: str) -> DataFrame:
    """Dealt out by ranges of place, in order; of copies of one region too each task has some."""
    number = _free(regions.columns, _V + "number")
    dealt = regions.withColumn(number, F.monotonically_increasing_id()).repartitionByRange(tasks, chrom, start, number)
    return dealt.sortWithinPartitions(chrom, start).drop(number)


def _lengths(regions: DataFrame, qstart: str, qend: str, spread: Spread) -> list[Row]:
    """The regions by bits of the length that they share with the features' range, shortest first: at most 64 rows."""
    first, last = (F.lit(x).cast("long") for x in (spread.first, spread.last))
    shared = F.least(F.col(qend).cast("long"), last + 1) - F.greatest(F.col(qstart).cast("long"), first)
    rows = regions.select(F.greatest(shared, F.lit(1).cast("long")).alias("size"), _width(regions).cast("double").alias("bytes"), F.spark_partition_id().alias("task"))
    return (
        rows.groupBy(F.length(F.bin("size")).alias("bits"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("size").cast("double")).alias("total"),
            F.min("size").alias("least"),
            F.max("size").alias("most"),
            F.sum("bytes").alias("bytes"),
            F.sum(F.col("size") * F.col("bytes")).alias("total_bytes"),
            F.approx_count_distinct("task").alias("tasks"),
        )
        .orderBy("bits")
        .collect()
    )


def _middling(lengths: list[Row]) -> int:
    """Bits of the median length."""
    rank = (sum(r.n for r in lengths) - 1) // 2
    for r in lengths:
        if rank < r.n:
            return r.bits
        rank -= r.n
    raise ValueError("no lengths")


def _most_visits(lengths: list[Row], k: int, j: int, widest: bool) -> tuple[float, float] | None:
    """At most how many visits, and of how many bytes, the regions make to a class at a width; None where none does."""
    # a region's last bin is at most (length + more) >> width after its first, or one on; at least (length - 1) >> width
    more, width = (1 << k) - 2, k + WIDER * j
    own = [r for r in lengths if (widest or (r.least - 1) >> width < FAN_OUT) and (j == 0 or ((r.most + more) >> width - WIDER) + 1 >= FAN_OUT)]
    most = lambda n, total: min((total + n * more) / 2.0**width + 2 * n, float(n * FAN_OUT))
    return (sum(most(r.n, r.total) for r in own), sum(most(r.bytes, r.total_bytes) for r in own)) if own else None


def _regions(regions: DataFrame, q: str, qs: str, qe: str, strict: bool) -> DataFrame:
    """The regions with all columns prefixed, checked or without the invalid ones."""
    own = regions.withColumnsRenamed({c: q + c for c in regions.columns})
    if strict:
        return own.withColumn(q + qs, checked(F.col(q + qs), F.col(q + qe)))
    return own.where(F.col(q + qe) > F.col(q + qs))


def _prefix(features: DataFrame) -> str:
    """One that no feature column begins with."""
    q = _Q
    while any(c.lower().startswith(q) for c in features.columns):
        q = f"_{q}"
    return q


def _pairs(features: DataFrame, regions: DataFrame, bins: Bins | str | None = None, *, chrom: str = "chrom", start: str = "start", end: str = "end", region_chrom: str = "chrom", region_start: str = "qstart", region_end: str = "qend", strict: bool = True, spread: Spread | None = None) -> tuple[DataFrame, str]:
    """All feature columns and, by a prefix, all region columns of each overlapping pair; and the prefix."""
    q = _prefix(features)
    own = _regions(regions, q, region_start, region_end, strict)
    return _sides(features, own, bins, (chrom, start, end, q + region_chrom, q + region_start, q + region_end), spread).join("inner"), q


def _named(features: list[str], regions: list[str]) -> dict[str, str]:
    """What region columns are called beside feature columns: region_<name> where a feature column has the name."""
    taken, out = {c.lower() for c in features}, {}
    for c in regions:
        name = c
        while name.lower() in taken:
            name = f"region_{name}"
        taken.add(name.lower())
        out[c] = name
    return out


def overlap_join(features: DataFrame, regions: DataFrame, bins: Bins | str | None = None, *, region_chrom: str = "chrom", **names) -> DataFrame:
    """A row for each overlapping pair: all feature columns, then the region columns but its sequence name.

    A region column named like a feature column comes as region_<name>. names: chrom, start, end of features, region_chrom,
    region_start, region_end of regions, where they aren't chrom, start, end, chrom, qstart, qend. strict: a region whose end is
    not above its start fails the query (the default); otherwise it matches nothing. bins: a scheme beyond whose range a feature
    fails the query. spread: of the features, where it is known. Both sides are read once to be measured and once to be joined.
    """
    pairs, q = _pairs(features, regions, bins, region_chrom=region_chrom, **names)
    called = _named(features.columns, [c for c in regions.columns if c != region_chrom])
    return pairs.select(*(F.col(f"`{c}`") for c in features.columns), *(F.col(f"`{q}{c}`").alias(name) for c, name in called.items()))


def overlapping_records(features: DataFrame, regions: DataFrame, bins: Bins | str | None = None, **names) -> DataFrame:
    """The feature side only, once for each region that it overlaps: counted (`sweep`), not joined."""
    if regions.isStreaming:
        return overlap_join(features, regions, bins, **names).select(*features.columns)
    own, bounds, asked, asked_bounds, _ = _ends(features, regions, bins, **names)
    return sweep.repeated(sweep.counted(asked, own, asked_bounds, bounds)).select(*(F.col(f"`{c}`") for c in features.columns))


def _ends(features: DataFrame, regions: DataFrame, bins: Bins | str | None = None, *, chrom: str = "chrom", start: str = "start", end: str = "end", region_chrom: str = "chrom", region_start: str = "qstart", region_end: str = "qend", strict: bool = True, spread: Spread | None = None) -> tuple[DataFrame, tuple[str, str, str], DataFrame, tuple[str, str, str], str]:
    """What `sweep` takes: both sides, checked, without rows that can't overlap any, and their bounds; and the prefix of region columns."""
    q = _prefix(features)
    own, bounds = _regions(regions, q, region_start, region_end, strict), (q + region_chrom, q + region_start, q + region_end)
    known = lambda df, *names: df.dropna(subset=[f"`{c}`" for c in names])
    features = _within(known(features, chrom, start, end), bins, start, end)
    features = features.withColumn(start, checked(F.col(f"`{start}`"), F.col(f"`{end}`")).cast(features.schema[start].dataType))
    return features, (chrom, start, end), known(own, *bounds), bounds, q


def overlap_counts(features: DataFrame, regions: DataFrame, key: str = "qid", bins: Bins | str | None = None, zeros: bool = False, **names) -> DataFrame:
    """key, n: overlapping features of each region; zeros: also of regions that have none. Regions of one key, null too, count together.

    key is a region's column, whatever features have of that name. names: as overlap_join's. No pairs are made (`sweep`).
    """
    return _for_each(features, regions, key, bins, ["n"], zeros, names)


def _for_each(features: DataFrame, regions: DataFrame, key: str, bins: Bins | str | None, figures: list[str], zeros: bool, names: dict) -> DataFrame:
    """The regions' keys with figures of what overlaps; zeros: a row for each region, with zeros for those that have none."""
    if key.lower() in figures:
        raise ValueError(f"a key can't be called {key}, as a figure is")
    if regions.isStreaming:  # no window runs over a stream
        pairs, q = _pairs(features, regions, bins, **names)
        s, e = (F.col(f"`{names.get(x, x)}`") for x in ("start", "end"))
        qs, qe = (F.col(f"`{q}{names.get(x, own)}`") for x, own in (("region_start", "qstart"), ("region_end", "qend")))
        sums = {"n": F.count(F.lit(1)), "bases": F.sum((F.least(e, qe) - F.greatest(s, qs)).cast("long"))}
        found = pairs.groupBy(F.col(f"`{q}{key}`")).agg(*(sums[name].alias(name) for name in figures))
    else:
        features, bounds, own, own_bounds, q = _ends(features, regions, bins, **names)
        found = sweep.summed(features, own, [q + key], bounds, own_bounds, "bases" in figures).where(F.col("n") > 0)
    if not zeros:
        return found.withColumnRenamed(q + key, key)
    keys, zero = regions.select(F.col(f"`{key}`").alias(_V)), F.lit(0).cast("long")
    return keys.join(found, F.col(_V).eqNullSafe(F.col(f"`{q}{key}`")), "left").select(F.col(_V).alias(key), *(F.coalesce(name, zero).alias(name) for name in figures))


def overlap_semi(features: DataFrame, regions: DataFrame, bins: Bins | str | None = None, *, anti: bool = False, chrom: str = "chrom", start: str = "start", end: str = "end", region_chrom: str = "chrom", region_start: str = "qstart", region_end: str = "qend", strict: bool = True, spread: Spread | None = None) -> DataFrame:
    """Extension: the features that overlap any region (anti: none), each once. Regions are checked as in overlap_join."""
    q = _prefix(features)
    own = _regions(regions.select(region_chrom, region_start, region_end), q, region_start, region_end, strict)
    sides = _sides(features, own, bins, (chrom, start, end, q + region_chrom, q + region_start, q + region_end), spread)
    first, *wider = sides.by_width()
    rest, found = first.join("left_anti"), first.join("left_semi")
    for own in wider:  # only where some regions are very wide
        own = replace(own, features=rest)
        found, rest = found.unionByName(own.join("left_semi")), own.join("left_anti")
    return rest if anti else found


def overlap_left(features: DataFrame, regions: DataFrame, key: str = "qid", bins: Bins | str | None = None, **names) -> DataFrame:
    """Extension: every region, with all its columns, and its features (without their sequence name), or nulls.

    The key, which may be null once, names a region. Columns are called as overlap_join's are; names: as its.
    """
    pairs, q = _pairs(features, regions, bins, **names)
    kept = [c for c in features.columns if c != names.get("chrom", "chrom")]
    own = pairs.select(F.col(f"`{q}{key}`").alias(q), *(F.col(f"`{c}`") for c in kept))
    all_regions = regions.withColumnsRenamed({c: q + c for c in regions.columns})
    found = all_regions.join(own, F.col(f"`{q}{key}`").eqNullSafe(F.col(q)), "left")
    return found.select(*(F.col(f"`{q}{c}`").alias(name) for c, name in _named(kept, regions.columns).items()), *(F.col(f"`{c}`") for c in kept))


def overlap_left(features: DataFrame, regions: DataFrame, key: str = "qid", bins: Bins | str | None = None, **names) -> DataFrame:
    """Extension: every region, with all its columns, and its features (without their sequence name), or nulls.

    Columns are called as overlap_join's are; names: as its. The pairs are not shuffled: regions that overlap nothing are found
    by the features' ends (`sweep.alone`) and added. So no key is needed; key is taken for callers that name one.
    """
    pairs, q = _pairs(features, regions, bins, **names)
    own, bounds, asked, asked_bounds, _ = _ends(features, regions, bins, **names)
    chrom, start, end = (F.col(f"`{c}`") for c in asked_bounds)
    known = F.coalesce(chrom.isNotNull() & (end > start), F.lit(False))
    unknown = regions.withColumnsRenamed({c: q + c for c in regions.columns}).where(~known)
    alone = sweep.alone(own, asked, bounds, asked_bounds).unionByName(unknown)
    kept = [c for c in features.columns if c != names.get("chrom", "chrom")]
    called = _named(kept, regions.columns)
    mine = [F.col(f"`{q}{c}`").cast(regions.schema[c].dataType).alias(name) for c, name in called.items()]
    nulls = [F.lit(None).cast(features.schema[c].dataType).alias(c) for c in kept]
    return pairs.select(*mine, *(F.col(f"`{c}`") for c in kept)).unionAll(alone.select(*mine, *nulls))


def coverage(features: DataFrame, regions: DataFrame, key: str = "qid", bins: Bins | str | None = None, **names) -> DataFrame:
    """Extension: key, n, bases: features over each region and the summed length of their overlaps. key, names: as overlap_counts'."""
    return _for_each(features, regions, key, bins, ["n", "bases"], True, names)


def lookup(features: DataFrame, chrom: str, qstart: int, qend: int, *, chrom_col: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """The features that overlap one interval; plain comparisons, so that they reach the scan."""
    if qend <= qstart:
        raise InvalidIntervalError(f"invalid interval: {qstart}-{qend}")
    return features.where((F.col(chrom_col) == chrom) & (F.col(start) < qend) & (F.col(end) > qstart))


def lookup_region(features: DataFrame, region: str, **names) -> DataFrame:
    """The features that overlap `name:start-end`."""
    return lookup(features, *parse_region(region), **names)


def map_overlapping(features: DataFrame, chrom: str, qstart: int, qend: int, function: Callable, schema: str) -> DataFrame:
    """The user's function over Arrow batches of the overlapping features."""
    return lookup(features, chrom, qstart, qend).mapInArrow(function, schema)


def index_keys(bins: Bins | str = DEFAULT, start: str = "start", end: str = "end") -> list[Column]:
    """Keys of an index walk: the finest level first, then by bin."""
    bins = scheme(bins)
    own = bins.bin_of(F.col(start), F.col(end))
    return [bins.level_of(own).desc(), own]


def in_index_order(rows: DataFrame, bins: Bins | str = DEFAULT, order: str = "ord", start: str = "start", end: str = "end") -> DataFrame:
    """Order of an index walk: finest level first, then by bin, then by order of insertion."""
    return rows.orderBy(*index_keys(bins, start, end), order)
