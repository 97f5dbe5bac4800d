"""A store of intervals: segments of Parquet files by sequence, sorted by start, and numbered descriptions (`Snapshots`).

Rows are dealt out by ranges of (chrom, start, end), so a sequence with a third of all rows is written by many tasks and
its files hold narrow ranges of start, which lets a lookup skip files and row groups. Each write adds a segment: its rows and,
beside them, its partials (counts by bin and by size, bounds by file and class of length), from which statistics are merged
without a look at the rows, and joins find the files that regions reach. A write is there when its description is: a store that is
overwritten or added to is whole until then, and of writers at the same time each waits for its number.

    manifests/<number>.json   which segments count, the scheme, columns, user's metadata
    rows/__segment=<id>/chrom=<name>/*.parquet
    partials/__segment=<id>/kind=<bins, sizes, files>/*.parquet
    index/__index=<id>/chrom=<name>/*.parquet       where `build_index` made one: the rows and files of each bin (`bin_index`)
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StructType

from ..errors import IntervalError, StoreError, StoreExistsError
from ..functions.bins import DEFAULT, PRESETS, Bins, scheme
from ..functions.regions import parse_region
from ..operators import layout, lines, overlap, stats
from ..operators.visit import visit
from . import bin_index
from .snapshots import Snapshots

SUFFIX = ".intervals"
_SEGMENT, _INDEX = "__segment", "__index"
#: What a folder of rows without a sequence name would be called.
_NULL_NAME = "__HIVE_DEFAULT_PARTITION__"


def default_output(path: str) -> str:
    """x.bed.gz and x.bed become x with the store's suffix."""
    folder, name = os.path.split(path)
    stem = os.path.splitext(name)[0]
    return os.path.join(folder, os.path.splitext(stem)[0] + SUFFIX)


def compare_sizes(spark: SparkSession, *paths: str) -> DataFrame:
    """path, bytes, ratio: what files or folders take on disk, and how many times the first of them. Their content isn't read."""
    held = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).select(F.lit(i).alias("i"), F.lit(p).alias("path"), "length") for i, p in enumerate(paths)]
    sizes = reduce(DataFrame.union, held).groupBy("i", "path").agg(F.sum("length").alias("bytes"))
    first = F.first("bytes").over(Window.orderBy("i"))  # a row for each path
    return sizes.select("path", "bytes", (F.col("bytes") / first).alias("ratio"), "i").orderBy("i").drop("i")


def discover(folder: str = ".") -> str:
    """The one store in a local folder."""
    found = sorted(glob.glob(os.path.join(folder, f"*{SUFFIX}")))
    if not found:
        raise StoreError(f"no *{SUFFIX} store in {folder}")
    if len(found) > 1:
        raise StoreError(f"several stores in {folder}, name one: {', '.join(found)}")
    return found[0]


PARTIALS = "chrom string, level int, bin_id long, size long, file string, class int, kind string, n long, touched long, first long, last long, past long"


def _checked(rows: DataFrame) -> DataFrame:
    wrong = F.raise_error(F.lit("chrom must be a name, start and end must not be null and end must be above start")).cast("long")
    good = ~F.col("chrom").isin("", _NULL_NAME) & (F.col("start") >= 0) & (F.col("end") > F.col("start"))
    return rows.withColumn("start", F.when(F.coalesce(good, F.lit(False)), F.col("start").cast("long")).otherwise(wrong)).withColumn("end", F.col("end").cast("long"))


def _write(rows: DataFrame, place: str, bins: Bins, files: int | None) -> dict:
    """A segment: its rows and partials. Nobody sees it before a description names it."""
    spark, name, order = rows.sparkSession, uuid.uuid4().hex, ["chrom", "start", "end"]
    at = f"{place}/rows/{_SEGMENT}={name}"
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.partitionBy("chrom").parquet(at)
    stored = spark.read.schema(rows.schema).parquet(at)
    beside = f"{place}/partials/{_SEGMENT}={name}"
    stats.partials(stored, bins, F.col("_metadata.file_path")).write.partitionBy("kind").parquet(beside)
    found = spark.read.schema(PARTIALS).parquet(beside).where("kind = 'files'")
    held = found.agg(F.collect_set("class").alias("k"), F.min("first").alias("a"), F.max("last").alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_distinct("file").alias("files")).first()
    spread = [sorted(held.k), held.a, held.b] if held.n else [[], 0, -1]
    return {"id": name, "rows": held.n, "files": held["files"], "spread": spread}


def _write_index(spark: SparkSession, place: str, segment: str, schema: StructType, bins: Bins) -> str:
    """The table of a segment's bins, under a name of its own: nobody reads it before a description names it."""
    name = uuid.uuid4().hex
    try:
        bin_index.build(spark.read.schema(schema).parquet(f"{place}/rows/{_SEGMENT}={segment}"), bins).write.partitionBy("chrom").parquet(f"{place}/index/{_INDEX}={name}")
    except Exception:
        _drop(Snapshots(spark, place), [], [name])
        raise
    return name


def _drop(kept: Snapshots, segments: list[str], indexes: list[str] = ()) -> None:
    for name in segments:
        kept.delete(f"rows/{_SEGMENT}={name}")
        kept.delete(f"partials/{_SEGMENT}={name}")
    for name in indexes:
        kept.delete(f"index/{_INDEX}={name}")


def _indexes(segments: list[dict]) -> list[str]:
    return [s["index"] for s in segments if s.get("index")]


class IntervalStore:
    """An opened store. key: a store's place among several under one root."""

    def __init__(self, spark: SparkSession, path: str, version: int, meta: dict):
        self.spark, self.path, self.version, self._meta, self._files = spark, path, version, meta, None

    @staticmethod
    def _place(path: str, key: str | None) -> str:
        return f"{path.rstrip('/')}/{key}" if key else path.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, path: str, *, key: str | None = None, bins: Bins | str = DEFAULT, metadata: object = None, overwrite: bool = False, files: int | None = None) -> IntervalStore:
        """Write rows (chrom, start, end and any other columns, in any order). Without overwrite an existing store is an error.

        Of several that overwrite at once the last counts. The rows of before go when the new ones are there.
        """
        spark, bins, place = rows.sparkSession, scheme(bins), cls._place(path, key)
        kept = Snapshots(spark, place)
        if not overwrite and kept.numbers():
            raise StoreExistsError(f"there is a store at {place}")
        shape = {"base_shift": bins.base_shift, "level_shift": bins.level_shift, "levels": bins.levels, "linear_shift": bins.linear_shift, "label": bins.label}
        rows = _checked(rows)
        segment = _write(rows, place, bins, files)
        meta = {"bins": shape, "schema": json.loads(rows.schema.json()), "metadata": metadata, "segments": [segment]}
        while True:
            former = kept.latest()
            if former and not overwrite:
                _drop(kept, [segment["id"]])
                raise StoreExistsError(f"there is a store at {place}")
            number = former[0] + 1 if former else 1
            if kept.commit(number, meta):
                break
        if former:
            kept.forget(number)
            _drop(kept, [s["id"] for s in former[1]["segments"]], _indexes(former[1]["segments"]))
        return cls(spark, place, number, meta)

    def _change(self, change) -> IntervalStore:
        """Commit what `change` makes of the latest description; again from the new one where another writer was first."""
        kept = Snapshots(self.spark, self.path)
        while True:
            found = kept.latest()
            if found is None:
                raise StoreError(f"no store at {self.path}")
            number, meta = found
            meta = change(meta)
            if kept.commit(number + 1, meta):
                self.version, self._meta = number + 1, meta
                return self

    def append(self, rows: DataFrame, files: int | None = None) -> IntervalStore:
        """Add rows of the same columns, as a segment of its own. Other writers' rows stay: appends may be made at once."""
        rows = _checked(rows.select(*self.schema.names) if sorted(rows.columns) == sorted(self.schema.names) else rows)
        if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in self.schema]:
            raise StoreError(f"rows to add need the columns {self.schema.simpleString()}")
        segment = _write(rows, self.path, self.bins, files)

        def added(meta: dict) -> dict:
            if meta["schema"] != self._meta["schema"] or meta["bins"] != self._meta["bins"]:
                raise StoreError("the store was overwritten with other columns or bins")
            return meta | {"segments": [*meta["segments"], segment]}

        try:
            return self._change(added)
        except StoreError:
            _drop(Snapshots(self.spark, self.path), [segment["id"]])
            raise

    def compact(self, files: int | None = None) -> IntervalStore:
        """Write the rows of all segments as one, whose files overlap no more. What is added meanwhile stays beside it; where the
        store is overwritten meanwhile, nothing changes. The former segments stay for readers until `vacuum`."""
        old = [s["id"] for s in self._meta["segments"]]
        if len(old) < 2:
            return self
        segment = _write(self.rows(), self.path, self.bins, files)
        if len(_indexes(self._meta["segments"])) == len(old):
            segment["index"] = _write_index(self.spark, self.path, segment["id"], self.schema, self.bins)

        def merged(meta: dict) -> dict:
            now = [s["id"] for s in meta["segments"]]
            if not set(old) <= set(now):
                raise StoreError("the segments were replaced meanwhile")
            return meta | {"segments": [segment, *(s for s in meta["segments"] if s["id"] not in old)]}

        try:
            return self._change(merged)
        except StoreError:
            _drop(Snapshots(self.spark, self.path), [segment["id"]], _indexes([segment]))
            raise

    def build_index(self) -> IntervalStore:
        """Write the table of bins of each segment that has none; the rows stay as they are.

        What another writer noted first stays, and an index whose segment was replaced meanwhile goes again. Rows added later have
        none until the next call and are looked up without; a compaction of indexed segments is indexed.
        """
        made = {s["id"]: _write_index(self.spark, self.path, s["id"], self.schema, self.bins) for s in self._meta["segments"] if not s.get("index")}
        if not made:
            return self

        def noted(meta: dict) -> dict:
            return meta | {"segments": [s | {"index": made[s["id"]]} if s["id"] in made and not s.get("index") else s for s in meta["segments"]]}

        self._change(noted)
        _drop(Snapshots(self.spark, self.path), [], sorted(set(made.values()) - set(_indexes(self._meta["segments"]))))
        return self

    def vacuum(self) -> None:
        """Delete former descriptions and the segments that only they name. Readers of a former state lose it."""
        kept = Snapshots(self.spark, self.path)
        numbers = kept.numbers()
        own = kept.read(numbers[-1])["segments"]
        former = [s for n in numbers[:-1] for s in kept.read(n)["segments"]]
        kept.forget(numbers[-1])
        _drop(kept, sorted({s["id"] for s in former} - {s["id"] for s in own}), sorted(set(_indexes(former)) - set(_indexes(own))))

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str | None = None, version: int | None = None) -> IntervalStore:
        """Nothing but the description is read: the latest, or one of before that is still there."""
        place = cls._place(path, key)
        kept = Snapshots(spark, place)
        if version is not None and version not in kept.numbers():
            raise StoreError(f"no state {version} of a store at {place}")
        found = (version, kept.read(version)) if version is not None else kept.latest()
        if found is None:
            raise StoreError(f"no store at {place}")
        return cls(spark, place, *found)

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(self._meta["schema"])

    @property
    def bins(self) -> Bins:
        return Bins(**self._meta["bins"])

    @property
    def metadata(self) -> object:
        """What was given at creation; None if nothing was."""
        return self._meta["metadata"]

    @property
    def spread(self) -> overlap.Spread:
        """What joins need to know of the rows: the segments' own, measured when they were written."""
        some = [s["spread"] for s in self._meta["segments"] if s["spread"][0]]
        if not some:
            return overlap.Spread()
        return overlap.Spread(tuple(sorted({k for classes, _, _ in some for k in classes})), min(a for _, a, _ in some), max(b for _, _, b in some))

    def count(self) -> int:
        """All rows, as the description has it."""
        return sum(s["rows"] for s in self._meta["segments"])

    def _segments(self, kind: str) -> list[str]:
        return [f"{self.path}/{kind}/{_SEGMENT}={s['id']}" for s in self._meta["segments"]]

    def rows(self) -> DataFrame:
        return self._rows(self._segments("rows"))

    def _rows(self, places: list[str]) -> DataFrame:
        schema = self.schema
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*places).select(*schema.names)

    def bin_ranges(self) -> DataFrame:
        """The segments' tables of bins (`bin_index.SCHEMA`). An error where a segment has none: `build_index` makes it."""
        names = _indexes(self._meta["segments"])
        if len(names) < len(self._meta["segments"]):
            raise StoreError("the store has rows without an index")
        return self._ranges(names)

    def _ranges(self, names: list[str]) -> DataFrame:
        found = self.spark.read.schema(bin_index.SCHEMA).option("basePath", f"{self.path}/index").parquet(*(f"{self.path}/index/{_INDEX}={n}" for n in names))
        return found.drop(_INDEX)

    def _partials(self, kind: str) -> DataFrame:
        found = self.spark.read.schema(PARTIALS).option("basePath", f"{self.path}/partials").parquet(*self._segments("partials"))
        return found.where(F.col("kind") == kind)

    def bin_counts(self) -> DataFrame:
        """chrom, level, bin_id, n, touched, merged from the segments' partials: rows aren't read."""
        text = "interval does not fit the bin scheme: some rows are beyond its range"
        own = F.when(F.col("bin_id").isNull(), F.raise_error(F.lit(text)).cast("long")).otherwise(F.col("bin_id"))
        return self._partials("bins").groupBy("chrom", "level", own.alias("bin_id")).agg(F.sum("n").alias("n"), F.sum("touched").alias("touched"))

    def size_counts(self) -> DataFrame:
        """size, n, merged as bin_counts is."""
        return self._partials("sizes").groupBy("size").agg(F.sum("n").alias("n"))

    def files(self) -> DataFrame:
        """file, seq, first, past, classes: what lies where. A row for each file; kept with the opened store where there are few."""
        if self._files is None or self._files[0] != self.version:
            found = self._listed_files()
            if sum(s["files"] for s in self._meta["segments"]) <= layout.FEW_FILES:
                found = self.spark.createDataFrame(found.collect(), found.schema).coalesce(1)
            self._files = (self.version, found)
        return self._files[1]

    def _listed_files(self) -> DataFrame:
        bounds = F.collect_list(F.struct("class", "first", "past"))  # at most 64 a file
        return self._partials("files").groupBy("file", F.col("chrom").alias("seq")).agg(F.min("first").alias("first"), F.max("past").alias("past"), bounds.alias("classes"))

    def bin_summary(self) -> DataFrame:
        return stats.summary_of(self.bin_counts(), self.bins)

    def level_stats(self) -> DataFrame:
        return stats.levels_of(self.bin_counts(), self.bins)

    def size_stats(self) -> DataFrame:
        return stats.sizes_of(self.size_counts())

    def size_quantiles(self, quantiles: list[float]) -> DataFrame:
        return stats.quantiles_of(self.size_counts(), quantiles)

    def chrom(self, name: str) -> DataFrame:
        """One sequence, from its own files; empty where there is none of that name."""
        return self.rows().where(F.col("chrom") == name)

    def get_overlapping(self, chrom: str, start: int, end: int) -> DataFrame:
        return overlap.lookup(self.rows(), chrom, start, end)

    def seek(self, chrom: str, start: int, end: int) -> DataFrame:
        """As get_overlapping, by the table of bins: files in which it has nothing that may overlap are not opened, not even listed.

        Segments without an index are filtered, and all are where tasks can't open the store's files by themselves.
        """
        return self._seek(chrom, start, end)

    def bin_rows(self, chrom: str, bin_id: int) -> DataFrame:
        """The rows of one bin: those for which it is the finest that holds them. None where the scheme has no such bin."""
        for _, own, sh in self.bins.finest_first:
            if own <= bin_id < own + (self.bins.limit >> sh):
                return self._seek(chrom, (bin_id - own) << sh, (bin_id - own + 1) << sh, bin_id)
        return self._rows(self._segments("rows")).where("false")

    def _seek(self, chrom: str, start: int, end: int, bin_id: int | None = None) -> DataFrame:
        if end <= start:
            return self.get_overlapping(chrom, start, end)
        usable = layout.can_open(self.path)
        segments = [s for s in self._meta["segments"] if usable and s.get("index") and s["rows"]]
        others = [f"{self.path}/rows/{_SEGMENT}={s['id']}" for s in self._meta["segments"] if s not in segments]
        found = []
        if segments:
            reached = bin_index.reach(self._ranges(_indexes(segments)), self.bins, chrom, start, end, bin_id)
            found.append(bin_index.read(reached, sum(s["files"] for s in segments), self.schema, chrom, start, end))
        if others:
            found.append(overlap.lookup(self._rows(others), chrom, start, end))
        rows = reduce(DataFrame.union, found)
        return rows if bin_id is None else rows.where(self.bins.bin_of(F.col("start"), F.col("end")) == bin_id)

    def query(self, region: str) -> DataFrame:
        """`name:start-end`, 1-based and inclusive."""
        return self.get_overlapping(*parse_region(region))

    def _stored(self, regions: DataFrame, keep: dict[str, str], region_chrom: str, region_start: str, region_end: str, strict: bool) -> DataFrame:
        """Rows of overlapping pairs with region columns under other names, by `layout.stored_join`; by a shuffled join where tasks
        can't open the store's files by themselves."""
        n_files = sum(s["files"] for s in self._meta["segments"])
        if not n_files or regions.isStreaming or not layout.can_open(self.path):
            pairs, q = overlap._pairs(self.rows(), regions, self.bins, region_chrom=region_chrom, region_start=region_start, region_end=region_end, strict=strict, spread=self.spread)
            return pairs.select(*self.schema.names, *(F.col(f"`{q}{c}`").alias(name) for c, name in keep.items()))
        q = overlap._prefix(self.rows())
        own = overlap._regions(regions, q, region_start, region_end, strict)
        found = layout.stored_join(self.files(), n_files, self.schema, own, q=q, chrom=q + region_chrom, qs=q + region_start, qe=q + region_end, keep=[q + c for c in keep])
        return found.withColumnsRenamed({q + c: name for c, name in keep.items()})

    def query_regions(self, regions: DataFrame, *, region_chrom: str = "chrom", region_start: str = "qstart", region_end: str = "qend", strict: bool = True, order_by: str | None = None) -> DataFrame:
        """regions: chrom, qstart, qend. The rows that overlap, once for each region. Only files that regions reach are read, none is shuffled.

        order_by: a column of the regions (`qid` of `read_regions`) in whose order the rows come: of one region as an index walk
        gives them, finest bins first, and then by the store's columns, so that one region's rows may be several tasks'. Written as
        text, the order is that of the files (`ordered.numbered_lines`).
        """
        if order_by is None:
            return self._stored(regions.select(region_chrom, region_start, region_end), {}, region_chrom, region_start, region_end, strict)
        key = overlap._prefix(self.rows()) + "order"
        own = regions.select(region_chrom, region_start, region_end, F.col(f"`{order_by}`").alias(key))
        found = self._stored(own, {key: key}, region_chrom, region_start, region_end, strict)
        ties = [F.col(f"`{f.name}`") for f in self.schema.fields if isinstance(f.dataType, AtomicType) and f.name not in ("chrom", "start", "end")]
        return found.orderBy(key, *overlap.index_keys(self.bins), "chrom", "start", "end", *ties).select(*self.schema.names)

    def numbered_regions(self, regions: DataFrame, *, order_by: str, region_chrom: str = "chrom", region_start: str = "qstart", region_end: str = "qend", strict: bool = True) -> DataFrame:
        """What `query_regions(..., order_by=)` gives, with the number of each row in that order (line_no, from 0), in no order itself.

        The pairs are not sorted (`operators.lines`). Where regions share a key, or tasks can't open the store's files by themselves,
        they are.
        """
        repeated = regions.groupBy(F.col(f"`{order_by}`")).count().where("count > 1")
        if not self.count() or not layout.can_open(self.path) or not repeated.isEmpty():
            return lines.placed(self.query_regions(regions, region_chrom=region_chrom, region_start=region_start, region_end=region_end, strict=strict, order_by=order_by))
        q = overlap._prefix(self.rows())
        own = overlap._regions(regions, q, region_start, region_end, strict)
        return lines.numbered(self.rows(), self.bins, own, q + region_chrom, q + region_start, q + region_end, q + order_by)

    def join_regions(self, regions: DataFrame, *, region_chrom: str = "chrom", region_start: str = "qstart", region_end: str = "qend", strict: bool = True) -> DataFrame:
        """Pairs, with columns as overlap_join's."""
        called = overlap._named(self.schema.names, [c for c in regions.columns if c != region_chrom])
        return self._stored(regions, called, region_chrom, region_start, region_end, strict)

    def map_overlapping(self, chrom: str, start: int, end: int, function, schema: str) -> DataFrame:
        return overlap.map_overlapping(self.rows(), chrom, start, end, function, schema)

    def visit(self, chrom: str, start: int, end: int, function) -> int:
        """The function called with each overlapping row, as a dict; how many there were. It ends at the first failure (`operators.visit`)."""
        return visit(self.get_overlapping(chrom, start, end), function)

    def summary(self) -> str:
        return stats.summary_text(self.bin_summary(), self.bins)

    def report(self) -> str:
        return stats.report_text(self.bin_summary(), self.level_stats(), self.size_stats(), self.bins)


def pack(spark: SparkSession, source: str, output: str | None = None, *, bins: Bins | str = "dense", comment: str = "#", one_based: bool = False, force: bool = False) -> IntervalStore:
    """From a file of intervals to a store. force replaces a store that is there, with all its files."""
    from .bed import read_bed, read_bed_sniffed

    if isinstance(bins, str) and bins.lower() not in PRESETS:
        raise IntervalError(f"no bin scheme {bins!r}")
    # gzip may be of blocks, which many tasks can read
    read = read_bed_sniffed if source.endswith(("gz", ".bgzf")) and layout.can_open(source) else read_bed
    return IntervalStore.create(read(spark, source, comment, one_based), output or default_output(source), bins=bins, overwrite=force)
