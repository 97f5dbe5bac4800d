"""Overlap join on files that are sorted: regions go to the files, the files' rows go nowhere.

Rows of a store lie in files, each of one sequence and sorted by start, of which the store knows where the rows of each class of
length begin and end. Regions are joined with that table, a row for each file that may hold what overlaps, dealt out by file, and
swept over the files: a task opens its files, skips row groups that no region of its reaches, and finds by binary search which runs
of rows and regions overlap, of which Spark makes the pairs. Stored rows are neither shuffled nor sorted, files that no region reaches
are not opened, and no task holds more than a batch of rows and `HELD` regions.

Regions are dealt out by ranges of (file, start), as many to each task, so that where many regions reach one file several tasks read
it, each for its part of the regions. Tasks are numbered by the regions, not by their bytes, since what a region makes grows with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import overlap, sweep

#: File systems that tasks can open by themselves.
SCHEMES = ("", "file", "hdfs", "s3", "gs")
#: So many files are broadcast; more are joined as features of their own.
FEW_FILES = 4096
#: Regions of a file that are swept at once, and rows of a batch.
HELD, BATCH = 1 << 18, 1 << 16
#: Regions of a task, each counted for every file that it reaches.
DEALT = 1 << 14
#: Of a block, most of the side whose runs it holds, and most of the side that they are runs of.
ONES, CANDIDATES = 64, 1 << 12


def can_open(path: str) -> bool:
    return urlparse(path).scheme in SCHEMES


def _open(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def reached(files: DataFrame, n_files: int, regions: DataFrame, chrom: str, qs: str, qe: str) -> DataFrame:
    """Regions with the files that may hold what overlaps. files: file, seq, first, past, classes (of structs first, past)."""
    hit = F.exists("classes", lambda c: (c["first"] < F.col(qe)) & (c["past"] > F.col(qs)))
    if n_files <= FEW_FILES:
        on = (F.col("seq") == F.col(chrom)) & (F.col("first") < F.col(qe)) & (F.col("past") > F.col(qs))
        found = regions.join(F.broadcast(files), on)
    else:
        spread = overlap.measure(files, "first", "past")
        found = overlap.overlap_join(files, regions, chrom="seq", start="first", end="past", region_chrom=chrom, region_start=qs, region_end=qe, spread=spread)
        found = found.withColumn(chrom, F.col("seq"))
    return found.where(hit).select("file", *regions.columns)


def may_hold(group, names: list[str], qs, qe) -> bool:
    """Whether a row group's least start and greatest end leave room for an overlap with any of the regions."""
    s, e = (group.column(names.index(c)).statistics for c in ("start", "end"))
    known = s is not None and e is not None and s.has_min_max and e.has_min_max
    return not known or bool(np.any((qs < e.max) & (qe > s.min)))


def _classes(lengths: np.ndarray) -> np.ndarray:
    """log2 of each length, rounded up."""
    return np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)


def _runs(lo: np.ndarray, hi: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, np.ndarray, np.ndarray]]:
    """Places whose run [lo, hi) of the other side isn't empty, at most `ONES` of one class of length at a time, with a window of at
    most `CANDIDATES` of the other side, and where in the window each one's part of its run begins and how long it is."""
    some = np.flatnonzero(hi > lo)
    k = _classes(lengths[some])
    for own in np.unique(k):
        at = some[k == own]
        for i in range(0, len(at), ONES):
            ones = at[i : i + ONES]
            a, b = lo[ones], hi[ones]
            for first in range(int(a.min()), int(b.max()), CANDIDATES):
                past = min(first + CANDIDATES, int(b.max()))
                begin, n = np.maximum(a, first) - first, np.minimum(b, past) - np.maximum(a, first)
                if (held := n > 0).any():
                    yield ones[held], first, past, begin[held], n[held]


def blocks(s: np.ndarray, e: np.ndarray, qs: np.ndarray, qe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of some rows, of some regions, and links (a, m, b, n): m rows from a on among these rows overlap n regions from b on
    among these regions. Both sides are sorted by start.

    Of two that overlap either the region begins within the row or the row within the region, behind its start. The first are, for a row,
    a run of the regions, the others, for a region, a run of the rows. So a link says of many pairs that they overlap, and no pair
    is looked at.
    """
    for ones, first, past, begin, n in _runs(np.searchsorted(qs, s, "left"), np.searchsorted(qs, e, "left"), e - s):
        yield ones, np.arange(first, past), np.stack([np.arange(len(ones)), np.ones_like(n), begin, n])
    for ones, first, past, begin, n in _runs(np.searchsorted(s, qs, "right"), np.searchsorted(s, qe, "left"), qe - qs):
        yield np.arange(first, past), ones, np.stack([begin, n, np.arange(len(ones)), np.ones_like(n)])


def matches(s: np.ndarray, e: np.ndarray, qs: np.ndarray, qe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows (sorted by start) and of regions that overlap: the pairs of `blocks`, as Spark makes them (`_expanded`)."""
    order = np.argsort(qs, kind="stable")
    for rows, regions, links in blocks(s, e, qs[order], qe[order]):
        for a, m, b, n in links.T:
            yield np.repeat(rows[a : a + m], n), np.tile(order[regions[b : b + n]], m)


def tallies(s: np.ndarray, e: np.ndarray, qs: np.ndarray, qe: np.ndarray) -> np.ndarray:
    """How many regions overlap each row: those that begin before its end, less those that end by its start."""
    return np.searchsorted(np.sort(qs), e, "left") - np.searchsorted(np.sort(qe), s, "right")


def _sweep(path: str, own: pa.Table, columns: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Of one file: rows sorted by start, their starts and ends, and the places of the regions (columns 0 and 1: start and end) near them."""
    import pyarrow.parquet as pq

    qs, qe = (own.column(i).to_numpy() for i in (0, 1))
    with _open(path) as source:
        file = pq.ParquetFile(source)
        names = file.schema_arrow.names
        for g in range(file.num_row_groups):
            if not may_hold(file.metadata.row_group(g), names, qs, qe):
                continue
            for rows in file.iter_batches(BATCH, row_groups=[g], columns=columns):
                s, e = (rows.column(c).to_numpy() for c in ("start", "end"))
                if (np.diff(s) < 0).any():
                    order = np.argsort(s, kind="stable")
                    rows, s, e = rows.take(pa.array(order)), s[order], e[order]
                near = np.flatnonzero((qe > s[0]) & (qs < e.max())) if len(s) else ()
                if len(near):
                    yield rows, s, e, near


def _lists(held: list[np.ndarray], source: pa.RecordBatch, fields: pa.StructType) -> pa.ListArray:
    """For each array of places the source's rows there, as structs of the fields."""
    some = source.take(pa.array(np.concatenate(held)))
    columns = [c.cast(f.type) if c.type != f.type else c for c, f in zip((some.column(f.name) for f in fields), fields, strict=True)]
    return pa.ListArray.from_arrays(pa.array(_offsets(held)), pa.StructArray.from_arrays(columns, fields=list(fields)))


def _offsets(held: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([x.shape[-1] for x in held])]).astype(np.int32)


def _packed(name: pa.Scalar, rows: pa.RecordBatch, regions: pa.RecordBatch, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks as rows of lists (chrom, rows, regions, links), some at a time."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        at, asked, links = (list(x) for x in zip(*held, strict=True))
        numbers = [pa.array(x.astype(np.int32)) for x in np.concatenate(links, axis=1)]
        linked = pa.ListArray.from_arrays(pa.array(_offsets(links)), pa.StructArray.from_arrays(numbers, fields=list(arrow.field(3).type.value_type)))
        lists = [_lists(at, rows, arrow.field(1).type.value_type), _lists(asked, regions, arrow.field(2).type.value_type), linked]
        return pa.RecordBatch.from_arrays([pa.repeat(name, len(held)).cast(arrow.field(0).type), *(x.cast(f.type) for x, f in zip(lists, list(arrow)[1:], strict=True))], schema=arrow)

    for block in found:
        held.append(block)
        size += sum(x.shape[-1] for x in block)
        if size >= BATCH:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _expanded(packed: DataFrame, q: str, chrom: str, columns: list[str]) -> DataFrame:
    """The pairs of the links, made by Spark."""
    rows, regions, links = (f"{q}_{x}" for x in ("rows", "regions", "links"))
    a, m, b, n = (F.col(f"{q}_{x}") for x in "amrn")
    linked = packed.select(chrom, rows, regions, F.inline(links))
    parts = linked.select(chrom, F.slice(rows, a + 1, m).alias(rows), F.slice(regions, b + 1, n).alias(regions))
    # no list is empty, and outer generators are not filtered by their sizes before
    return parts.select(chrom, regions, F.inline_outer(rows)).select("*", F.inline_outer(regions)).select(*(F.col(f"`{c}`") for c in columns))


def stored_join(files: DataFrame, n_files: int, schema: StructType, regions: DataFrame, *, q: str, chrom: str, qs: str, qe: str, keep: list[str]) -> DataFrame:
    """The stored rows (schema) of each overlapping pair with the regions' columns to keep. regions: checked, columns prefixed by q.

    Tasks give blocks of rows and regions with the runs of them that overlap, and Spark makes the pairs. Where no column of the regions
    is to be kept, they give each row once with the number of its regions, and Spark repeats it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    bounds = [F.col(c).cast("long").alias(n) for c, n in ((qs, f"{q}_s"), (qe, f"{q}_e"))]
    found = reached(files, n_files, regions, chrom, qs, qe).select("file", F.col(chrom).alias(f"{q}_chrom"), *bounds, *keep)
    dealt = overlap._by_place(found, max(1, math.ceil(found.count() / DEALT)), "file", f"{q}_s")
    tally = not keep
    own = [f for f in schema.fields if f.name != "chrom"]
    if tally:
        out = StructType([*schema.fields, StructField(f"{q}_n", LongType())])
    else:
        lists = {"rows": own, "regions": [found.schema[c] for c in keep], "links": [StructField(f"{q}_{x}", IntegerType(), False) for x in "amrn"]}
        out = StructType([schema["chrom"], *(StructField(f"{q}_{name}", ArrayType(StructType(fields), False), False) for name, fields in lists.items())])
    arrow, stored = to_arrow_schema(out), [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held, size = None, [], 0

        def swept() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            whole = pa.Table.from_batches(held)
            name, own = whole.column(1)[0], whole.select(range(2, whole.num_columns)).combine_chunks()
            qs, qe = (own.column(i).to_numpy() for i in (0, 1))
            carried = None if tally else own.select(range(2, own.num_columns)).to_batches()[0]
            for rows, s, e, near in _sweep(path, own, stored):
                if tally:
                    n = tallies(s, e, qs[near], qe[near])
                    hit = np.flatnonzero(n)
                    some = rows.take(pa.array(hit))
                    columns = [*(pa.repeat(name, some.num_rows) if f.name == "chrom" else some.column(f.name) for f in schema.fields), pa.array(n[hit])]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                else:
                    linked = ((at, near[asked], links) for at, asked, links in blocks(s, e, qs[near], qe[near]))
                    yield from _packed(name, rows, carried, linked, arrow)

        for b in batches:
            names = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if names[lo] != path or size >= HELD:
                    yield from swept()
                    path, held, size = names[lo], [], 0
                held.append(b.slice(lo, hi - lo))
                size += hi - lo
        yield from swept()

    joined = dealt.mapInArrow(run, out)
    if not tally:
        return _expanded(joined, q, "chrom", [*schema.names, *keep])
    return sweep.repeated(joined.select(F.struct(*(F.col(f"`{c}`") for c in schema.names)).alias("row"), F.col(f"`{q}_n`").alias("n")))
