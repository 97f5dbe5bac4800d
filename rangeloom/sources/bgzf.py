"""Block gzip: gzip files of members of at most 64 KB that say how long they are, read and written by many tasks.

A file is cut into splits of `SPLIT` compressed bytes. A task looks for the first member that begins in its split (by the header's
fixed bytes, and by another member, or the file's end, where the header says that this one ends), inflates member after member, each
checked by its CRC, and stops at the first that begins past its split. Lines are cut by members anywhere, so, as with plain text, a
task leaves what stands before its first line feed to the one before it, and reads on to the line feed that ends its last line.
Whether each split began where the one before it stopped is compared over all tasks; where a place only looked like a member (as
stored text can), a walk over the file's headers finds the true ones, and a broken file fails the query instead of losing lines.

A plain gzip file has no such members and is one stream; `is_block_gzip` tells by its first bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = 32 << 20
#: Bytes that are read at once, and of lines that are handed on together.
READ, HANDED = 4 << 20, 4 << 20
#: Most text of a member when writing.
MEMBER = 0xFF00
# Fixed values of the format: a header's first bytes, the subfield with the member's size, and the empty member that ends a file.
_MAGIC = b"\x1f\x8b\x08\x04"
_SIZE_FIELD = b"BC\x02\x00"
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_HEAD = 12


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


def _member_size(data: bytes | memoryview, at: int = 0) -> int | None:
    """Bytes of the member whose header stands there; None if none does, 0 if too little is there to tell."""
    head = bytes(data[at : at + _HEAD])
    if head[:4] != _MAGIC[: len(head)]:
        return None
    if len(head) < _HEAD:
        return 0
    extra = bytes(data[at + _HEAD : at + _HEAD + (n := struct.unpack_from("<H", head, 10)[0])])
    if len(extra) < n:
        return 0
    while len(extra) >= 4:
        size = struct.unpack_from("<H", extra, 2)[0]
        if extra[:4] == _SIZE_FIELD and len(extra) >= 6:
            total = struct.unpack_from("<H", extra, 4)[0] + 1
            return total if total >= _HEAD + n + 8 else None
        extra = extra[4 + size :]
    return None


def is_block_gzip(first: bytes) -> bool:
    """Whether a file that begins so, with 64 bytes or all it has, is of such members."""
    return bool(_member_size(first))


def inflate(member: bytes) -> bytes:
    n = struct.unpack_from("<H", member, 10)[0]
    text = zlib.decompress(member[_HEAD + n : -8], -15)
    crc, size = struct.unpack("<II", member[-8:])
    if zlib.crc32(text) != crc or len(text) != size:
        raise ValueError("a gzip member is broken: its checksum or size is wrong")
    return text


def deflate(text: bytes, level: int = 6) -> bytes:
    """One member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    size = _HEAD + 6 + len(body) + 8
    return _MAGIC + b"\0\0\0\0\0\xff" + struct.pack("<H", 6) + _SIZE_FIELD + struct.pack("<H", size - 1) + body + struct.pack("<II", zlib.crc32(text), len(text))


class _Members:
    """The members of an opened file from the first that begins at or after a place."""

    def __init__(self, source, at: int, length: int, known: bool = False):
        """known: a member begins at that very place."""
        self.source, self.length = source, length
        self.base, self.data = at, b""  # what is held, and where it stands in the file
        self.at: int | None = at if known or at == 0 else self._find()  # where the next member begins; None: there is none

    def _hold(self, at: int, n: int) -> memoryview:
        """n bytes of the file from a place, or what there is of them."""
        if not (self.base <= at and at + n <= self.base + len(self.data)):
            self.base, self.data = at, self.source.read_at(min(max(n, READ), max(self.length - at, 0)), at)
        return memoryview(self.data)[at - self.base : at - self.base + n]

    def _find(self) -> int | None:
        at = self.base
        while at < self.length:
            window = bytes(self._hold(at, 1 << 17))
            place = window.find(_MAGIC)
            while place >= 0:
                if self._is_member(at + place):
                    return at + place
                place = window.find(_MAGIC, place + 1)
            at += max(1, len(window) - len(_MAGIC) + 1)
        return None

    def _is_member(self, at: int) -> bool:
        size = _member_size(self._hold(at, 1 << 16))
        if not size or at + size > self.length:
            return False
        return at + size == self.length or bool(_member_size(self._hold(at + size, 1 << 16)))

    def next(self) -> bytes | None:
        """The next member's text; None at the end."""
        if self.at is None or self.at >= self.length:
            return None
        size = _member_size(self._hold(self.at, 1 << 16))
        if not size or self.at + size > self.length:
            raise ValueError(f"no whole gzip member at byte {self.at}")
        text = inflate(bytes(self._hold(self.at, size)))
        self.at += size
        return text


def _lines(members: _Members, end: int, whole: bool) -> Iterator[bytes]:
    """Text of whole lines: those that begin in the split, as far as the rule above gives them to it. whole: from the file's first byte."""
    held: list[bytes] = []
    size = 0
    skipping = not whole
    while members.at < min(end, members.length):
        text = members.next()
        if skipping:
            cut = text.find(b"\n")
            if cut < 0:
                continue
            text, skipping = text[cut + 1 :], False
        held.append(text)
        size += len(text)
        if size >= HANDED and b"\n" in text:
            data = b"".join(held)
            cut = data.rfind(b"\n") + 1
            yield data[:cut]
            held, size = [data[cut:]], len(data) - cut
    if skipping:  # no line begins here
        return
    while (text := members.next()) is not None:
        cut = text.find(b"\n")
        held.append(text if cut < 0 else text[: cut + 1])
        if cut >= 0:
            break
    if data := b"".join(held):
        yield data


_PLACES = "path string, at long, first long, past long"


def _places(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "at", "first", "past"])


def read_lines(spark: SparkSession, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """value: the lines of block-gzip files (columns path and length), by as many tasks as there are splits."""
    splits = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("at"))
    n = max(1, splits.count())
    dealt = splits.repartition(n, "path", "at")

    def begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the first member of each split begins, by its header alone, and where a walk over headers leaves it."""
        for b in batches:
            rows = []
            for path, length, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, place = _system(path)
                with system.open_input_file(place) as source:
                    members = _Members(source, at, length)
                    first = members.at if members.at is not None and members.at < at + split else None
                    here = first
                    while here is not None and here < min(at + split, length):
                        size = _member_size(members._hold(here, 1 << 16))
                        here = here + size if size else None
                rows.append((path, at, first, here))
            yield _places(rows)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same of whole files, from header to header."""
        for b in batches:
            for path, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, here = [], 0
                system, place = _system(path)
                with system.open_input_file(place) as source:
                    members = _Members(source, 0, length)
                    while here < length:
                        size = _member_size(members._hold(here, 1 << 16))
                        if not size or here + size > length:
                            raise ValueError(f"{path}: no whole gzip member at byte {here}")
                        if not rows or here >= rows[-1][1] + split:
                            rows.append((path, here // split * split, here, None))
                        here += size
                for i in range(0, len(rows), 10_000):
                    yield _places(rows[i : i + 10_000])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, at, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, place = _system(path)
                with system.open_input_file(place) as source:
                    for data in _lines(_Members(source, first, length, known=True), at + split, first == 0):
                        text = data[:-1] if data.endswith(b"\n") else data
                        yield pa.RecordBatch.from_arrays([pa.array(text.decode("utf-8", "replace").split("\n"), pa.string())], names=["value"])

    # a row for each split: where it begins must be where the one before it, or one further back, ended
    found = dealt.mapInArrow(begins, _PLACES).collect()
    lengths = {r.path: r.length for r in files.collect()}
    ends, wrong = dict.fromkeys(lengths, 0), set()
    for r in sorted(found, key=lambda r: (r.path, r.at)):
        if r.first is not None:
            if r.first != ends[r.path] or r.past is None:
                wrong.add(r.path)
            ends[r.path] = r.past
    wrong |= {path for path, length in lengths.items() if ends[path] != length}
    if wrong:
        again = spark.createDataFrame([(p, lengths[p]) for p in sorted(wrong)], "path string, length long").repartition(len(wrong), "path")
        found = [r for r in found if r.path not in wrong] + again.mapInArrow(walk, _PLACES).collect()
    known = [(r.path, lengths[r.path], r.at, r.first) for r in found if r.first is not None]
    if not known:
        return spark.createDataFrame([], "value string")
    return spark.createDataFrame(known, "path string, length long, at long, first long").repartition(len(known), "path", "at").mapInArrow(lines, "value string")


def write_lines(lines: DataFrame, path: str, suffix: str = ".bed.gz", mode: str = "errorifexists") -> None:
    """Lines (column value) as a folder of block-gzip files, one for each partition, in their order.

    Tasks write under names of their own; what succeeded is renamed when all are done, so repeated attempts leave nothing behind.
    """
    spark = lines.sparkSession
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at):
        if mode == "errorifexists":
            raise FileExistsError(f"there is something at {path}")
        files.delete(at, True)
    beside = f"{path.rstrip('/')}/_temporary-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, place = _system(beside)
        system.create_dir(place, recursive=True)
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{place}/{name}") as sink:
            held = bytearray()
            for b in batches:
                for i in range(0, b.num_rows, 1000):
                    held += "".join(f"{x}\n" for x in b.column(0).slice(i, 1000).to_pylist()).encode()
                    done = 0
                    while len(held) - done >= MEMBER:
                        sink.write(deflate(bytes(held[done : done + MEMBER])))
                        done += MEMBER
                    del held[:done]
            if held:
                sink.write(deflate(bytes(held)))
            sink.write(_END)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name])], names=["part", "name"])

    try:
        files.mkdirs(jvm.org.apache.hadoop.fs.Path(beside))
        for r in lines.select("value").mapInArrow(run, "part int, name string").collect():  # a row for each file
            files.rename(jvm.org.apache.hadoop.fs.Path(f"{beside}/{r.name}"), jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/part-{r.part:05d}{suffix}"))
    finally:
        files.delete(jvm.org.apache.hadoop.fs.Path(beside), True)
