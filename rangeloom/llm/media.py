"""Media columns: content-addressed payloads in tar shards.

A payload is the text's UTF-8 bytes, padded by spaces to a positive multiple of 192, kept as an 8-bit grey PNG of 192
samples a row (filter 0, deflate). Each task writes the distinct payloads of its partition to a tar shard in the
shared folder, named by digest, and its rows carry digest, shard, offset and length of the stored bytes. A payload
written by several tasks is resolved to one place: the index keeps the first (shard, offset) of each digest, and all
rows refer to it. Metadata columns (width, height, bit depth, colour type) of the index come from range reads of a
member's first 33 bytes, shard by shard. Stored bytes are then read back in (shard, offset) order, each distinct payload once.

A shard's name has the task attempt in it and only the rows of attempts that succeeded name their shard, so a lost
executor or a second attempt leaves at most unused files. The index is written before it is used.

Defined results: a null text counts as empty, that is one row of 192 spaces; equal texts have equal values; a null
doc_id is carried along; an empty table gives no rows and no shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, utf8, written

ROW = 192
HEADER = 33  # signature and IHDR
LEVEL = 4
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % ROW or (0 if raw else ROW))


def encode(payload: bytes) -> bytes:
    """A PNG of the payload's bytes as samples."""
    height = len(payload) // ROW
    lines = np.zeros((height, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0))
    return _SIGNATURE + head + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth, colour type from a member's first bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", first[16:26])


def decode(stored: bytes) -> bytes:
    width, height, depth, colour = header(stored)
    if (depth, colour) != (8, 0):
        raise ValueError("not 8-bit grey")
    data, at = b"", 8
    while at < len(stored):
        (n,) = struct.unpack(">I", stored[at : at + 4])
        if stored[at + 4 : at + 8] == b"IDAT":
            data += stored[at + 8 : at + 8 + n]
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not expected")
    return lines[:, 1:].tobytes()


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


PLACED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write tar shards; per document: doc_id, n_bytes, digest, and the place of the payload that its task stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = tar = name = None
        places: dict[str, tuple[int, int]] = {}
        try:
            for b in batches:
                rows: list[tuple] = []
                for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    payload = pad(raw)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in places:
                        if tar is None:
                            fsys, base = filesystem(folder)
                            fsys.create_dir(base, recursive=True)
                            name = f"media-{uuid.uuid4().hex}.tar"
                            sink = fsys.open_output_stream(f"{base}/{name}")
                            tar = tarfile.open(fileobj=sink, mode="w|", format=tarfile.USTAR_FORMAT)
                        media = encode(payload)
                        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
                        info.size = len(media)
                        places[digest] = (tar.offset + 512, len(media))
                        tar.addfile(info, io.BytesIO(media))
                    rows.append((doc_id, len(raw), digest, name, *places[digest]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[f.split()[0] for f in PLACED.split(", ")])
        finally:
            if tar is not None:
                tar.close()
                sink.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("raw")).mapInArrow(run, PLACED)


READ = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(payload: bytes) -> str:
    """Mean, spread and sixteen-bin histogram of the samples, in whole numbers."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    total = int(x.sum(dtype=np.int64))
    square = int((x.astype(np.int64) ** 2).sum())
    return f"{total * 1000 // len(x)}:{(square * len(x) - total * total) // (len(x) * len(x))}:" + ".".join(map(str, (bins * 1000 // len(x)).tolist()))


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """For each row of the index (digest, shard, offset, length): what the stored bytes say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = source = None
        fsys, base = filesystem(folder)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["shard"] != shard:
                    if source is not None:
                        source.close()
                    shard = r["shard"]
                    source = fsys.open_input_file(f"{base}/{shard}")
                media = source.read_at(r["length"], r["offset"])
                payload = decode(media)
                if hashlib.sha256(payload).hexdigest() != r["digest"]:
                    raise ValueError(f"stored bytes of {r['digest']} are damaged")
                rows.append((r["digest"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in READ.split(", ")])
        if source is not None:
            source.close()

    return index.select("digest", "shard", "offset", "length").mapInArrow(run, READ)


def metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index (digest, shard, offset, length; rows of a shard together) with width, height, bit depth and colour type, from
    header-only range reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = source = None
        fsys, base = filesystem(folder)
        for b in batches:
            found = []
            for name, at, length in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if name != shard:
                    if source is not None:
                        source.close()
                    shard, source = name, fsys.open_input_file(f"{base}/{name}")
                found.append(header(source.read_at(min(HEADER, length), at)))
            if found:
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int32()) for c in zip(*found, strict=True))], names=["digest", "shard", "offset", "length", "width", "height", "bit_depth", "colour_type"])
        if source is not None:
            source.close()

    return index.select("digest", "shard", "offset", "length").mapInArrow(run, "digest string, shard string, offset long, length long, width int, height int, bit_depth int, colour_type int")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store every text, read it back, and return a row for each document."""
    folder = folder or scratch(docs.sparkSession, "media")
    placed = written(store(docs, folder), "media-rows")
    first = F.min(F.struct("shard", "offset", "length")).alias("at")
    places = placed.groupBy("digest").agg(first).select("digest", "at.*")
    # range partitions keep a shard's members together and in order, in the index's files too
    index = written(metadata(places.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset"), folder), "media-index")
    found = read_back(index, folder).join(index, "digest")
    return placed.select("doc_id", "n_bytes", "digest").join(found, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", "colour_type", "digest", "shard", "offset", "length"
    )
