"""Training-order materialisation: token sequences in fixed-stride binary shards.

1. Documents are encoded where they are read; their tokens, with an end token after each document, are one stream, in the
   order of the files by path and of the rows in them (input that isn't a scan of files, or was shuffled since: as Spark's
   partitions have it). A task writes the tokens of its runs of rows once, compressed, in chunks.
2. Prefix sums over one row per run - a run is what is left of a file's split after any filters - give every chunk its
   place in the stream, and so the sequences of `length` tokens that it holds whole or in part. How the files were split
   changes the runs but neither the stream nor its sequences.
3. A keyed Feistel network on the next even power of two, walked along its cycle until it falls below N, permutes the
   sequences: a sequence's slot in training order, known without a sort and invertible.
4. Pieces of sequences are dealt out by shard (slot // records of a shard), a task for each, or for some neighbours where there are
   more than `WRITERS`, sorted, put together, and written as records of one stride: record r of a shard is at byte r * stride, so a
   reader goes on from any slot by one seek. A shard's content depends on its slots alone. It is written under a name of the
   attempt's own and renamed when it is whole, so attempts at once, or one that is killed, leave whole shards behind.

Defined results: a null text counts as empty and gives one end token; the last sequence is filled up by end tokens
that n_tokens doesn't count; equal texts are kept as often as they come; a null doc_id is listed as null; rows of a
document that follow each other are listed once in a sequence; an empty table gives no sequences and no shards; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder, forget, vocabulary_path
from .common import scratch, text_or_empty, written
from .media import filesystem

LENGTH = 2048
#: Tokens of a chunk, about.
CHUNK = 1 << 15
#: About the bytes that a worker's encoder may remember while it does nothing else.
MEMO_BYTES = 448 << 20
SHARD_BYTES = 32 << 20
#: Most tasks that write shards.
WRITERS = 20_000
END_TOKEN = "<|endoftext|>"
HEAD = 4  # bytes of a record's count of tokens
KEY = 0x5EED
ROUNDS = 6


def _round(half: np.ndarray, key: int, number: int) -> np.ndarray:
    """A mixing function of 64-bit integers (multiply, shift, xor)."""
    x = half + np.uint64((key * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _pass(x: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ (_round(left, key, r) & mask), left
        else:
            left, right = right, left ^ (_round(right, key, r) & mask)
    return (left << shift) | right


def permute(index: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slot of each index below n (back: the index of each slot)."""
    bits = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    with np.errstate(over="ignore"):
        x = _pass(np.asarray(index, np.uint64), bits, key, back)
        while (outside := x >= n).any():
            x[outside] = _pass(x[outside], bits, key, back)
    return x.astype(np.int64)


def _packer(level: int = 3):
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress


def _unpacker():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


CHUNKS = "file string, first long, start long, n_tokens int, doc_ids array<long>, doc_ends array<int>, payload binary"
_CHUNKS = pa.schema([("file", pa.string()), ("first", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int32())), ("payload", pa.binary())])


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, file, block, row: where a row stands among all, and where the split begins that it was read in."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")]
    try:
        return docs.select(*own, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.row_index").cast("long").alias("row"))
    except AnalysisException:  # not a scan of files that number their rows
        return docs.select(*own, F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("row"))


def chunks(docs: DataFrame, chunk: int = CHUNK, path: str | None = None) -> DataFrame:
    """The tokens of each run of rows, in chunks: the run (file and first row), tokens of the run before the chunk, the documents
    in it and where their tokens end, counted from the chunk's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.get(path or vocabulary_path())
        enc.most = MEMO_BYTES
        kind = np.dtype(f"<u{token_width(len(enc.pieces))}")
        end = np.asarray([enc.tok.token_to_id(END_TOKEN)], kind)
        pack = _packer()
        at = split = last = None  # the run, its file and split, and the row before
        start = held = 0
        parts: list[np.ndarray] = []
        ids: list = []
        ends: list[int] = []

        def cut() -> tuple:
            nonlocal start, held, parts, ids, ends
            row = (*at, start, held, ids, ends, pack(np.concatenate(parts).tobytes()))
            start, held, parts, ids, ends = start + held, 0, [], [], []
            return row

        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                rows = []
                coded = enc.encode_many(b.column("text").to_pylist())
                for doc, file, block, row, c in zip(*(b.column(x).to_pylist() for x in ("doc_id", "file", "block", "row")), coded, strict=True):
                    if (file, block) != split or row < last:
                        if held:
                            rows.append(cut())
                        split, at, start = (file, block), (file, row), 0
                    last = row
                    tokens = np.concatenate([np.frombuffer(c, "<u4").astype(kind), end])
                    while len(tokens):
                        take = tokens[: chunk - held]
                        tokens = tokens[len(take) :]
                        held += len(take)
                        parts.append(take)
                        ids.append(doc)
                        ends.append(held)
                        if held == chunk:
                            rows.append(cut())
                if rows:
                    yield _batch(rows, _CHUNKS)
        if held:
            yield _batch([cut()], _CHUNKS)

    return _in_order(docs).mapInArrow(run, CHUNKS)


def token_width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


PIECES = "slot long, shard int, at int, n_tokens int, doc_ids array<long>, payload binary"
_PIECES = pa.schema([("slot", pa.int64()), ("shard", pa.int32()), ("at", pa.int32()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])


def pieces(rows: DataFrame, length: int, width: int, per: int, key: int = KEY) -> tuple[DataFrame, int]:
    """From written chunks: what each holds of a sequence, with the sequence's slot and shard; and how many sequences there are."""
    runs = rows.groupBy("file", "first").agg(F.sum("n_tokens").alias("n"))  # a row for each run
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select("file", "first", "n", before.alias("before")), "token-runs")
    n = -(-int(runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        pack, unpack = _packer(), _unpacker()
        for whole in batches:
            for i in range(0, whole.num_rows, 16):
                out = []
                for r in whole.slice(i, 16).to_pylist():
                    data, ends = unpack(r["payload"]), np.asarray(r["doc_ends"], np.int64)
                    a, z = r["place"], r["place"] + r["n_tokens"]
                    sequences = np.arange(a // length, (z - 1) // length + 1)
                    for s, slot in zip(sequences.tolist(), permute(sequences, n, key).tolist(), strict=True):
                        lo, hi = max(a, s * length), min(z, (s + 1) * length)
                        first, last = np.searchsorted(ends, lo - a, "right"), np.searchsorted(ends, hi - a, "left")
                        out.append((slot, slot // per, lo - s * length, hi - lo, r["doc_ids"][first : last + 1], pack(data[(lo - a) * width : (hi - a) * width])))
                yield _batch(out, _PIECES)

    placed = rows.join(runs.select("file", "first", "before"), ["file", "first"])
    placed = placed.select((F.col("before") + F.col("start")).alias("place"), "n_tokens", "doc_ids", "doc_ends", "payload")
    return placed.mapInArrow(run, PIECES), n


def records(length: int, width: int, shard_bytes: int) -> tuple[int, int]:
    """Stride, and records of a shard."""
    stride = HEAD + length * width
    return stride, max(1, shard_bytes // stride)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


RECORDS = "slot long, shard int, offset long, n_tokens int, doc_ids array<long>"
_RECORDS = pa.schema([("slot", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64()))])


def shard_writer(folder: str, length: int, width: int, end: int, shard_bytes: int = SHARD_BYTES):
    """What a task does with the sorted pieces (slot, at, n_tokens, doc_ids, payload) of its shards."""
    stride, per = records(length, width, shard_bytes)
    fill = np.full(length, end, f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        unpack = _unpacker()
        fsys, base = filesystem(folder)
        sink, shard, count, beside = None, None, 0, ""
        held: list[tuple] = []  # the pieces of one slot

        def finish() -> None:
            if sink is not None:
                sink.close()
                fsys.move(beside, f"{base}/{shard_name(shard)}")

        def record() -> tuple:
            nonlocal sink, shard, count, beside
            slot = held[0][0]
            if slot // per != shard:
                finish()
                shard, count = slot // per, 0
                fsys.create_dir(base, recursive=True)
                beside = f"{base}/.{shard_name(shard)}-{uuid.uuid4().hex}"
                sink = fsys.open_output_stream(beside, buffer_size=1 << 20)
            if slot != shard * per + count:
                raise ValueError(f"slot {shard * per + count} is missing")
            tokens, docs = 0, []
            for _, at, k, ids, _ in held:
                if at != tokens:
                    raise ValueError(f"slot {slot} has a gap at token {tokens}")
                tokens += k
                docs += ids[1:] if docs and ids and docs[-1] == ids[0] else ids
            data = b"".join(unpack(p[-1]) for p in held)
            sink.write(struct.pack("<I", tokens) + data + fill[len(data) :])
            count += 1
            return (slot, shard, (count - 1) * stride, tokens, docs)

        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out.append(record())
                    held = []
                held.append(row)
            if out:
                yield _batch(out, _RECORDS)
        last = record() if held else None
        finish()
        if last:
            yield _batch([last], _RECORDS)

    return run


def write_shards(placed: DataFrame, folder: str, n: int, length: int, width: int, end: int, shard_bytes: int = SHARD_BYTES, writers: int = WRITERS) -> DataFrame:
    """Write all shards; a row for each record. end: the token that fills up the last sequence."""
    shards = max(1, -(-n // records(length, width, shard_bytes)[1]))
    each = -(-shards // writers)
    dealt = placed.repartitionById(-(-shards // each), F.expr(f"shard div {each}").cast("int")).sortWithinPartitions("slot", "at")
    return dealt.select("slot", "at", "n_tokens", "doc_ids", "payload").mapInArrow(shard_writer(folder, length, width, end, shard_bytes), RECORDS)


def read_slots(folder: str, first: int, count: int, length: int, width: int, shard_bytes: int = SHARD_BYTES) -> Iterator[tuple[int, bytes]]:
    """Sequential read from any slot: n_tokens and the ids' bytes of each record."""
    stride, per = records(length, width, shard_bytes)
    fsys, base = filesystem(folder)
    while count > 0:
        shard, at = divmod(first, per)
        take = min(count, per - at)
        with fsys.open_input_file(f"{base}/{shard_name(shard)}") as source:
            for i in range(0, take, 512):
                k = min(512, take - i)
                data = source.read_at(k * stride, (at + i) * stride)
                for j in range(k):
                    (n,) = struct.unpack_from("<I", data, j * stride)
                    yield n, data[j * stride + HEAD : (j + 1) * stride]
        first, count = first + take, count - take


RESULT = "slot long, shard int, offset long, n_tokens int, ids_sha256 string, doc_ids array<long>"


def materialise(docs: DataFrame, folder: str | None = None, length: int = LENGTH, key: int = KEY, path: str | None = None, shard_bytes: int = SHARD_BYTES, chunk: int = CHUNK) -> DataFrame:
    """Write the shards and read them back: slot, shard, offset, n_tokens, ids_sha256 (of the record's n_tokens ids), doc_ids."""
    spark: SparkSession = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    enc = Encoder.get(path or vocabulary_path())
    width, end = token_width(len(enc.pieces)), enc.tok.token_to_id(END_TOKEN)
    placed, n = pieces(written(chunks(docs, chunk, path), "chunks"), length, width, records(length, width, shard_bytes)[1], key)
    found = written(write_shards(placed, folder, n, length, width, end, shard_bytes), "records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = b.column("slot").to_numpy()
            if not len(slots):
                continue
            digests: list[str] = []
            for own in np.split(slots, np.flatnonzero(np.diff(slots) != 1) + 1):  # slots that follow each other are one read
                digests += [hashlib.sha256(data[: k * width]).hexdigest() for k, data in read_slots(folder, int(own[0]), len(own), length, width, shard_bytes)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(digests), b.column("doc_ids")], names=["slot", "shard", "offset", "n_tokens", "ids_sha256", "doc_ids"])

    return found.mapInArrow(run, RESULT)
