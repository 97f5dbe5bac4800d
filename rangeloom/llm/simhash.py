"""SimHash near-dedup by pigeonhole blocks.

A 64-bit fingerprint is split into b blocks. Fingerprints that differ in at most d bits agree in at least b - d blocks,
so each fingerprint gets one key per choice of b - d blocks and close pairs share a key. b is chosen from the number of
distinct fingerprints so that a key's bits keep unrelated fingerprints apart (more fingerprints, longer keys): with d = 4,
5, 15, 35, 70 or 126 keys a fingerprint, the last for more than 2**32. Any b above d finds every pair. Keys are joined by dealing rows out by key; within a key, Hamming distances are verified
and the fingerprints linked by a search that compares each reached one with those not yet reached and emits one
edge per reached fingerprint. So a group of near copies costs edges in proportion to its size, never all pairs, and
no link between different texts is lost: the components are those of all links. Keys with more fingerprints than
`BUCKET` are split into chunks and compared chunk by chunk, so that no task holds more than two chunks of a key.

Equal fingerprints are one node, so exact copies never meet in a key. Components come from star contraction.

Defined results: a null or blank text has fingerprint zero, linked like any other; a null doc_id is never the id of
a component unless all its rows' ids are null; rows that repeat a doc_id stay as they are in `near_duplicates`;
`apply` keeps one row per component: of the rows with the smallest doc_id (null last) the smallest fingerprint, then
text digest, then hash of the other columns. An empty table gives no rows. Other columns are carried along by `apply`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, text_or_empty, utf8, written
from .components import connected_components

SHINGLE, DISTANCE = 4, 4
#: Most fingerprints of one key that a task compares with each other.
BUCKET = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit integer."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words)
    if n <= shingle:
        h = xxhash.xxh64_intdigest(line, 42)
        return h - (1 << 64) if h >> 63 else h
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = np.concatenate([[0], ends[:-1] + 1])
    cut = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    m = n - shingle + 1
    counts = np.zeros(64, np.int64)
    for _ in range(0, m, 65536):  # very long texts in pieces
        take = min(65536, m - _)
        h = np.fromiter((digest(line[a:b], 42) for (a, b), _i in zip(cut, range(take), strict=False)), np.uint64, take)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > m
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: Column | None = None) -> DataFrame:
    """doc_id, fp (as a signed long) of every row, and key where one is given."""
    more = [] if key is None else [key.alias("key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])

    schema = "doc_id long, fp long" + ", key string" * len(more)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *more).mapInArrow(run, schema)


def layout(n: int, distance: int = DISTANCE) -> list[tuple[int, list[int]]]:
    """For n distinct fingerprints, the masks of the keys: (table, bit positions as a mask)."""
    for blocks in range(distance + 1, 13):
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        own = [sum(c) for c in combinations(masks, blocks - distance)]
        if n <= 1 << min(bin(m).count("1") for m in own):
            break
    return own


def link(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest of its component) among distinct fingerprints, one for each that isn't the smallest."""
    x = fps.view(np.uint64)
    rest = np.arange(len(x))
    nodes, roots = [], []
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        group = [frontier]
        while len(frontier) and len(rest):
            reached = []
            for f in frontier:
                if not len(rest):
                    break
                near = np.bitwise_count(x[rest] ^ x[f]) <= distance
                if near.any():
                    reached.append(rest[near])
                    rest = rest[~near]
            frontier = np.concatenate(reached) if reached else rest[:0]
            group.append(frontier)
        own = fps[np.concatenate(group)]
        if len(own) > 1:
            least = own.min()
            own = own[own != least]
            nodes.append(own)
            roots.append(np.full(len(own), least))
    none = np.empty(0, np.int64)
    return (np.concatenate(nodes), np.concatenate(roots)) if nodes else (none, none)


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """From distinct fingerprints (fp): edges a, b whose components are those of all pairs within the distance."""
    n = fps.count()
    masks = layout(n, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.posexplode(F.array(*(F.lit(m).cast("long") for m in signed)))
    keyed = fps.select("fp", tables.alias("t", "mask")).select("fp", F.col("t").cast("short").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    # no key can be crowded unless there are that many fingerprints
    if n > bucket:
        crowd = written(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket), "crowded-keys")
        if not crowd.isEmpty():
            chunks = F.ceil(F.col("n") / bucket).cast("int")
            chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
            every = F.sequence(F.lit(0), F.col("chunks") - 1)
            # chunk c meets chunk d in the pair (min, max)
            many = keyed.join(crowd.select("t", "key", chunks.alias("chunks")), ["t", "key"]).withColumn("c", chunk).withColumn("d", F.explode(every))
            many = many.select("fp", "t", "key", F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d"))
            few = keyed.join(crowd.select("t", "key"), ["t", "key"], "left_anti").select("fp", "t", "key", F.lit(-1).alias("c"), F.lit(-1).alias("d"))
            keyed = few.union(many)
    if "c" not in keyed.columns:
        keyed = keyed.select("fp", "t", "key", F.lit(-1).alias("c"), F.lit(-1).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def groups(rows: np.ndarray) -> list[np.ndarray]:
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)
            return np.split(rows, np.flatnonzero(new)[1:])

        def edges(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """rows: whole keys, sorted."""
            if len(rows) < 2:
                return
            same = (rows[1:, 1:] == rows[:-1, 1:]).all(axis=1)
            keep = np.zeros(len(rows), bool)
            keep[1:] |= same
            keep[:-1] |= same
            out_a, out_b = [], []
            if keep.any():
                for g in groups(rows[keep]):
                    a, b = link(np.unique(g[:, 0]), distance)
                    if len(a):
                        out_a.append(a)
                        out_b.append(b)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

        for b in batches:
            rows = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fp", "t", "key", "c", "d")])
            if not len(rows):
                continue
            # the last key may go on in the next batch
            last = int(np.flatnonzero((rows[:, 1:] != rows[-1, 1:]).any(axis=1)).max(initial=-1)) + 1
            if last or (held and (held[-1][-1, 1:] != rows[-1, 1:]).any()):
                yield from edges(np.concatenate([*held, rows[:last]]))
                held = []
            held.append(rows[last:])
        if held:
            yield from edges(np.concatenate(held))

    dealt = keyed.repartition("t", "key", "c", "d").sortWithinPartitions("t", "key", "c", "d")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Per row: doc_id, fp, component_id (smallest doc_id reachable)."""
    return _components(written(fingerprints(docs, shingle), "fingerprints"), distance)


def _roots(rows: DataFrame, distance: int) -> DataFrame:
    """fp, least_id, root: of every distinct fingerprint."""
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    roots = connected_components(links(fps.select("fp"), distance))
    ids = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    return written(ids, "fingerprint-roots")


def _components(rows: DataFrame, distance: int) -> DataFrame:
    ids = _roots(rows, distance)
    whole = ids.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = ids.join(whole, "root").select("fp", "component_id")
    return rows.join(named, "fp")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    got = near_duplicates(docs)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def apply(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest doc_id."""
    k, n = free_names(docs, "__key", "__n")
    # a doc_id and a text, never null: one key for window and join, one shuffle
    key = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")), F.sha2(utf8(), 256))
    rows = written(fingerprints(docs, key=key), "fingerprints")
    least = lambda *cols: F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *cols))
    first = rows.groupBy("fp").agg(least("key").alias("first")).select("fp", "first.doc_id", "first.key")
    of_root = first.join(_roots(rows, DISTANCE).select("fp", "root"), "fp").groupBy("root").agg(least("fp", "key").alias("first"))
    stays = of_root.select(F.col("first.key").alias(k))
    # rows alike in both: one by the other columns, chosen in each task before the shuffle
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind]
    order = Window.partitionBy(k).orderBy(F.xxhash64(*others) if others else F.lit(0))
    single = docs.withColumn(k, key).withColumn(n, F.row_number().over(order)).where(F.col(n) == 1)
    return single.join(stays, k, "left_semi").select(*docs.columns)
