"""Phrase collocation mining by contiguous pattern growth, as PrefixSpan does it.

1. Words are counted by language, exactly. Beside that phrases of two, three and four words are counted by cells, to which they
   hash: a cell for every `CELL_BYTES` bytes of text, from 2^`CELL_BITS` to 2^`MOST_CELL_BITS` for each length. Tasks send the
   cells that they met, sorted, by blocks, and blocks are added up to at most 255. A phrase whose cell stays
   below the support is infrequent, whatever else hashes to it, and so is every longer one that begins with it.
2. Occurrences are projected: of each place where a pair begins whose cell is full enough, the words that follow, for as long as
   the phrase's cell is full enough, up to `LONGEST`: a row for each place. Spark's aggregate counts equal projections together, in
   the task and then over all tasks, so Python keeps nothing from one piece of text to the next.
3. Projections are dealt out by ranges of prefixes, sorted, and each task grows its prefixes to the right, depth-first: it
   walks the sorted projections with one count for each word of the present prefix. So a prefix is one task's; one with too
   many projections for a task goes on in the next, and what both saw of it is added up. No task holds a prefix's projections.
4. Frequent phrases meet the counts of their parts (l and r of every cut) and of the longer ones that hold them in joins of
   shuffled sides, which Spark splits where a part is hot. Each language's first phrases are found by a ranked window, whose
   limit Spark applies in each task before rows of a language meet.

The tables of cells (a bit for each: 6 MB, and 100 MB from 8.6 GB of text on) are all that goes to every task. With a fixed number of
cells they would fill as text grows, and prune nothing: every place would be a projection. Beyond `MOST_CELL_BITS` that begins again,
slowly; it costs projections, not results.

Defined results: a null text is empty, a null lang is `und` (and counts with rows that say so); A-Z are lower-cased and no other
letters; repeated rows count as often as they come; texts without words, and an empty table, give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, text_or_empty, written

SUPPORT, LONGEST, FIRST = 30, 4, 2000
#: A phrase goes if a longer one that holds it has this share of its occurrences, in hundredths.
COVERED = 80
#: Log2 of the cells for phrases of a length, at least and at most, and the bytes of text for which there is one, about ten words.
CELL_BITS, MOST_CELL_BITS, CELL_BYTES = 24, 28, 64
#: Cells of a block, and places whose cells a task remembers before it sends their counts on.
BLOCK, PLACES = 1 << 16, 1 << 22
#: About the bytes of text that are cut into words at once, and the words that a task remembers before it sends their counts on.
PIECE_BYTES, REMEMBERED = 4 << 20, 1 << 20
#: Projections that a task sends on at once.
HELD = 1 << 16
#: About how many projections a task walks.
PER_TASK = 1 << 19
NO_LANG = "und"
_STOP = b"."
_FOLD = bytes(_STOP[0] if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(texts: list[bytes]) -> list[bytes]:
    """The words of all texts, with a stop between pieces and between texts."""
    return _STOP.join(texts).translate(_FOLD).replace(_STOP, b" . ").split()


class _Words:
    """Words of some texts of a language as codes."""

    def __init__(self, lang: str, texts: list[bytes]):
        import xxhash

        coded = pa.array([_STOP, *words_of(texts), _STOP], pa.binary()).dictionary_encode()
        self.lang, self.dictionary = lang, coded.dictionary
        self.names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)  # the stop has code 0
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.names), np.uint64, len(self.names))

    def cells(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For two words, three and so on: of the phrase at each place whether it is one (no stop in it), and its cell."""
        x, good = self.hashes[self.codes], self.codes != 0
        for k in range(1, LONGEST):
            with np.errstate(over="ignore"):
                x = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.codes[k:]]
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            good = good[:-1] & (self.codes[k:] != 0)
            yield good, (x >> np.uint64(64 - bits)).astype(np.uint32)


def _by_language(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[_Words]:
    """Columns lang and text, some texts at a time."""
    for whole in batches:
        held: dict[str, list[bytes]] = {}
        size = 0
        for lang, text in zip(whole.column(0), whole.column(1), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            held.setdefault(lang.as_py(), []).append(data)
            size += len(data)
            if size >= piece:
                yield from (_Words(k, v) for k, v in held.items())
                held, size = {}, 0
        yield from (_Words(k, v) for k, v in held.items())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit(NO_LANG)).alias("lang"), text_or_empty().alias("text"))


_COUNTED = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("block", pa.int32()), ("cells", pa.binary())])
COUNTED = "lang string, word string, n long, block int, cells binary"


def _counted(lang, word, n, block=None, cells=None) -> pa.RecordBatch:
    k = len(word)
    none = [None] * k
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((lang, word, n, none if block is None else block, none if cells is None else cells), _COUNTED, strict=True)], schema=_COUNTED)


def count(docs: DataFrame, bits: int = CELL_BITS, piece: int = PIECE_BYTES, remembered: int = REMEMBERED) -> DataFrame:
    """In one pass: counts of words (lang, word, n) and of the cells of phrases (block, cells), both some at a time."""
    n_blocks = _blocks(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[list[np.ndarray]] = [[] for _ in range(LONGEST - 1)]
        held: dict[str, dict[bytes, int]] = {}
        size = places = 0

        def send() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                names = list(own)
                for i in range(0, len(names), 1 << 16):
                    some = names[i : i + (1 << 16)]
                    yield _counted([lang] * len(some), [w.decode("utf-8", "replace") for w in some], [own[w] for w in some])
            held.clear()

        def send_cells() -> Iterator[pa.RecordBatch]:
            for k, own in enumerate(met):
                cells = np.sort(np.concatenate([np.empty(0, np.uint32), *own]))
                own.clear()
                first = np.flatnonzero(np.diff(cells, prepend=~cells[:1]))
                at, n = cells[first], np.minimum(np.diff(first, append=len(cells)), 255).astype(np.uint8)
                cuts = np.searchsorted(at, np.arange(n_blocks + 1, dtype=np.uint64) * BLOCK)
                used = np.flatnonzero(np.diff(cuts))
                for i in range(0, len(used), 256):
                    some = used[i : i + 256]
                    none = [None] * len(some)
                    yield _counted(none, none, none, k * n_blocks + some, [_packed(at[a:b], n[a:b]) for a, b in zip(cuts[some], cuts[some + 1], strict=True)])

        for words in _by_language(batches, piece):
            n = np.bincount(words.codes, minlength=len(words.dictionary)).tolist()
            own = held.setdefault(words.lang, {})
            before = len(own)
            for w, k in zip(words.names[1:], n[1:], strict=True):
                own[w] = own.get(w, 0) + k
            size += len(own) - before
            for own_cells, (good, cells) in zip(met, words.cells(bits), strict=True):
                own_cells.append(cells[good])
            places += len(words.codes)
            if size >= remembered:
                yield from send()
                size = 0
            if places >= PLACES:
                yield from send_cells()
                places = 0
        yield from send()
        yield from send_cells()

    return _texts(docs).mapInArrow(run, COUNTED)


def cell_bits(size: int) -> int:
    """Log2 of the cells for so many bytes of text."""
    return min(max(CELL_BITS, (size // CELL_BYTES).bit_length()), MOST_CELL_BITS)


def _blocks(bits: int) -> int:
    return max(1, (1 << bits) // BLOCK)


def _packed(cells: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted cells of one block, each after the one before it, and their counts."""
    return np.diff((cells & np.uint32(BLOCK - 1)).astype(np.uint16), prepend=np.uint16(0)).tobytes() + n.tobytes()


def _unpacked(cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = len(cells) // 3
    return np.cumsum(np.frombuffer(cells, np.uint16, k), dtype=np.int64), np.frombuffer(cells, np.uint8, offset=2 * k)


def frequent_cells(blocks: DataFrame, support: int, bits: int = CELL_BITS) -> np.ndarray:
    """From rows block, cells: for each length a bit for each cell that reaches the support. Blocks are added as they stream; the bits go to the driver."""
    need, block = min(support, 255), min(BLOCK, 1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k not in total:
                    total[k] = np.zeros(block, np.uint8)
                own, (at, n) = total[k], _unpacked(cells)
                own[at] = np.minimum(own[at] + n.astype(np.uint16), 255)
        # few cells are frequent, so their bits take little room
        rows = [(k, zlib.compress(np.packbits(v >= need).tobytes(), 1)) for k, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "bits"])

    found = np.zeros(((LONGEST - 1) * _blocks(bits), block // 8), np.uint8)
    for r in blocks.repartition("block").mapInArrow(run, "block int, bits binary").collect():
        found[r.block] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return found.reshape(LONGEST - 1, -1)


_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
PROJECTED = "lang string, " + ", ".join(f"{w} string" for w in _WORDS)


def project(docs: DataFrame, frequent: np.ndarray, piece: int = PIECE_BYTES, most: int = HELD) -> DataFrame:
    """lang, w1 to w4 (null where the projection is shorter), n. frequent: a bit for each cell."""
    bits = (frequent.shape[1] * 8).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _by_language(batches, piece):
            base = len(words.dictionary)  # stands for no word
            at = None
            taken: list[np.ndarray] = []
            for k, (full, (good, cells)) in enumerate(zip(frequent, words.cells(bits), strict=True), 1):
                good = good & ((full[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).astype(bool)
                if at is None:
                    at = np.flatnonzero(good)
                    taken, alive = [words.codes[at], words.codes[at + 1]], np.ones(len(at), bool)
                else:
                    alive = alive & np.append(good, [False] * k)[at]
                    taken.append(np.where(alive, words.codes[np.minimum(at + k, len(words.codes) - 1)], base))
            names = words.dictionary.cast(pa.string())
            for i in range(0, len(at), most):
                some = [c[i : i + most] for c in taken]
                columns = [names.take(pa.array(c, mask=c == base)) for c in some]
                yield pa.RecordBatch.from_arrays([pa.repeat(words.lang, len(some[0])), *columns], names=["lang", *_WORDS])

    return _texts(docs).mapInArrow(run, PROJECTED).groupBy("lang", *_WORDS).agg(F.count(F.lit(1)).alias("n"))


def grow(projected: DataFrame, support: int = SUPPORT, per_task: int = PER_TASK) -> DataFrame:
    """From written projections: lang, words, f of the phrases of two words and more that are frequent."""
    k = parts(projected.sparkSession, projected.count(), per_task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list = []  # the language and the words of the present prefix
        counts: list[int] = []
        begun: list[int] = []  # the row with which each of them began
        out: list[tuple] = []

        def leave(depth: int, last: bool) -> None:
            """Go back to a prefix of so many words; what may go on in a neighbouring task is reported whatever its count."""
            while len(path) > depth:
                if len(path) > 2 and (counts[-1] >= support or begun[-1] == 0 or last):
                    out.append((path[0], path[1:], counts[-1]))
                path.pop(), counts.pop(), begun.pop()

        row = 0
        for b in batches:
            for lang, n, *words in zip(*(b.column(c).to_pylist() for c in ("lang", "n", *_WORDS)), strict=True):
                at = [lang, *(w for w in words if w is not None)]
                same = 0
                for x, y in zip(path, at, strict=False):
                    if x != y:
                        break
                    same += 1
                leave(same, False)
                for i in range(same):
                    counts[i] += n
                for x in at[same:]:
                    path.append(x), counts.append(n), begun.append(row)
                row += 1
            if len(out) >= 4096:
                yield _grown(out)
                out = []
        leave(0, True)
        yield _grown(out)

    dealt = projected.repartitionByRange(k, "lang", *_WORDS).sortWithinPartitions("lang", *_WORDS)
    found = dealt.mapInArrow(run, "lang string, words array<string>, f long")
    return found.groupBy("lang", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= support)


def _grown(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.list_(pa.string()), pa.int64()))], names=["lang", "words", "f"])


def scored(found: DataFrame, words: DataFrame, support: int = SUPPORT) -> DataFrame:
    """lang, words, a, l, r, score of the candidates: of its cuts each has the one that scores lowest."""
    singles = words.where(F.col("n") >= support).select("lang", F.array("word").alias("words"), F.col("n").alias("f"))
    every = singles.unionByName(found).withColumnsRenamed({"words": "part", "f": "own"})
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), F.slice("words", 1, k).alias("first"), F.slice("words", k + 1, F.size("words") - k).alias("rest"))))
    cut = found.select("lang", "words", F.col("f").alias("a"), cuts.alias("c")).select("lang", "words", "a", "c.*")
    cut = cut.withColumnRenamed("first", "part").join(every, ["lang", "part"]).drop("part").withColumnRenamed("own", "l")
    cut = cut.withColumnRenamed("rest", "part").join(every, ["lang", "part"]).drop("part").withColumnRenamed("own", "r")
    score = F.expr("(CAST(a AS decimal(20,0)) * 2000000) div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0)))")
    return cut.withColumn("score", score).groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "words", "a", "c.l", "c.r", "c.score")


def covered(found: DataFrame) -> DataFrame:
    """lang, words, held: of each phrase that lies in longer candidates the greatest count of these."""
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m))))
    return found.where(size > 2).select("lang", F.explode(inner).alias("words"), "f").groupBy("lang", "words").agg(F.max("f").alias("held"))


def collocations(docs: DataFrame, support: int = SUPPORT, first: int = FIRST, bits: int | None = None, piece: int = PIECE_BYTES, remembered: int = REMEMBERED, per_task: int = PER_TASK, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, then count, then their bytes. bits: by the size of the texts."""
    if bits is None:
        bits = cell_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    counted = written(count(docs, bits, piece, remembered), "counted")
    words = written(counted.where(F.col("word").isNotNull()).groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    frequent = frequent_cells(counted.where(F.col("block").isNotNull()).select("block", "cells"), support, bits)
    found = written(grow(written(project(docs, frequent, piece, held), "projected"), support, per_task), "frequent")
    kept = scored(found, words, support).join(covered(found), ["lang", "words"], "left").where(F.expr(f"held IS NULL OR CAST(held AS decimal(20,0)) * 100 < CAST(a AS decimal(20,0)) * {COVERED}"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
