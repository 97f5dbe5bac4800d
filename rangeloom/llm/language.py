"""Language identification by nearest centroids.

1. A text's letters, lower-cased, with one space for whatever stands between them, give character n-grams of one to three;
   they are hashed into `DIMENSIONS` counts. log(1 + count) times the n-gram's inverse document frequency, at length 1, is the
   text's vector. Document frequencies are counted over all documents that may be learned from, in partial counts per task.
2. Each language's documents are clustered on their own, a task for each, by spherical k-means into up to `CENTROIDS` centroids
   (prose, capitals and junk of one language look different), from a sample of about `SAMPLE` documents a language. A centroid
   keeps its radius: the mean distance of its members and four standard deviations.
3. A text gets the language of the centroid with the highest cosine; it is rejected if its distance (1 - cosine) is beyond that
   centroid's radius.

What passes through the driver is bounded by parameters and by the number of languages: `DIMENSIONS` document frequencies, and
`CENTROIDS` vectors of as many numbers for each language.

Learned from: rows whose crc32(doc_id as text) mod 5 is not 0, with a lang and a text that has a letter. A null doc_id is not held
out. lang, source and doc_id are no inputs of a prediction.

Defined results: a null text and one without a letter (str.isalpha) are `und` with score 0 and no centroid, and rejected; so is any
text where nothing could be learned. Of equal cosines the language that comes first by code points counts, then the centroid's
number. Repeated rows are predicted alike and count in the document frequencies, but stand in the sample once. Whole texts count, in
pieces of `PIECE` characters. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 13
#: Longest n-grams.
ORDERS = 3
#: About how many documents of a language are clustered, at most, and into how many centroids.
SAMPLE, CENTROIDS, ROUNDS = 2_000, 4, 12
#: Characters that are turned into n-grams at once.
PIECE = 1 << 20
UNKNOWN = "und"
_HASH = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_letters: np.ndarray | None = None


def held_out(col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(col).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:  # once a worker: a bit for each code point
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[points]


def _count_ends(s: np.ndarray, before: int, total: np.ndarray) -> None:
    """Count the n-grams of symbols that end after the first so many."""
    code = np.zeros(len(s), np.uint32)
    for n in range(ORDERS):  # n-grams of n + 1
        with np.errstate(over="ignore"):
            code = (code[:-1] if n else code) * np.uint32(_HASH[0]) + s[n:] * np.uint32(_HASH[1]) + np.uint32(n)
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(_HASH[2])
        new = mixed[max(before - n, 0) :]
        if n == 0:
            new = new[s[before:] != 32]
        total += np.bincount((new >> np.uint32(32 - DIMENSIONS.bit_length() + 1)).astype(np.int64), minlength=DIMENSIONS)


def counts(text: str | None) -> np.ndarray | None:
    """How often each hashed n-gram occurs; None where there is no letter."""
    total, seen, tail = np.zeros(DIMENSIONS, np.int64), False, np.full(1, 32, np.uint32)
    for i in range(0, len(text or ""), PIECE):
        points = np.frombuffer(text[i : i + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        good = _is_letter(points)
        seen = seen or bool(good.any())
        s = np.where(good, points, np.uint32(32))
        s = s[(s != 32) | (np.concatenate([tail[-1:], s[:-1]]) != 32)]  # one space between words
        s = np.concatenate([tail, s])
        _count_ends(s, len(tail), total)
        tail = s[1 - ORDERS :]
    if tail[-1] != 32:
        _count_ends(np.append(tail, np.uint32(32)), len(tail), total)
    return total if seen else None


def _sparse(c: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(c)
    return at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as vectors of length 1."""
    v = np.log1p(c.astype(np.float64)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)


def document_frequencies(learn: DataFrame) -> DataFrame:
    """bucket, n: documents that hold each hashed n-gram; the bucket after the last has all documents with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                c = counts(t.as_py())
                if c is not None:
                    total[:-1] += c > 0
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return learn.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def inverse(rows: list[tuple[int, int]]) -> np.ndarray:
    """log((1 + N) / (1 + n)) + 1 of each bucket."""
    n = np.zeros(DIMENSIONS + 1)
    for bucket, k in rows:
        n[bucket] = k
    return np.log((1 + n[-1]) / (1 + n[:-1])) + 1


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of rows of length 1: centroids, and each row's. Begins with the mean row, then with those farthest from all before."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)
    centres = unit(x.mean(0, keepdims=True))
    while len(centres) < min(k, len(x)):
        near = (x @ centres.T).max(1)
        if near.min() > 1 - 1e-9:
            break
        centres = np.vstack([centres, x[near.argmin()]])
    own = (x @ centres.T).argmax(1)
    for _ in range(rounds):
        kept = [own == i for i in range(len(centres))]
        centres = unit(np.array([x[m].mean(0) for m in kept if m.any()]))
        new = (x @ centres.T).argmax(1)
        if (new == own).all() and all(m.any() for m in kept):
            break
        own = new
    used = np.unique(own)
    return centres[used], np.searchsorted(used, own)


@dataclass(frozen=True)
class Model:
    """languages: of each centroid; numbers: within its language; centres: unit rows; radii: greatest distances that aren't rejected."""

    idf: np.ndarray
    languages: list[str]
    numbers: list[int]
    centres: np.ndarray
    radii: np.ndarray


_CENTROIDS = "lang string, no int, members long, radius double, centre binary"
_CENTROID_FIELDS = pa.schema([("lang", pa.string()), ("no", pa.int32()), ("members", pa.int64()), ("radius", pa.float64()), ("centre", pa.binary())])


def centroids(learn: DataFrame, idf: np.ndarray, sample: int = SAMPLE, k: int = CENTROIDS) -> DataFrame:
    """lang, no, members, radius, centre (32-bit floats) from rows doc_id, text, lang: a task clusters a language's sample."""
    each = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language
    rates = F.create_map(*(F.lit(x) for r in each for x in (r.lang, min(1.0, sample / r.n)))) if each else F.lit(None)
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    # filtered where it is read, so that only the sample's texts are shuffled
    drawn = (learn.where(place < F.element_at(rates, F.col("lang"))) if each else learn.limit(0)).dropDuplicates(["lang", "doc_id", "text"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(lang, i, *_sparse(c)) for lang, i, t in zip(*(b.column(n).to_pylist() for n in ("lang", "doc_id", "text")), strict=True) if (c := counts(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "doc_id", "at", "n"])

    def own(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(n).to_pylist() for n in ("doc_id", "at", "n")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        x = np.zeros((len(rows), DIMENSIONS), np.float32)
        for i, (_, at, n) in enumerate(rows):
            c = np.zeros(DIMENSIONS)
            c[np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
            x[i] = weighted(c, idf)
        centres, member = cluster(x, k)
        out = []
        for j, centre in enumerate(centres):
            far = 1 - x[member == j].astype(np.float64) @ centre.astype(np.float64)
            out.append((table.column("lang")[0].as_py(), j, len(far), float(far.mean() + 4 * far.std()), centre.astype("<f4").tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CENTROID_FIELDS, strict=True)], schema=_CENTROID_FIELDS)

    sparse = drawn.mapInArrow(vectors, "lang string, doc_id long, at binary, n binary")
    return sparse.groupBy("lang").applyInArrow(own, _CENTROIDS)


def fit(docs: DataFrame) -> Model:
    """From doc_id, text, lang of the documents that are not held out."""
    learn = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    idf = inverse([tuple(r) for r in document_frequencies(learn).collect()])  # a row for each bucket at most
    rows = sorted(centroids(learn, idf).collect(), key=lambda r: (r.lang, r.no))  # at most CENTROIDS a language
    centres = np.array([np.frombuffer(r.centre, "<f4") for r in rows], np.float64).reshape(-1, DIMENSIONS)
    return Model(idf, [r.lang for r in rows], [r.no for r in rows], centres, np.array([r.radius for r in rows]))


RESULT = "doc_id long, held_out boolean, lang_pred string, score double, centroid int, rejected boolean"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the highest cosine), centroid (its number within the language), rejected."""
    known = len(model.languages) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                b = whole.slice(i, 128)
                found = [counts(t.as_py()) if known else None for t in b.column(2)]
                at = [j for j, c in enumerate(found) if c is not None]
                langs, scores, numbers, rejected = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows, [None] * b.num_rows, [True] * b.num_rows
                if at:
                    cosines = weighted(np.stack([found[j] for j in at]), model.idf) @ model.centres.T
                    for j, c, best in zip(at, cosines, cosines.argmax(1).tolist(), strict=True):
                        score = min(1.0, max(0.0, float(c[best])))
                        langs[j], scores[j], numbers[j], rejected[j] = model.languages[best], score, model.numbers[best], 1 - score > model.radii[best]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs), pa.array(scores, pa.float64()), pa.array(numbers, pa.int32()), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "centroid", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, RESULT)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents that aren't held out, and predict all."""
    return predict(docs, fit(docs))
