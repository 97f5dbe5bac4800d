"""Embedding whitening.

1. A vector's entries become whole numbers x = floor(64 c) + 1,000,000. The fit list holds each distinct x vector once (partial
   aggregation first, so copies of one vector cost a row per task).
2. Partitions run through their part of the fit list by Welford's rank-one updates of mean and scatter: no sum of squares of
   large numbers is ever taken. Their states - as large as a covariance matrix, however many rows - are merged by the parallel
   update formula, `FAN_IN` at a time in as many rounds as that takes. Sums per dimension are kept beside, as whole numbers.
3. The covariance's eigenvectors come from Householder's reduction to tridiagonal form and symmetric QR steps with implicit
   Wilkinson shifts, in the driver: a matrix of dimension x dimension.
4. Rows are centred, projected and scaled where they are read. The identity error is measured, not assumed: a second run of
   Welford's updates over the whitened fit list.

Defined results: rows whose vector is null, empty, or holds a null, a non-finite entry or one of 2^40 or more in magnitude go (x
would not be exact); of vectors of several lengths those of the length that most distinct vectors have stay (of equally many the
longer). A null vec_id is kept, repeated rows come as often as they are there. Of eigenvectors either sign may come, the same for all
rows: here the one whose largest entry (the first of equal ones) is positive. A component whose variance is not above 1e-13 of the
largest is explained 0.0, whitened 0.0 for all rows and no part of identity_error. deviation is null where it passes 63 bits. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: States that are merged in one group.
FAN_IN = 32
MOST = float(1 << 40)


@dataclass
class State:
    """Of n rows: the mean, the scatter (sum of products of deviations) and, of whole numbers, the sums."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]

    @classmethod
    def empty(cls, d: int) -> State:
        return cls(0, np.zeros(d), np.zeros((d, d)), [0] * d)

    def add(self, rows: np.ndarray, whole: bool) -> None:
        """Welford's update, a row at a time."""
        mean, scatter, n = self.mean, self.scatter, self.n
        step = np.empty_like(scatter)
        for x in rows.astype(np.float64):
            n += 1
            delta = x - mean
            mean += delta / n
            np.multiply(delta[:, None], x - mean, out=step)
            scatter += step
        self.n = n
        if whole:
            self.sums = [a + int(b) for a, b in zip(self.sums, rows.sum(0), strict=True)]

    def merge(self, other: State) -> State:
        """The state of both lists together."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        delta = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(delta, delta) * (self.n * (other.n / n))
        return State(n, self.mean + delta * (other.n / n), scatter, [a + b for a, b in zip(self.sums, other.sums, strict=True)])

    @property
    def covariance(self) -> np.ndarray:
        c = self.scatter / max(self.n, 1)
        return (c + c.T) / 2

    def packed(self) -> bytes:
        return struct.pack("<q", self.n) + self.mean.astype("<f8").tobytes() + self.scatter.astype("<f8").tobytes() + ",".join(map(str, self.sums)).encode()

    @classmethod
    def unpacked(cls, d: int, data: bytes) -> State:
        end = 8 + 8 * d + 8 * d * d
        numbers = np.frombuffer(data, "<f8", d + d * d, 8)
        return cls(struct.unpack_from("<q", data)[0], numbers[:d].copy(), numbers[d:].reshape(d, d).copy(), list(map(int, data[end:].split(b","))))


_STATES = "d int, part long, n long, state binary"
_STATE_FIELDS = pa.schema([("d", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("state", pa.binary())])


def _rows(column: pa.Array, d: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def states(df: DataFrame, col: str, whole: bool) -> DataFrame:
    """A state for each partition and length of its vectors (arrays of numbers; whole: 64-bit whole numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, State] = {}
        for b in batches:
            lists, lengths = b.column(0), b.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                own = lists.filter(pa.array(lengths == d))
                for i in range(0, len(own), 1024):
                    found.setdefault(d, State.empty(d)).add(_rows(own.slice(i, 1024), d), whole)
        part = TaskContext.get().partitionId()
        yield _table([(d, part, s.n, s.packed()) for d, s in sorted(found.items())])

    return df.select(col).mapInArrow(run, _STATES)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_STATE_FIELDS)], schema=_STATE_FIELDS)


def _merged(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    d, total = rows[0]["d"], State.empty(rows[0]["d"])
    for r in rows:
        total = total.merge(State.unpacked(d, r["state"]))
    return pa.Table.from_batches([_table([(d, rows[0]["part"] // FAN_IN, total.n, total.packed())])])


def accumulate(df: DataFrame, col: str, whole: bool) -> dict[int, State]:
    """By length of vectors, the state of all rows. Lengths other than the most frequent come without scatter, as counts alone."""
    found = written(states(df, col, whole), "states")
    while found.select((F.col("part") > 0).alias("more")).agg(F.max("more")).first()[0]:
        found = written(found.groupBy("d", F.expr(f"part div {FAN_IN}").alias("__group")).applyInArrow(_merged_group, _STATES), "states")
    sizes = found.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return {}
    d = sizes[0].d
    total = State.empty(d)
    for r in found.where(F.col("d") == d).orderBy("part").collect():  # one row
        total = total.merge(State.unpacked(d, r.state))
    return {d: total}


def _merged_group(table: pa.Table) -> pa.Table:
    return _merged(table.select(["d", "part", "n", "state"]))


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: diagonal, side diagonal, and Q with Q^T A Q tridiagonal."""
    a, n = a.copy(), len(a)
    q, floor = np.eye(n), np.finfo(float).eps ** 2 * np.abs(a).max(initial=0)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size <= floor:  # nothing but rounding
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2.0 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2.0 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2.0 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix."""
    d, e, q = _tridiagonal(a)
    n, tiny = len(d), np.finfo(float).eps
    high = n - 1
    steps, floor = 0, tiny * tiny * max(np.abs(d).max(initial=0), np.abs(e).max(initial=0))  # far above numbers that lose digits
    while high > 0:
        small = np.flatnonzero(np.abs(e[:high]) <= tiny * (np.abs(d[:high]) + np.abs(d[1 : high + 1])) + floor)
        e[small] = 0.0
        if e[high - 1] == 0.0:
            high -= 1
            continue
        low = int(small[-1]) + 1 if len(small) else 0
        steps += 1
        if steps > 60 * n:
            raise ArithmeticError("the QR steps do not converge")
        half = (d[high - 1] - d[high]) / 2.0
        shift = d[high] - e[high - 1] ** 2 / (half + (np.hypot(half, e[high - 1]) if half >= 0 else -np.hypot(half, e[high - 1])))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):  # chase the bulge by plane rotations
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            d0, d1, e0 = d[k], d[k + 1], e[k]
            d[k] = c * c * d0 + 2 * c * s * e0 + s * s * d1
            d[k + 1] = s * s * d0 - 2 * c * s * e0 + c * c * d1
            e[k] = c * s * (d1 - d0) + (c * c - s * s) * e0
            x = e[k]
            if k + 1 < high:
                z = s * e[k + 1]
                e[k + 1] *= c
            q[:, k : k + 2] = q[:, k : k + 2] @ np.array([[c, -s], [s, c]])
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


@dataclass(frozen=True)
class Whitener:
    """n and sums of the fit list; components as columns with their eigenvalues; the covariance's trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def used(self) -> np.ndarray:
        return self.values > 1e-13 * max(self.values[0], 0.0) if len(self.values) else np.zeros(0, bool)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from n x - S in whole numbers."""
        whole = self._deviations(x)
        return whole.astype(np.float64) / self.n

    def _deviations(self, x: np.ndarray) -> np.ndarray:
        s = np.array(self.sums, dtype=object)
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums)))
        return x * self.n - s.astype(np.int64) if most < 1 << 62 else x.astype(object) * self.n - s

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly."""
        v = self._deviations(x)
        if v.dtype != object and int(np.abs(v).max(initial=0)) ** 2 * v.shape[1] < 1 << 63:
            return (v * v).sum(1).tolist()
        out = [sum(int(k) ** 2 for k in row) for row in v]
        return [k if k < 1 << 63 else None for k in out]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.used, 1.0 / np.sqrt(np.where(self.used, self.values, 1.0)), 0.0)
        return (self.centred(x) @ self.components) * scale


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """vec_id and x of the rows that stay."""
    entry = lambda e: e.cast("double")
    good = (F.size(col) > 0) & F.forall(col, lambda e: F.coalesce(~F.isnan(entry(e)) & (F.abs(entry(e)) < MOST), F.lit(False)))
    x = F.transform(col, lambda e: F.floor(entry(e) * SCALE) + F.lit(OFFSET).cast("long"))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """From a list of distinct x; None if it is empty."""
    found = accumulate(distinct, "x", True)
    if not found:
        return None
    ((_, state),) = found.items()
    values, columns = symmetric_qr(state.covariance)
    values = np.maximum(values, 0.0)
    largest = columns[np.abs(columns).round(12).argmax(0), np.arange(len(values))]
    columns = columns * np.where(largest < 0, -1.0, 1.0)
    return Whitener(state.n, state.sums, columns[:, :components], values[:components], float(np.trace(state.covariance)))


def identity_error(distinct: DataFrame, model: Whitener) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    d, used = len(model.sums), np.flatnonzero(model.used)
    if not len(used):
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0)
            w = model.whiten(_rows(own, d))[:, used]
            offsets = pa.array(np.arange(len(own) + 1) * len(used), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=["w"])

    white = distinct.where(F.size("x") == d).select("x").mapInArrow(run, "w array<double>")
    ((_, state),) = accumulate(white, "w", False).items()
    return float(np.abs(state.covariance - np.eye(len(used))).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_FIELDS = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def apply(rows: DataFrame, model: Whitener, error: float) -> DataFrame:
    """A row for each row (vec_id, x) and component."""
    d, k = len(model.sums), len(model.values)
    explained = np.where(model.used, model.values / model.trace if model.trace > 0 else 0.0, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                x, m = _rows(b.column(1), d), b.num_rows
                each = np.repeat(np.arange(m), k)
                deviations = pa.array(model.deviation(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)),
                        deviations.take(pa.array(each)),
                        pa.array(model.whiten(x).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    schema=_FIELDS,
                )

    return rows.where(F.size("x") == d).mapInArrow(run, RESULT)


def whiten(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row that stays and component."""
    rows = whole_numbers(vectors, id_col, col)
    distinct = written(rows.select("x").distinct(), "fit-list")
    model = fit(distinct, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    return apply(rows, model, identity_error(distinct, model))
