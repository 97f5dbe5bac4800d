"""Whitening against numpy on whole matrices, exact sums against Python's whole numbers, and awkward rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from rangeloom.llm import whitening
from rangeloom.llm.whitening import State, symmetric_qr

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string"


def vectors(n=300, d=7, seed=2):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d) * 50).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 0, "a", "b") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33])
def test_symmetric_qr(d):
    rng = np.random.default_rng(d)
    m = rng.normal(size=(d, d))
    for a in (m @ m.T, m + m.T, np.eye(d), np.zeros((d, d)), np.ones((d, d)), np.diag(np.arange(d)) * 1e9, np.outer(m[0], m[0])):
        values, columns = symmetric_qr(a)
        size = max(1.0, np.abs(a).max())
        assert (np.diff(values) <= 0).all() and np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * size * d, rtol=1e-11)
        assert np.allclose(columns @ np.diag(values) @ columns.T, a, atol=1e-11 * size * d) and np.allclose(columns.T @ columns, np.eye(d), atol=1e-12)


def test_updates_and_merges():
    x = (vectors() * 64).astype(np.int64) + 10**6
    whole = State.empty(7)
    whole.add(x, True)
    parts = [State.empty(7) for _ in range(5)]
    for i, s in enumerate(parts):
        s.add(x[i::5] if i else x[::5], True)
    merged = State.empty(7)
    for s in parts:
        merged = merged.merge(State.unpacked(7, s.packed()))
    want = np.cov(x.T, bias=True)
    for s in (whole, merged):
        assert s.n == 300 and s.sums == x.sum(0).tolist() and np.allclose(s.covariance, want, rtol=1e-10) and np.allclose(s.mean, x.mean(0), rtol=1e-14)


@pytest.mark.parametrize("fan_in", [2, 32])
def test_against_numpy(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    v = vectors()
    data = [(i, row) for i, row in enumerate(v)] + [(1000 + i, v[3]) for i in range(200)]  # a hot vector
    got = whitening.whiten(frame(spark, data).repartition(7), components=5).collect()
    assert len(got) == 500 * 5
    x = np.array([[math.floor(Fraction(float(c)) * 64) + 10**6 for c in row] for row in v], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    values, columns = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, columns = values[::-1], columns[:, ::-1]
    for r in got:
        row = x[r.vec_id if r.vec_id < 1000 else 3]
        k = r.component - 1
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))
        want = float((row - s / n) @ columns[:, k] / math.sqrt(values[k]))
        assert abs(abs(r.whitened) - abs(want)) < 1e-7 and abs(r.explained - values[k] / values.sum()) < 1e-10
        assert r.identity_error < 1e-9
    own = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(own[1000 + i, k] == own[3, k] for i in range(200) for k in range(1, 6))
    # the reported error is that of the reported rows
    w = np.array([[own[i, k] for k in range(1, 6)] for i in np.unique(x, axis=0, return_index=True)[1]])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(5)).max() < 1e-9


def test_large_and_small_numbers(spark):
    data = [(i, [1e9 * (i + 1), -1e9 * i * i, 0.5 * i]) for i in range(6)]
    got = whitening.whiten(frame(spark, data)).collect()
    x = [[math.floor(Fraction(float(np.float32(c))) * 64) + 10**6 for c in row] for _, row in data]
    s = [sum(c) for c in zip(*x, strict=True)]
    for r in got:
        exact = sum((6 * a - b) ** 2 for a, b in zip(x[r.vec_id], s, strict=True))
        assert r.deviation == (exact if exact < 1 << 63 else None)
    assert any(r.deviation is None for r in got)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(20, None), (21, [1.0, None]), (22, [nan, 1.0]), (23, [1.0, inf]), (24, []), (25, [1.0]), (26, [1.0, 2.0, 3.0]), (27, [3e38, 1.0])]
    good = [(1, [0.0, 1.0]), (2, [1.0, 0.25]), (3, [0.5, -1.0]), (None, [0.75, 2.0]), (1, [0.0, 1.0]), (4, [-0.0, 1.0])]
    got = whitening.whiten(frame(spark, bad + good).repartition(3)).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _ in good for _ in range(2))
    assert {r.n for r in got} == {4} and {r.component for r in got} == {1, 2}
    assert abs(sum(r.explained for r in got if r.vec_id == 2) - 1) < 1e-9
    assert whitening.whiten(frame(spark, bad[:5])).collect() == [] and whitening.whiten(frame(spark, good).limit(0)).collect() == []


def test_without_variance(spark):
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, 0.0, 0.0, 0.0)}
    flat = whitening.whiten(frame(spark, [(i, [float(i), 5.0, float(-i)]) for i in range(9)])).collect()
    for r in flat:
        assert (r.explained > 0.99) == (r.component == 1) and (r.component == 1 or (r.whitened, r.explained) == (0.0, 0.0)) and r.identity_error < 1e-9


def test_equal_length_lists_win(spark):
    got = whitening.whiten(frame(spark, [(i, [float(i)] * (3 if i % 2 else 2)) for i in range(8)])).collect()
    assert {r.vec_id for r in got} == {1, 3, 5, 7}
