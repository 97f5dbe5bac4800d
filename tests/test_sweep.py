"""Counts, coverage, records and left joins make no pairs: plans without a join of features and regions, against brute force."""

import random
import re

import numpy as np
import pytest

from rangeloom.operators import coverage, layout, overlap_counts, overlap_left, overlapping_records
from rangeloom.sources import IntervalStore

F_SCHEMA, Q_SCHEMA = "chrom string, start int, end long, ord long", "qid long, chrom string, qstart int, qend long"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    # on and beside tiles' ends, below 0 and far out; copies; nulls
    places = [-(1 << 20), -1, 0, 5, (1 << 14) - 1, 1 << 14, (1 << 14) + 1, 1 << 20, 1 << 30]
    span = lambda: (rng.choice(["a", "b"]), s := rng.choice(places) + rng.randrange(3), s + rng.choice([1, 2, 1 << 14, 1 << 21, 1 << 40]))
    f = [(*span(), i) for i in range(150)]
    q = [(i, *span()) for i in range(60)] + [(90, "c", 1, 5), (91, None, 1, 5), (92, "a", None, 5), (93, "a", 1, None)]
    f += [(None, 1, 5, 200), ("a", None, 5, 201), ("a", 1, None, 202)]
    return f, q, spark.createDataFrame(f, F_SCHEMA).repartition(3), spark.createDataFrame(q, Q_SCHEMA).repartition(2)


def over(f, q):
    return None not in (*f, *q) and f[0] == q[1] and f[1] < q[3] and f[2] > q[2]


def test_figures(tables):
    f, q, df, dq = tables
    n = {b[0]: sum(over(a, b) for a in f) for b in q}
    bases = {b[0]: sum(min(a[2], b[3]) - max(a[1], b[2]) for a in f if over(a, b)) for b in q}
    assert {r.qid: (r.n, r.bases) for r in coverage(df, dq).collect()} == {k: (n[k], bases[k]) for k in n}
    assert {r.qid: r.n for r in overlap_counts(df, dq).collect()} == {k: v for k, v in n.items() if v}
    found = overlapping_records(df, dq)
    assert found.schema == df.schema
    assert sorted(r.ord for r in found.collect()) == sorted(a[3] for a in f for b in q if over(a, b))
    left = overlap_left(df, dq)
    assert left.schema["qstart"].dataType == dq.schema["qstart"].dataType
    want = [(b[0], a[3]) for a in f for b in q if over(a, b)] + [(k, -1) for k, v in n.items() if not v]
    assert sorted((r.qid, -1 if r.ord is None else r.ord) for r in left.collect()) == sorted(want)


def test_no_pairs(tables):
    *_, df, dq = tables
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(overlap_counts(df, dq)) and "Join" not in plan(overlapping_records(df, dq))
    assert "__code" not in plan(coverage(df, dq))
    assert plan(overlap_left(df, dq)).count("Join") == 1  # the pairs', after which nothing is shuffled


def test_many_regions_of_a_row(spark, tmp_path):
    store = IntervalStore.create(spark.createDataFrame([("a", 5, 9)], "chrom string, start long, end long"), str(tmp_path / "s"))
    q = spark.range(10_000).selectExpr("id AS qid", "'a' AS chrom", "4 AS qstart", "6 + id AS qend")
    assert store.query_regions(q).count() == 10_000 == overlapping_records(store.rows(), q).count()
    plan = store.query_regions(q)._jdf.queryExecution().executedPlan().toString()
    assert "_n" in plan and "Generate explode" in plan  # a row leaves Python once


def test_tallies():
    s, e, qs, qe = np.array([0, 5, 10]), np.array([5, 6, 20]), np.array([0, 5, 19]), np.array([5, 10, 30])
    assert layout.tallies(s, e, qs, qe).tolist() == [1, 1, 1]


def test_regions_that_overlap_nothing(spark):
    """Sparse sides, ends that touch, tiles without a mark; lone regions are found by one pass over the tiles."""
    rng = random.Random(11)
    at = lambda: rng.randrange(-40, 40) * (1 << 13) + rng.randrange(-1, 2)
    f = [(rng.choice("ab"), s := at(), s + rng.choice([1, 1 << 13, 1 << 15]), i) for i in range(25)]
    q = [(i, rng.choice("abc"), s := at(), s + rng.choice([1, 2, 1 << 13])) for i in range(200)]
    left = overlap_left(spark.createDataFrame(f, F_SCHEMA).repartition(3), spark.createDataFrame(q, Q_SCHEMA).repartition(2))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(tile#\d+L?, chrom", plan)) == 1
    want = [(b[0], a[3]) for b in q for a in f if over(a, b)] + [(b[0], -1) for b in q if not any(over(a, b) for a in f)]
    assert sum(i < 0 for _, i in want) > 50
    assert sorted((r.qid, -1 if r.ord is None else r.ord) for r in left.collect()) == sorted(want)
