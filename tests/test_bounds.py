"""The linear index as a bound that loses nothing, and the check of order, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from rangeloom.functions import TABIX, Bins
from rangeloom.operators import bounded_lookup, index, linear_bound_lookup, linear_bounds, lookup, unsorted

SCHEMA = "chrom string, start long, end long, ord long"


def sparse(n=200, seed=4):
    rng = random.Random(seed)
    rows = sorted((rng.choice("ab"), s := rng.randrange(1 << 26), s + rng.choice([1, 300, 1 << rng.randrange(24)])) for _ in range(n))
    return [(*r, i) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [1, 4, 16])
def test_bounds(spark, monkeypatch, block):
    monkeypatch.setattr(index, "_BOUND_BLOCK", block)
    f = sparse()
    df = spark.createDataFrame(f + [(None, 1, 5, 900), ("c", None, None, 901)], SCHEMA).repartition(3)
    bounds = linear_bounds(df)
    regions = [(i, "abcz"[i % 4], random.Random(i).randrange(1 << 27)) for i in range(120)] + [(500, "a", 0), (501, "a", -90_000)]
    got = {r.qid: r.bound for r in linear_bound_lookup(spark.createDataFrame(regions, "qid long, chrom string, qstart long"), bounds).collect()}
    for i, c, s in regions:
        assert got[i] == min((o for x, _, e, o in f if x == c and (e - 1) >> 14 >= s >> 14), default=None), (i, c, s)


def test_no_row_is_lost_and_fewer_are_read(spark, tmp_path):
    """On sparse data, whose windows are mostly empty."""
    f = sparse(3000, 9)
    path = str(tmp_path / "f")
    spark.createDataFrame(f, SCHEMA).coalesce(1).sortWithinPartitions("ord").write.option("parquet.block.size", 4096).option("parquet.page.size", 512).parquet(path)
    df = spark.read.parquet(path)
    bounds = linear_bounds(df, TABIX).cache()
    for c, s, e in [("a", 0, 500), ("a", 1 << 20, 1 << 21), ("b", (1 << 26) - 5000, 1 << 26), ("b", 1 << 27, 1 << 28), ("z", 0, 9), ("a", (1 << 25) + 3, (1 << 25) + 4)]:
        got = bounded_lookup(df, bounds, c, s, e)
        assert sorted(got.collect()) == sorted(lookup(df, c, s, e).collect())
    late = bounded_lookup(df, bounds, "b", (1 << 26) - 5000, 1 << 26)
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    assert "ord#" in plan and ">= " in plan
    bound = bounds.where("chrom = 'b'").orderBy(F.desc("win")).first().bound
    assert df.where(F.col("ord") >= bound).count() < 600  # of 3,000


def test_custom_windows(spark):
    f = sparse(80, 2)
    df = spark.createDataFrame(f, SCHEMA)
    bins = Bins(8, 3, 8, 8)
    for s in (0, 1 << 22, 1 << 25):
        assert sorted(bounded_lookup(df, linear_bounds(df, bins), "a", s, s + 9999, bins).collect()) == sorted(lookup(df, "a", s, s + 9999).collect())
    with pytest.raises(ValueError, match="no linear index"):
        linear_bounds(df, TABIX.without_linear())


@pytest.mark.parametrize("ordered", [1, 7, 1 << 20])
def test_order_over_ranges(spark, monkeypatch, ordered):
    """Sequences of many ranges, ranges of many sequences, and empty ones."""
    monkeypatch.setattr(index, "ORDERED", ordered)
    rng = random.Random(ordered)
    rows = [("hot", rng.randrange(50), 0, o) for o in rng.sample(range(1000), 60)] + [(rng.choice("abcdef"), rng.randrange(9), 0, 5000 + i) for i in range(30)] + [(None, 9, 0, 1), (None, 3, 0, 2)]
    want, last = [], {}
    for c, s, _, o in sorted(rows, key=lambda r: r[3]):
        if last.get(c, -1) > s:
            want.append((c, o, last[c]))
        last[c] = s
    got = unsorted(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert sorted(((r.chrom, r.ord, r.previous) for r in got.collect()), key=str) == sorted(want, key=str) and want
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000  # no literal for each range
    assert unsorted(spark.createDataFrame([], SCHEMA)).collect() == []
