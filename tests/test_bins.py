"""Bin arithmetic: fixed values, and Column expressions against the plain-Python twin."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rangeloom.errors import CoordinateRangeError, InvalidIntervalError, RegionParseError
from rangeloom.functions import DENSE, PRESETS, SPARSE, TABIX, UCSC, Bins, parse_region, parse_regions, scheme

SHAPES = [TABIX, UCSC, DENSE, SPARSE]


def test_levels_and_offsets():
    assert Bins(14, 3, 5).sizes == [1, 8, 64, 512, 4096]
    assert [first for _, first, _ in Bins(14, 3, 5).finest_first] == [585, 73, 9, 1, 0]
    assert [first for _, first, _ in TABIX.finest_first] == [4681, 585, 73, 9, 1, 0]
    assert [b.total for b in SHAPES] == [37449, 4681, 153391689, 4369]
    assert TABIX.limit == 1 << 29 and DENSE.limit == 1 << 41 and SPARSE.limit == 1 << 32


@pytest.mark.parametrize(
    ("start", "end", "bin_id"),
    [(100000000, 100000100, 1347), (0, 1000, 585), (1000000, 2000000, 9), (10000000, 20000000, 1), (100000000, 200000000, 0), (0, 500000000, 0), (0, 131072, 585), (131072, 262144, 586)],
)
def test_known_bins(start, end, bin_id):
    assert UCSC.bin_id(start, end) == bin_id


@settings(max_examples=300)
@given(st.integers(0, 999_999), st.integers(1, 999_999), st.sampled_from(SHAPES))
def test_bins_of_an_interval(start, length, b):
    ids = b.bin_ids(start, start + length)
    assert ids and len(set(ids)) == len(ids) and max(ids) < b.total and b.bin_id(start, start + length) in ids


@pytest.mark.parametrize("b", SHAPES, ids=lambda b: b.label)
def test_columns_equal_python(spark, b):
    edges = [0, 1, 255, 256, 16383, 16384, 16385, 131071, 131072, 1 << 20, (1 << 20) + 1, (1 << 28) - 1, 1 << 28]
    rows = [(s, e) for s in edges for e in edges if e > s]
    df = spark.createDataFrame(rows, "start long, end long")
    s, e = F.col("start"), F.col("end")
    for r in df.select("start", "end", b.bin_of(s, e).alias("own"), b.bins_of(s, e).alias("ids") if b is not DENSE else F.lit(None).alias("ids"), b.fan_out(s, e).alias("n"), b.level_of(b.bin_of(s, e)).alias("level")).collect():
        assert r.own == b.bin_id(r.start, r.end)
        assert r.ids is None or r.ids == b.bin_ids(r.start, r.end)
        assert r.n == sum(((r.end - 1) >> sh) - (r.start >> sh) + 1 for _, _, sh in b.finest_first)
        assert b.offsets[r.level] <= r.own < b.offsets[r.level] + b.sizes[r.level]


def test_errors():
    with pytest.raises(InvalidIntervalError):
        TABIX.bin_id(5, 5)
    with pytest.raises(CoordinateRangeError):
        TABIX.bin_id((1 << 29) - 1, (1 << 29) + 1)
    assert SPARSE.bin_id(4294967290, 4294967295) == 273 + (4294967290 >> 20)
    with pytest.raises(ValueError):
        Bins(14, 10, 6)
    with pytest.raises(ValueError):
        scheme("none")
    assert scheme("Dense") is PRESETS["dense"] and not TABIX.without_linear().linear_shift


def test_bin_beyond_the_range_fails(spark):
    df = spark.createDataFrame([((1 << 29) - 1, (1 << 29) + 1)], "s long, e long")
    with pytest.raises(Exception, match="does not fit"):
        df.select(TABIX.bin_of(F.col("s"), F.col("e"))).collect()


def test_sql_functions(spark):
    SPARSE.register(spark, "sparse")
    row = spark.sql("SELECT sparse_bin(5L, 10L) AS b, sparse_bins(5L, 10L) AS bs, sparse_level(sparse_bin(5L, 10L)) AS l").first()
    assert row.b == SPARSE.bin_id(5, 10) and row.bs == SPARSE.bin_ids(5, 10) and row.l == 3


def test_regions(spark):
    assert parse_region("chr1:15000-17000") == ("chr1", 14999, 17000)
    assert parse_region("HLA-A:1-5") == ("HLA-A", 0, 5)
    for wrong in ("chr1", "chr1:5", "a:b:1-2", "chr1:0-5", "chr1:1-2-3", "chr1:a-5", ":1-2", "chr1:1,000-2,000"):
        with pytest.raises(RegionParseError):
            parse_region(wrong)
    with pytest.raises(InvalidIntervalError):
        parse_region("chr1:10-9")
    df = spark.createDataFrame([("chr1:5-9",), ("chr1",), (None,)], "region string")
    assert [tuple(r)[1:] for r in parse_regions(df, "region", strict=False).collect()] == [("chr1", 4, 9), (None, None, None), (None, None, None)]
    with pytest.raises(Exception, match="not a region"):
        parse_regions(df, "region").collect()
