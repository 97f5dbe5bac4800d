"""Overlap joins where regions are wide, lie below 0, or clash; their plans; and what stays bounded at scale."""

import random

import pytest
from pyspark.sql import functions as F

from rangeloom.errors import InvalidIntervalError, StoreError
from rangeloom.functions import DENSE, TABIX, Bins
from rangeloom.operators import coverage, index, linear_index, overlap, overlap_counts, overlap_join, overlap_left, overlap_semi, size_stats, stats, unsorted
from rangeloom.sources import IntervalStore, compare_sizes, parse_lines

F_SCHEMA = "chrom string, start long, end long, ord long"
Q_SCHEMA = "qid long, chrom string, qstart long, qend long"


def pairs(f, q):
    return sorted((a[3], b[0]) for a in f for b in q if None not in (*a[:3], *b[1:]) and a[0] == b[1] and a[1] < b[3] and a[2] > b[2])


def joined(df):
    return sorted((r.ord, r.qid) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def far(spark):
    """Lengths of 1 to 2**36, starts on both sides of 0, regions from 1 to everything."""
    rng = random.Random(9)
    f = [("a" if i % 3 else "b", s := rng.choice([rng.randrange(-1000, 1 << 34), rng.randrange(-50, 50), (1 << rng.randrange(34)) - 1]), s + rng.choice([1, 2, rng.randrange(1, 3000), 1 << rng.randrange(36)]), i) for i in range(250)]
    f += [(None, 5, 9, 900), ("a", None, 9, 901)]
    q = [(i, "ab"[i % 2], s := rng.randrange(-2000, 1 << 34), s + rng.choice([1, 700, 1 << rng.randrange(34)])) for i in range(60)]
    q += [(100, "a", -(1 << 40), 1 << 50), (101, "b", -100, 50), (102, "b", -(1 << 62), -(1 << 61)), (103, None, 0, 9), (104, "a", None, 9), (105, "z", 0, 9)]
    return f, q, spark.createDataFrame(f, F_SCHEMA).repartition(3), spark.createDataFrame(q, Q_SCHEMA).repartition(2)


@pytest.mark.parametrize("most", [0, overlap.BROADCAST_BYTES])
def test_wide_and_negative_regions(far, monkeypatch, most):
    f, q, df, dq = far
    monkeypatch.setattr(overlap, "BROADCAST_BYTES", most)
    monkeypatch.setattr(overlap, "DEALT", 200)
    want = pairs(f, q)
    assert joined(overlap_join(df, dq)) == want
    hit = {a for a, _ in want}
    assert sorted(r.ord for r in overlap_semi(df, dq).collect()) == sorted(hit)
    assert sorted(r.ord for r in overlap_semi(df, dq, anti=True).collect()) == sorted({a[3] for a in f} - hit)


def test_few_visits_whatever_the_width(spark, far):
    _, _, df, dq = far
    sides = overlap._sides(df, overlap._regions(dq, "__q_", "qstart", "qend", True), None, ("chrom", "start", "end", "__q_chrom", "__q_qstart", "__q_qend"), None)
    assert len(sides.by_width()) > 1
    most = sides.visits().select(F.max(F.col("__v_b") - F.col("__v_a"))).first()[0]
    assert most < overlap.FAN_OUT


def test_bound_of_visits(spark, far):
    """No visit is of a class and width that the bound leaves out, nor are there more, also where regions are cut at the first start."""
    f, q, df, _ = far
    first = min(x[1] for x in f if x[1] is not None)
    edges = [(1000 + i, "a", first - d, first + (n << w) + e) for i, (d, n, w, e) in enumerate((d, n, w, e) for d in (0, 9) for n in (511, 512) for w in (9, 14, 17, 25) for e in (-1, 0, 1, 2))]
    for own in (q, edges, q[:1], *([e] for e in edges[3::7])):
        regions = overlap._regions(spark.createDataFrame(own, Q_SCHEMA), "__q_", "qstart", "qend", True)
        spread = overlap.Spread(tuple(range(1, 37)), first, 1 << 35)
        sides = overlap._sides(df, regions, None, ("chrom", "start", "end", "__q_chrom", "__q_qstart", "__q_qend"), spread)
        lengths = overlap._lengths(sides.regions, "__q_qstart", "__q_qend", spread)
        every = overlap.replace(sides, kinds=overlap.kinds_of(spread, max(overlap.FINEST, overlap._middling(lengths) - 1)))
        n = F.col("__v_b") - F.col("__v_a") + 1
        actual = {r[0]: r.n for r in every.visits().groupBy("__v_kind").agg(F.sum(n).alias("n")).collect()}
        most = {k * 8 + j: overlap._most_visits(lengths, k, j, w)[0] for k, j, w in sides.kinds}
        assert actual.keys() <= most.keys() and all(n <= most[k] for k, n in actual.items())
        assert sorted((k, j, w) for k, j, w in every.kinds if k * 8 + j in most) == sorted(sides.kinds)


def test_region_below_zero_meets_a_feature_once(spark):
    df = spark.createDataFrame([("c", 0, (1 << 26) + 5, 1)], F_SCHEMA)
    assert joined(overlap_join(df, spark.createDataFrame([(7, "c", -100, 50)], Q_SCHEMA), TABIX)) == [(1, 7)]


@pytest.mark.parametrize("b", [TABIX, DENSE, Bins(8, 2, 9)], ids=lambda b: b.label)
def test_bins_of_what_is_covered(spark, b):
    rows = [(-100, 50), (-5, 0), (-9, -3), (0, 1), (b.limit - 1, b.limit + 5), (b.limit, b.limit + 1), (5, 5)]
    s, e = F.col("s"), F.col("e")
    b.register(spark, "own")
    df = spark.createDataFrame(rows, "s long, e long").select("s", "e", b.bins_of(s, e).alias("ids"), b.fan_out(s, e).alias("n"), F.expr("own_bins(s, e)").alias("sql"))
    for r in df.collect():
        assert r.ids == r.sql == b.bin_ids(r.s, r.e) and len(set(r.ids)) == len(r.ids) == r.n
    for bad in (-1, 5), (b.limit - 1, b.limit + 1), (5, 5):
        with pytest.raises(Exception, match="does not fit"):
            spark.sql(f"SELECT own_bin({bad[0]}L, {bad[1]}L)").collect()


def test_a_scheme_limits_features(spark):
    df = spark.createDataFrame([("c", (1 << 29) - 1, (1 << 29) + 1, 1)], F_SCHEMA)
    q = spark.createDataFrame([(7, "c", 1 << 29, (1 << 29) + 1)], Q_SCHEMA)
    assert joined(overlap_join(df, q)) == joined(overlap_join(df, q, DENSE)) == [(1, 7)]
    with pytest.raises(Exception, match="does not fit"):
        overlap_join(df, q, TABIX).collect()


def test_semi_checks_regions_as_the_join_does(spark):
    df = spark.createDataFrame([("c", 10, 20, 0)], F_SCHEMA)
    bad = spark.createDataFrame([(1, "c", 7, 7), (2, "c", 15, 16)], Q_SCHEMA)
    for anti in (False, True):
        with pytest.raises(Exception, match="invalid interval"):
            overlap_semi(df, bad, anti=anti).collect()
    assert [r.ord for r in overlap_semi(df, bad, strict=False).collect()] == [0]


def test_invalid_features_fail(spark):
    q = spark.createDataFrame([(2, "c", 15, 16)], Q_SCHEMA)
    with pytest.raises(Exception, match="invalid interval"):
        overlap_join(spark.createDataFrame([("c", 20, 20, 0)], F_SCHEMA), q).collect()


def test_columns_of_one_name_stay(spark):
    df = spark.createDataFrame([("c", 1, 5, "f")], "chrom string, start long, end long, rest string")
    q = spark.createDataFrame([("c", 2, 3, "q", 8)], "chrom string, qstart long, qend long, REST string, start long")
    got = overlap_join(df, q)
    assert got.columns == ["chrom", "start", "end", "rest", "qstart", "qend", "region_REST", "region_start"]
    assert tuple(got.first()) == ("c", 1, 5, "f", 2, 3, "q", 8)


def test_null_keys_are_counted(spark):
    df = spark.createDataFrame([("c", 1, 5, 0), ("c", 2, 9, 1)], F_SCHEMA)
    q = spark.createDataFrame([(None, "c", 2, 3), (1, "c", 50, 51)], Q_SCHEMA)
    assert {r.qid: r.n for r in overlap_counts(df, q, zeros=True).collect()} == {None: 2, 1: 0}
    assert {r.qid: (r.n, r.bases) for r in coverage(df, q).collect()} == {None: (2, 2), 1: (0, 0)}
    assert sorted((str(r.qid), str(r.ord)) for r in overlap_left(df, q).collect()) == [("1", "None"), ("None", "0"), ("None", "1")]


def test_empty_sides(spark):
    df, q = spark.createDataFrame([("c", 1, 5, 0)], F_SCHEMA), spark.createDataFrame([(1, "c", 2, 3)], Q_SCHEMA)
    for a, b in ((df.limit(0), q), (df, q.limit(0)), (df.limit(0), q.limit(0))):
        assert overlap_join(a, b).count() == 0 and overlap_semi(a, b).count() == 0 and overlap_semi(a, b, anti=True).count() == a.count()


def test_plan_reads_each_side_once(spark, monkeypatch):
    from rangeloom.plans import fixtures

    d, names = "/root/testdata/sf0.001", {"start": "istart", "end": "iend"}
    f, q = fixtures.features(spark, d), fixtures.regions(spark, d)
    small = plan(overlap_join(f, q, **names))
    assert small.count("FileScan") == 2 and "BroadcastHashJoin" in small
    monkeypatch.setattr(overlap, "BROADCAST_BYTES", 0)
    large = plan(overlap_join(f, q, **names))
    assert large.count("FileScan") == 2 and "SortMergeJoin" in large and "Broadcast" not in large and "Python" not in large


def test_candidates_are_few(spark):
    from rangeloom.plans import fixtures

    d = "/root/testdata/sf0.01"
    cols = ("chrom", "istart", "iend", "__q_chrom", "__q_qstart", "__q_qend")
    sides = overlap._sides(fixtures.features(spark, d), overlap._regions(fixtures.regions(spark, d), "__q_", "qstart", "qend", True), None, cols, None)
    f = sides.coded_features("c").groupBy("chrom", "c").agg(F.count(F.lit(1)).alias("n"))
    q = sides.coded_regions("d").groupBy("__q_chrom", "d").agg(F.count(F.lit(1)).alias("m"))
    met = f.join(q, (F.col("c") == F.col("d")) & (F.col("chrom") == F.col("__q_chrom"))).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    assert met <= 4 * sides.join("inner").count()


def test_linear_index_of_long_features(spark):
    rng = random.Random(4)
    rows = [("ab"[i % 2], s := rng.randrange(1 << 22), s + rng.choice([1, 300, 1 << rng.randrange(24)]), rng.randrange(10_000)) for i in range(150)]
    want = {}
    for c, s, e, o in rows:
        for w in range(s >> 8, ((e - 1) >> 8) + 1):
            want[c, w] = min(want.get((c, w), o), o)
    got = linear_index(spark.createDataFrame(rows, F_SCHEMA), DENSE)
    assert got.columns == ["chrom", "win", "min_ord"] and {(r.chrom, r.win): r.min_ord for r in got.collect()} == want
    assert linear_index(spark.createDataFrame([], F_SCHEMA), DENSE).count() == 0


@pytest.mark.parametrize("ordered", [7, index.ORDERED])
def test_unsorted_over_ranges(spark, monkeypatch, ordered):
    monkeypatch.setattr(index, "ORDERED", ordered)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i + rng.randrange(4), i + 9, i * 3) for i in range(120)]
    want, last = [], {}
    for c, s, _, o in rows:
        if last.get(c, s) > s:
            want.append((o, last[c]))
        last[c] = s
    assert sorted((r.ord, r.previous) for r in unsorted(spark.createDataFrame(rows, F_SCHEMA).repartition(3), "ord").collect()) == want


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_median_by_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(stats, "_RANGE_BITS", ranges)
    rng = random.Random(ranges)
    for n in (1, 2, 9, 50):
        sizes = [rng.choice([1, 2, 3, rng.randrange(1, 500), 1 << rng.randrange(40)]) for _ in range(n)]
        got = size_stats(spark.createDataFrame([("a", 5, 5 + x, 0) for x in sizes], F_SCHEMA)).first()
        assert (got.min_size, got.max_size, got.median_size) == (min(sizes), max(sizes), sorted(sizes)[n // 2]) and got.mean_size == pytest.approx(sum(sizes) / n)


def test_sequences_need_names(spark, tmp_path):
    with pytest.raises(Exception, match="no sequence name"):
        parse_lines(spark.createDataFrame([("\t1\t5",)], "value string")).collect()
    for name in ("", None, "__HIVE_DEFAULT_PARTITION__"):
        with pytest.raises(Exception, match="must be a name"):
            IntervalStore.create(spark.createDataFrame([(name, 1, 5)], "chrom string, start long, end long"), str(tmp_path / "s"))
    with pytest.raises(StoreError):
        IntervalStore.open(spark, str(tmp_path / "s"))


def test_overwriting_keeps_the_store_until_rows_are_there(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([("c", 1, 5)], "chrom string, start long, end long")
    IntervalStore.create(rows, path)
    with pytest.raises(Exception, match="must be a name"):
        IntervalStore.create(spark.createDataFrame([("c", 5, 5)], rows.schema), path, overwrite=True)
    assert [tuple(r) for r in IntervalStore.open(spark, path).rows().collect()] == [("c", 1, 5)]
    own = IntervalStore.create(IntervalStore.open(spark, path).rows().withColumn("end", F.col("end") + 1), path, overwrite=True)
    assert [tuple(r) for r in own.rows().collect()] == [("c", 1, 6)] and own.spread == overlap.Spread((3,), 1, 1)


def test_sizes(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 100)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c").write_bytes(b"x" * 50)
    assert [(r.bytes, r.ratio) for r in compare_sizes(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()] == [(100, 1.0), (50, 0.5)]


def test_lookup_needs_an_interval(spark):
    with pytest.raises(InvalidIntervalError):
        overlap.lookup(spark.createDataFrame([], F_SCHEMA), "c", 9, 9)
