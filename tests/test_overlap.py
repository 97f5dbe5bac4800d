"""Overlap joins against brute force, and the store round trip."""

import gzip
import random

import pytest

from rangeloom import cli
from rangeloom.errors import IntervalError, InvalidIntervalError, StoreError, StoreExistsError, UnsortedFeaturesError
from rangeloom.functions import DENSE, SPARSE, TABIX, UCSC, Bins
from rangeloom.operators import bins_by_chrom, bin_summary, check_sorted, coverage, in_index_order, level_stats, linear_index, linear_lookup, lookup, map_overlapping, overlap_counts, overlap_join, overlap_left, overlap_semi, overlapping_records, report, size_histogram, size_stats, summary
from rangeloom.sources import IntervalStore, default_output, discover, display, has_header, line, pack, random_bed, read_bed, read_bed_sniffed, read_regions, write_tsv
from rangeloom.streaming import overlap_stream

F_SCHEMA = "chrom string, start long, end long, ord long"
Q_SCHEMA = "qid long, chrom string, qstart long, qend long"


def some(n, seed, most=1 << 22):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.choice([rng.randrange(most), 1 << rng.randrange(22), (1 << rng.randrange(1, 22)) - 1])
        out.append((rng.choice(["chr1", "chr2", "chrX"]), s, s + rng.choice([1, rng.randrange(1, 300), 1 << rng.randrange(20)])))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    f = [(*r, i) for i, r in enumerate(some(400, 1))]
    q = [(i, *r) for i, r in enumerate(some(150, 2))] + [(900, "chr1", 0, 1 << 22), (901, "chr9", 1, 5)]
    return f, q, spark.createDataFrame(f, F_SCHEMA).repartition(3), spark.createDataFrame(q, Q_SCHEMA).repartition(2)


def pairs(f, q):
    return sorted((a[3], b[0]) for a in f for b in q if a[0] == b[1] and a[1] < b[3] and a[2] > b[2])


@pytest.mark.parametrize("bins", [TABIX, UCSC, DENSE, SPARSE, Bins(8, 2, 9)], ids=lambda b: b.label)
def test_join(tables, bins):
    f, q, df, dq = tables
    assert sorted((r.ord, r.qid) for r in overlap_join(df, dq, bins).collect()) == pairs(f, q)


def test_variants(tables):
    f, q, df, dq = tables
    want = pairs(f, q)
    counts = {i: sum(1 for _, b in want if b == i) for i, *_ in q}
    assert {r.qid: r.n for r in overlap_counts(df, dq, zeros=True).collect()} == counts
    assert {r.qid: r.n for r in overlap_counts(df, dq).collect()} == {k: n for k, n in counts.items() if n}
    hit = {a for a, _ in want}
    assert sorted(r.ord for r in overlap_semi(df, dq).collect()) == sorted(hit)
    assert sorted(r.ord for r in overlap_semi(df, dq, anti=True).collect()) == sorted({a[3] for a in f} - hit)
    assert sorted(r.ord for r in overlapping_records(df, dq).collect()) == [a for a, _ in want]
    left = overlap_left(df, dq).collect()
    assert len(left) == len(want) + sum(n == 0 for n in counts.values())
    bases = {r.qid: (r.n, r.bases) for r in coverage(df, dq).collect()}
    for i, c, s, e in q:
        assert bases[i] == (counts[i], sum(min(a[2], e) - max(a[1], s) for a in f if a[0] == c and a[1] < e and a[2] > s))


def test_edges(spark):
    df = spark.createDataFrame([("c", 10, 20, 0), ("c", 0, 100, 1), ("c", 1_000_000, 1_000_100, 2)], F_SCHEMA)
    got = lambda s, e: sorted(r.ord for r in lookup(df, "c", s, e).collect())
    assert got(20, 30) == [1] and got(0, 10) == [1] and got(500_000, 2_000_000) == [2] and got(19, 20) == [0, 1]
    with pytest.raises(InvalidIntervalError):
        lookup(df, "c", 5, 5)
    bad = spark.createDataFrame([(1, "c", 7, 7), (2, "c", 15, 16)], Q_SCHEMA)
    with pytest.raises(Exception, match="invalid interval"):
        overlap_join(df, bad).collect()
    assert sorted(r.ord for r in overlap_join(df, bad, strict=False).collect()) == [0, 1]
    assert lookup(df, "absent", 1, 5).count() == 0
    # a region that goes on past the bins' range still meets what is inside
    far = spark.createDataFrame([(1, "c", 0, 600_000_000)], Q_SCHEMA)
    assert overlap_join(df, far, UCSC).count() == 3
    assert map_overlapping(df, "c", 0, 50, lambda it: it, df.schema).count() == 2
    order = [r.ord for r in in_index_order(df, TABIX).collect()]
    assert order == [0, 1, 2]


def test_same_index_query(spark):
    df = spark.createDataFrame([("chr1", i, i + 500, i) for i in range(0, 1_000_000, 1000)], F_SCHEMA)
    assert lookup(df, "chr1", 25_000, 35_000).count() == 10
    assert overlap_join(df, spark.createDataFrame([(1, "chr1", 25_000, 35_000)], Q_SCHEMA)).count() == 10


def test_sorted_and_linear(spark):
    fine = spark.createDataFrame([("a", 1, 5, 0), ("b", 0, 2, 1), ("a", 1, 9, 2)], F_SCHEMA)
    check_sorted(fine)
    with pytest.raises(UnsortedFeaturesError):
        check_sorted(spark.createDataFrame([("chr1", 2000, 3000, 0), ("chr1", 1000, 2000, 1)], F_SCHEMA))
    lin = linear_index(spark.createDataFrame([("a", 16_000, 17_000, 4), ("a", 16_500, 16_600, 3)], F_SCHEMA))
    assert {(r.win, r.min_ord) for r in lin.collect()} == {(0, 4), (1, 3)}
    assert {r.qid: r.min_ord for r in linear_lookup(spark.createDataFrame([(1, "a", 0, 5), (2, "a", 99_999, 100_000)], Q_SCHEMA), lin).collect()} == {1: 4, 2: None}
    with pytest.raises(ValueError):
        linear_index(fine, "tabix-no-linear")


def test_stats(spark):
    df = spark.createDataFrame([("a", 0, n, n) for n in (1, 2, 3, 4)] + [("b", 0, 1 << 20, 9)], F_SCHEMA)
    s = size_stats(df.where("chrom = 'a'")).first()
    assert (s.min_size, s.max_size, s.mean_size, s.median_size) == (1, 4, 2.5, 3)
    assert tuple(size_stats(df.limit(0)).first()) == (0, 0, 0.0, 0)
    assert {r.bucket: r.n for r in size_histogram(df).collect()} == {0: 1, 1: 2, 2: 1, 20: 1}
    b = bin_summary(df).first()
    assert (b.total_features, b.total_bins_used, b.chrom_bins_used) == (5, 2, 2)
    assert bin_summary(df.limit(0)).first().bin_density == 0.0
    assert {r.level: r.features_count for r in level_stats(df).collect()} == {3: 1, 5: 4}
    assert "Tabix" in summary(df) and "sizes: 1 to" in report(df)
    assert [tuple(r) for r in bins_by_chrom(df).collect()] == [("a", 4681), ("b", 73)]


BED = "#comment\nchr1\t10\t20\tname\t5\t+\n\nchr2\t5\t9\nchr1\t0\t7\tx\n"


def test_bed(spark, tmp_path):
    plain, packed, odd = tmp_path / "a.bed", tmp_path / "a.bed.gz", tmp_path / "b.bed"
    plain.write_text(BED)
    packed.write_bytes(gzip.compress(BED[:30].encode()) + gzip.compress(BED[30:].encode()))
    odd.write_bytes(gzip.compress(BED.encode()))
    want = [("chr1", 0, 7, "x"), ("chr1", 10, 20, "name\t5\t+"), ("chr2", 5, 9, "")]
    for rows in (read_bed(spark, str(plain)), read_bed(spark, str(packed)), read_bed_sniffed(spark, str(odd))):
        assert sorted(map(tuple, rows.collect())) == want
    lines = sorted(r[0] for r in read_bed(spark, str(plain)).select(line()).collect())
    assert lines == ["chr1\t0\t7\tx", "chr1\t10\t20\tname\t5\t+", "chr2\t5\t9\t"]
    assert sorted(r[0] for r in read_bed(spark, str(plain)).select(display()).collect()) == ["0\t7\tx", "10\t20\tname\t5\t+", "5\t9"]
    assert has_header(spark, str(plain), "#com") and not has_header(spark, str(plain), "chr")
    for text, one in (("chr1\tx\t5", False), ("chr1\t5", False), ("chr1\t5\t5", False), ("chr1\t0\t5", True)):
        plain.write_text(text)
        with pytest.raises(Exception, match="not an interval|end not above|below 1"):
            read_bed(spark, str(plain), one_based=one).collect()
    plain.write_text("chr1\t1\t5")
    assert tuple(read_bed(spark, str(plain), one_based=True).first())[:3] == ("chr1", 0, 5)


def test_store(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([("chr2", 50_000, 60_000, "f3", 1.5), ("chr1", 1500, 2500, "f2", 2.5), ("chr1", 1000, 2000, "f1", 0.5)], "chrom string, start long, end long, name string, score double")
    store = IntervalStore.create(rows, path, key="k", metadata={"name": "t", "values": {"a": 1}}, bins=SPARSE)
    again = IntervalStore.open(spark, path, "k")
    assert again.metadata == {"name": "t", "values": {"a": 1}} and again.bins == SPARSE
    assert sorted(map(tuple, again.rows().collect())) == sorted(map(tuple, rows.collect()))
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(again.get_overlapping("chr1", 1200, 1800)) == ["f1", "f2"] and names(again.get_overlapping("chr1", 3000, 4000)) == []
    assert names(again.query("chr2:55001-58000")) == ["f3"] and names(again.get_overlapping("chr3", 1, 2)) == []
    regions = spark.createDataFrame([(1, "chr1", 0, 1600), (2, "chr1", 1900, 1950)], Q_SCHEMA)
    assert names(again.query_regions(regions)) == ["f1", "f1", "f2", "f2"] and again.join_regions(regions).count() == 4
    assert again.map_overlapping("chr1", 0, 9999, lambda it: it, rows.schema).count() == 2 and again.chrom("chr2").count() == 1
    assert "Sparse" in again.summary() and "sizes" in store.report()
    plan = again.get_overlapping("chr1", 1200, 1800)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "LessThan(start,1800)" in plan
    with pytest.raises(StoreExistsError):
        IntervalStore.create(rows, path, key="k")
    IntervalStore.create(rows.limit(0), path, key="k", overwrite=True)
    assert IntervalStore.open(spark, path, "k").rows().count() == 0 and IntervalStore.open(spark, path, "k").metadata is None
    with pytest.raises(StoreError):
        IntervalStore.open(spark, str(tmp_path))
    with pytest.raises(Exception, match="must not be null"):
        IntervalStore.create(spark.createDataFrame([("c", 5, 5)], "chrom string, start long, end long"), str(tmp_path / "bad"))


def test_cli(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "x.bed").write_text(BED)
    (tmp_path / "r.bed").write_text("chr1\t0\t11\nchr2\t0\t6\n")
    assert default_output("a/x.bed.gz") == "a/x.intervals" and default_output("x.bed") == "x.intervals"
    with pytest.raises(StoreError):
        discover(str(tmp_path))
    cli.run(spark, ["pack", at("x.bed")])
    assert discover(str(tmp_path)) == at("x.intervals")
    with pytest.raises(StoreExistsError):
        cli.run(spark, ["pack", at("x.bed")])
    cli.run(spark, ["pack", at("x.bed"), "--force", "--schema", "tabix"])
    capsys.readouterr()
    cli.run(spark, ["query", "chr1:1-10", "-i", at("x.intervals")])
    assert capsys.readouterr().out == "chr1\t0\t7\tx\n"
    cli.run(spark, ["query", "-i", at("x.intervals"), "--regions", at("r.bed"), "-o", at("out.gz")])
    assert sorted(r[0] for r in spark.read.text(at("out.gz")).collect()) == ["chr1\t0\t7\tx", "chr1\t10\t20\tname\t5\t+", "chr2\t5\t9\t"]
    cli.run(spark, ["stats", at("x.intervals"), "--show-bins"])
    assert "chr2\t4681" in capsys.readouterr().out
    with pytest.raises(IntervalError):
        cli.run(spark, ["query", "-i", at("x.intervals")])
    cli.run(spark, ["random-bed", "-o", at("rand"), "-n", "50", "-s", "3"])
    assert read_bed(spark, at("rand")).count() == 50 and read_regions(spark, at("rand")).select("qid").distinct().count() == 50
    assert pack(spark, at("rand"), at("rand.store"), bins="ucsc").bins == UCSC
    (tmp_path / "y.intervals").mkdir()
    with pytest.raises(StoreError, match="several"):
        discover(str(tmp_path))


def test_random(spark, tmp_path):
    a, b = (random_bed(spark, 300, 5, 2).collect() for _ in range(2))
    assert a == b and a == sorted(a, key=lambda r: (r.chrom, r.start, r.end)) and all(100 <= r.end - r.start < 10_000 for r in a)
    write_tsv(random_bed(spark, 20, 1), str(tmp_path / "o"), ordered=True)
    assert read_bed(spark, str(tmp_path / "o")).count() == 20


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("c", 10, 20, 0), ("c", 100, 200, 1)], F_SCHEMA)
    spark.createDataFrame([(1, "c", 15, 120), (2, "c", 300, 400)], Q_SCHEMA).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(Q_SCHEMA).parquet(str(tmp_path / "q"))
    with pytest.raises(ValueError):
        overlap_stream(df, df)
    q = overlap_stream(df, stream).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.ord, r.qid) for r in spark.table("hits").collect()) == [(0, 1), (1, 1)]


def test_plan_has_no_nested_loop(tables):
    *_, df, dq = tables
    plan = overlap_join(df, dq)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
