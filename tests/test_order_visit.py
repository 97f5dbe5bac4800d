"""Orders that last through the files, and functions that are called for each row."""

import random

import pytest
from pyspark.sql import functions as F

from rangeloom.errors import VisitError
from rangeloom.functions import TABIX
from rangeloom.operators import visit
from rangeloom.sources import IntervalStore, numbered_lines, read_regions, write_tsv

SCHEMA = "chrom string, start long, end long, rest string, qid long"


@pytest.fixture
def small_splits(spark):
    """Splits so small that files have several."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path, small_splits):
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(600)]
    cuts = [0, 1, 1, 250, 251, 590, 600]
    (tmp_path / "in").mkdir()
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        n = [2, 9, 10, 99_999, 100_000, 100_001][i]  # numbers that names don't sort by
        (tmp_path / "in" / f"part-{n:05d}-u-c000.txt").write_text("".join(f"{x}\n" for x in lines[a:b]))
    found = numbered_lines(spark, str(tmp_path / "in"))
    assert found.rdd.getNumPartitions() > 20
    assert sorted((r.line_no, r.value) for r in found.collect()) == list(enumerate(lines))
    some = numbered_lines(spark, str(tmp_path / "in"), lambda v: v.endswith("xx"))
    assert sorted((r.line_no, r.value) for r in some.collect()) == list(enumerate(x for x in lines if x.endswith("xx")))
    assert numbered_lines(spark, str(tmp_path / "in"), lambda v: v == "").count() == 0


def test_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    plan = numbered_lines(spark, str(tmp_path / "a.txt"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(file" not in plan


def test_regions_of_several_files(spark, tmp_path, small_splits):
    (tmp_path / "b.bed").write_text("#c\n" + "".join(f"chr1\t{i}\t{i + 1}\r\n\n" for i in range(100)))
    (tmp_path / "a.bed").write_text("".join(f"chr2\t{i}\t{i + 1}\tmore\n# c\n" for i in range(100)))
    got = sorted((r.qid, r.chrom, r.qstart) for r in read_regions(spark, [str(tmp_path / "b.bed"), str(tmp_path / "a.bed")]).collect())
    assert got == [(i, "chr2" if i < 100 else "chr1", i % 100) for i in range(200)]


@pytest.mark.parametrize("ending", ["", ".gz"])
def test_results_come_in_the_regions_order(spark, tmp_path, ending):
    rng = random.Random(3)
    f = [(rng.choice("ab"), s := rng.randrange(1 << 18), s + rng.choice([1, 40_000, 1 << 17]), f"r{i % 7}", i % 3) for i in range(300)]
    q = [(i, rng.choice("abc"), s := rng.randrange(1 << 18), s + rng.choice([1, 9000])) for i in rng.sample(range(900), 80)]
    store = IntervalStore.create(spark.createDataFrame(f, SCHEMA).repartition(3), str(tmp_path / "s"), bins="tabix", files=4)
    found = store.query_regions(spark.createDataFrame(q, "qid long, chrom string, qstart long, qend long"), order_by="qid")
    assert found.columns == [x.split()[0] for x in SCHEMA.split(", ")]

    def walk(x):
        sh = next(sh for _, _, sh in TABIX.finest_first if x[1] >> sh == (x[2] - 1) >> sh)
        return sh, x[1] >> sh, x

    want = [x for _, c, s, e in sorted(q) for x in sorted((x for x in f if x[0] == c and x[1] < e and x[2] > s), key=walk)]
    assert len(want) > 100 and [tuple(r) for r in found.collect()] == want
    write_tsv(found, str(tmp_path / f"out{ending}"))
    lines = sorted((r.line_no, r.value) for r in numbered_lines(spark, str(tmp_path / f"out{ending}")).collect())
    assert [v for _, v in lines] == ["\t".join(map(str, x[:4])) for x in want]


def test_visit_counts(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(0, 5000, 1, 7).select("id", F.lit(None).cast("string").alias("none"))
    assert visit(rows, lambda r: seen.add(r["id"])) == 5000
    assert seen.value == sum(range(5000))
    assert visit(rows.where("id < 0"), lambda r: 1 / 0) == 0


def test_visit_stops(spark, tmp_path):
    """The partition of a failure ends there; those behind its wave don't run."""

    def touch(row):
        part = row["id"] // 100
        (tmp_path / str(part)).touch()
        if row["id"] in (130, 131):
            raise KeyError("no such name")

    rows = spark.range(0, 10_000, 1, 100)
    with pytest.raises(VisitError, match="KeyError") as e:
        visit(rows, touch)
    assert e.value.row == {"id": 130} and e.value.error == "KeyError: 'no such name'"
    ran = {int(p.name) for p in tmp_path.iterdir()}
    assert {0, 1} <= ran and max(ran) < 10
    assert e.value.seen == 100 * (len(ran) - 1) + 30


def test_visit_of_a_store(spark, tmp_path):
    rows = spark.range(100).select(F.lit("a").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 2).alias("end"))
    store = IntervalStore.create(rows, str(tmp_path / "s"))
    assert store.visit("a", 10, 20, lambda r: None) == 11
    assert store.visit("b", 10, 20, lambda r: 1 / 0) == 0
    with pytest.raises(VisitError) as e:
        store.visit("a", 10, 20, lambda r: 1 / (r["start"] - 15))
    assert e.value.row["start"] == 15
