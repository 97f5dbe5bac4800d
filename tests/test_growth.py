"""What must not come to one task, and what every run must say alike."""

import random

from pyspark.sql import functions as F

from rangeloom.functions import TABIX
from rangeloom.operators import layout, lines, overlap, unsorted
from rangeloom.plans.catalogue import QUERIES
from rangeloom.sources import IntervalStore

SF = "/root/testdata/sf0.001"


def test_region_file_is_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = QUERIES["region_file"](spark, SF)
        assert sum("/regions-" in f for f in found.inputFiles()) > 1
        own = [r.qid for r in found.orderBy("qid").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert own == list(range(len(own))) and own


def test_features_of_one_order(spark):
    rows = [("a", s, o) for o in range(3) for s in (5 + o, 9 + o, 7 + o)]
    for turned in (rows, rows[::-1]):
        found = unsorted(spark.createDataFrame(turned, "chrom string, start long, ord long").coalesce(1))
        assert sorted((r.ord, r.start, r.previous) for r in found.collect()) == [(1, 6, 9), (2, 7, 10)]


def _many_classes(spark):
    """Features of eight powers of 2, and regions of a middling length."""
    features = spark.range(4000).selectExpr("'a' AS chrom", "id * 9973 % 50000000 AS start", "id * 9973 % 50000000 + shiftleft(12000L, CAST(id % 8 AS int)) AS end")
    regions = spark.range(3000).selectExpr("'a' AS chrom", "id * 7919 % 50000000 AS qstart", "id * 7919 % 50000000 + 20000 AS qend", "id AS qid")
    return features, regions


def test_visits_of_a_region(spark):
    features, regions = _many_classes(spark)
    sides = overlap._sides(features, regions, None, ("chrom", "start", "end", "chrom", "qstart", "qend"), None)
    assert sides.coded_regions("code").count() < 13 * 3000


def test_regions_are_dealt_out_by_place(spark, monkeypatch):
    monkeypatch.setattr(overlap, "DEALT", 4000)
    monkeypatch.setattr(overlap, "BROADCAST_BYTES", 0)
    features, regions = _many_classes(spark)
    copies = regions.where("qid < 500").selectExpr("'a' AS chrom", "1000L AS qstart", "30000L AS qend", "qid + 10000 AS qid")
    every = regions.unionByName(copies).coalesce(1)
    sides = overlap._sides(features, every, None, ("chrom", "start", "end", "chrom", "qstart", "qend"), None)
    held = sides.regions.select("qstart", F.spark_partition_id().alias("task")).groupBy("task").agg(F.min("qstart").alias("a"), F.max("qstart").alias("b"), F.sum(F.expr("int(qstart = 1000)")).alias("n")).orderBy("a", "b").collect()
    assert len(held) > 4 and all(x.b <= y.a for x, y in zip(held, held[1:]))
    assert max(r.n for r in held) < 500
    found = overlap.overlap_join(features, every)
    assert found.count() == found.distinct().count() == every.join(features.drop("chrom"), (F.col("start") < F.col("qend")) & (F.col("end") > F.col("qstart"))).count()


def test_pairs_of_a_store_are_made_by_spark(spark, tmp_path, monkeypatch):
    """What leaves Python grows as rows and regions do, not as their pairs; and regions of one file are several tasks'."""
    monkeypatch.setattr(layout, "DEALT", 100)
    rows = spark.range(600).selectExpr("'a' AS chrom", "id AS start", "id + 500 + id % 700 AS end", "id AS ord")
    regions = spark.range(500).selectExpr("'a' AS chrom", "id AS qstart", "id + 400 + id % 300 AS qend", "id AS qid")
    packed = []
    expanded = layout._expanded
    monkeypatch.setattr(layout, "_expanded", lambda found, *rest: packed.append(found) or expanded(found, *rest))
    found = IntervalStore.create(rows, str(tmp_path / "s"), files=1).join_regions(regions)
    assert found.count() == rows.join(regions.drop("chrom"), overlap.overlaps(*map(F.col, ("start", "end", "qstart", "qend")))).count() > 200_000
    sizes = packed[0].select(F.sum(sum(F.size(c) for c in packed[0].columns[1:]))).first()[0]
    assert sizes < 40_000 and packed[0].rdd.getNumPartitions() == 5


def test_pairs_are_numbered_without_a_sort_of_them(spark, tmp_path, monkeypatch):
    for module, name, value in ((lines, "PIECE", 7), (lines, "STRIP", 3), (lines, "ONES", 4), (layout, "DEALT", 50)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(5)
    f = [(rng.choice("ab"), s := rng.randrange(1 << 18) // 3000 * 3000, s + rng.choice([1, 700, 40_000, 1 << 17]), rng.choice(["", "x", None]), i % 3) for i in range(300)]
    q = [(i, rng.choice("abc"), s := rng.randrange(1 << 18), s + rng.choice([1, 9000])) for i in rng.sample(range(900), 80)]
    rows = spark.createDataFrame(f, "chrom string, start long, end long, rest string, n int").repartition(3)
    store = IntervalStore.create(rows.where("n < 2"), str(tmp_path / "s"), bins=TABIX, files=4).append(rows.where("n = 2"))
    asked = spark.createDataFrame(q, "qid long, chrom string, qstart long, qend long")
    want = [tuple(r) for r in store.query_regions(asked, order_by="qid").collect()]
    twice = asked.withColumn("qid", F.expr("qid % 20"))
    want_twice = [tuple(r) for r in store.query_regions(twice, order_by="qid").collect()]
    lined = lambda df: [tuple(r)[1:] for i, r in enumerate(sorted(df.collect(), key=lambda r: r.line_no)) if r.line_no == i]
    assert lined(store.numbered_regions(twice, order_by="qid")) == want_twice and len(want_twice) == len(want) > 500
    assert store.numbered_regions(asked.limit(0), order_by="qid").collect() == []
    monkeypatch.setattr(IntervalStore, "query_regions", None)
    assert lined(store.numbered_regions(asked, order_by="qid")) == want
