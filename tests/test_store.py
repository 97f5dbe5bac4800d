"""The store's layout join, its segments and statistics: against brute force, without the files they need not read, and under lost races."""

import glob
import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.errors import StoreError, StoreExistsError
from rangeloom.functions import TABIX, UCSC
from rangeloom.operators import bin_summary, layout, level_stats, overlap_join, size_quantiles, size_stats
from rangeloom.sources import IntervalStore, store as store_module
from rangeloom.sources.snapshots import Snapshots

SCHEMA = "chrom string, start long, end long, ord long"
Q_SCHEMA = "qid long, chrom string, qstart long, qend long"


def features(n, seed, most=1 << 20):
    rng = random.Random(seed)
    return [(rng.choice(["chr1", "chr1", "chr1", "a/b=c %d"]), s := rng.randrange(most), s + rng.choice([1, rng.randrange(1, 300), 1 << rng.randrange(18)]), i) for i in range(n)]


def regions(n, seed, most=1 << 20):
    rng = random.Random(seed)
    return [(i, rng.choice(["chr1", "a/b=c %d", "none", None]), s := rng.randrange(-50, most), s + rng.choice([1, 500, 1 << rng.randrange(19)])) for i in range(n)]


def pairs(f, q):
    return sorted((a[3], b[0]) for a in f for b in q if a[0] == b[1] and a[1] < b[3] and a[2] > b[2])


def joined(df):
    return sorted((r.ord, r.qid) for r in df.collect())


def files_of(path):
    return glob.glob(f"{path}/rows/*/*/*.parquet")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "s")
    f, q = features(900, 1), regions(200, 2)
    store = IntervalStore.create(spark.createDataFrame(f, SCHEMA).repartition(3), path, files=6)
    return f, q, store, spark.createDataFrame(q, Q_SCHEMA).repartition(2)


@pytest.mark.parametrize("few,batch,candidates,held", [(4096, 1 << 16, 1 << 20, 1 << 18), (0, 7, 3, 5)])
def test_join(made, monkeypatch, few, batch, candidates, held):
    f, q, store, dq = made
    monkeypatch.setattr(layout, "FEW_FILES", few)
    for name, value in (("BATCH", batch), ("CANDIDATES", candidates), ("HELD", held)):
        monkeypatch.setattr(layout, name, value)
    assert joined(store.join_regions(dq)) == pairs(f, q)
    assert sorted(r.ord for r in store.query_regions(dq).collect()) == sorted(a for a, _ in pairs(f, q))


def test_matches_of_all_sizes():
    rng = np.random.default_rng(4)
    for trial in range(40):
        s = np.sort(rng.integers(-1000, 3000, rng.integers(1, 60)))
        e = s + rng.choice([1, 2, 3, 64, 65, 1000, 1 << 45, (1 << 49) + 1], len(s))
        qs = rng.integers(-1100, 3100, 25)
        qe = qs + rng.choice([1, 50, 4000], 25)
        got = sorted((int(a), int(b)) for x, y in layout.matches(s, e, qs, qe) for a, b in zip(x, y, strict=True))
        assert got == sorted((i, j) for i in range(len(s)) for j in range(25) if s[i] < qe[j] and e[i] > qs[j]), trial


def test_the_rows_are_not_shuffled(made):
    _, _, store, dq = made
    plan = store.join_regions(dq)._jdf.queryExecution().executedPlan().toString()
    assert "rows/__segment" not in plan and "MapInArrow" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_reached_files_are_read(spark, tmp_path):
    """Files that no region reaches are taken away: nobody misses them."""
    path = str(tmp_path / "s")
    f = [("chr1", i * 100, i * 100 + 50, i) for i in range(1000)] + [("chr2", i, i + 5, 5000 + i) for i in range(100)]
    store = IntervalStore.create(spark.createDataFrame(f, SCHEMA), path, files=10)
    q = [(1, "chr1", 30_000, 30_200), (2, "chr1", 70_010, 70_020)]
    dq = spark.createDataFrame(q, Q_SCHEMA)
    own = {os.path.basename(r.file) for r in layout.reached(store.files(), 10, dq, "chrom", "qstart", "qend").select("file").collect()}
    everything = files_of(path)
    assert len(own) <= 2 < len(everything)
    for file in everything:
        if os.path.basename(file) not in own:
            os.remove(file)
    assert joined(store.join_regions(dq)) == pairs(f, q)


def test_columns_of_many_types_and_clashing_names(spark, tmp_path):
    rows = spark.sql("SELECT 'c' AS chrom, 5L AS start, 9L AS end, 1 AS qid, array(1, 2) AS tags, timestamp'2024-01-02 03:04:05' AS at, CAST(1.5 AS decimal(9,2)) AS price, named_struct('a', 1, 'b', 'x') AS s, binary('q') AS raw, true AS ok, date'2024-01-01' AS day, map('k', 1.5D) AS m, CAST(NULL AS string) AS none")
    dq = spark.sql("SELECT 'c' AS chrom, 6L AS qstart, 7L AS qend, 77 AS qid, 'r' AS price")
    store = IntervalStore.create(rows, str(tmp_path / "s"))
    got, want = store.join_regions(dq), overlap_join(rows, dq)
    assert got.schema.simpleString() == want.schema.simpleString() and got.collect() == want.collect()
    assert store.query_regions(dq).collect() == rows.collect()
    with pytest.raises(Exception, match="invalid interval"):
        store.query_regions(dq.withColumn("qend", F.lit(6).cast("long"))).collect()
    named = dq.withColumnsRenamed({"chrom": "seq", "qstart": "a", "qend": "b"})
    assert store.query_regions(named, region_chrom="seq", region_start="a", region_end="b").collect() == rows.collect()


def test_empty_store_and_regions(spark, tmp_path, made):
    empty = IntervalStore.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "s"))
    assert empty.join_regions(made[3]).count() == 0 and empty.count() == 0 and empty.size_stats().first().max_size == 0 and empty.bin_summary().first().total_features == 0
    assert made[2].join_regions(made[3].limit(0)).count() == 0 and empty.size_quantiles([0.5]).collect() == []
    more = empty.append(spark.createDataFrame([("c", 1, 5, 1)], SCHEMA))
    assert more.count() == 1 and more.query("c:1-3").count() == 1


def test_hot_regions_are_dealt_out(spark, made):
    f, _, store, _ = made
    q = [(i, "chr1", 500_000, 500_900) for i in range(400)]
    assert joined(store.join_regions(spark.createDataFrame(q, Q_SCHEMA).repartition(8))) == pairs(f, q)


# Segments


def test_appends(spark, tmp_path):
    path = str(tmp_path / "s")
    f, q = features(600, 5), regions(80, 6)
    own = lambda lo, hi: spark.createDataFrame(f[lo:hi], SCHEMA)
    IntervalStore.create(own(0, 200), path, metadata={"name": "x"})
    IntervalStore.open(spark, path).append(own(200, 400).select("ord", "end", "start", "chrom"))
    store = IntervalStore.open(spark, path).append(own(400, 600))
    again = IntervalStore.open(spark, path)
    assert store.version == again.version == 3 and again.count() == 600 and again.metadata == {"name": "x"}
    assert sorted(map(tuple, again.rows().collect()), key=str) == sorted(f, key=str)
    dq = spark.createDataFrame(q, Q_SCHEMA)
    assert joined(again.join_regions(dq)) == pairs(f, q)
    assert again.spread == IntervalStore.create(own(0, 600), str(tmp_path / "whole")).spread
    assert IntervalStore.open(spark, path, version=1).count() == 200
    with pytest.raises(StoreError, match="columns"):
        again.append(own(0, 1).withColumn("more", F.lit(1)))
    with pytest.raises(StoreError, match="columns"):
        again.append(own(0, 1).withColumn("ord", F.lit("x")))

    compact = again.compact()
    assert len(compact._meta["segments"]) == 1 and joined(compact.join_regions(dq)) == pairs(f, q) and compact.count() == 600
    assert IntervalStore.open(spark, path, version=3).rows().count() == 600  # former segments stay for readers
    compact.vacuum()
    assert len(glob.glob(f"{path}/rows/*")) == len(glob.glob(f"{path}/partials/*")) == 1 and IntervalStore.open(spark, path).rows().count() == 600
    with pytest.raises(StoreError, match="no state"):
        IntervalStore.open(spark, path, version=3)


def test_statistics_of_segments_are_merged_without_their_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    f = features(500, 7)
    rows = spark.createDataFrame(f, SCHEMA)
    store = IntervalStore.create(rows.where("ord % 2 = 0"), path, bins=UCSC).append(rows.where("ord % 2 = 1"))
    for file in files_of(path):
        os.remove(file)
    assert store.bin_summary().collect() == bin_summary(rows, UCSC).collect()
    assert sorted(store.level_stats().collect()) == sorted(level_stats(rows, UCSC).collect())
    assert store.size_stats().collect() == size_stats(rows).collect()
    some = [0.0, 0.2, 0.5, 0.77, 1.0]
    assert sorted(store.size_quantiles(some).collect()) == sorted(size_quantiles(rows, some).collect())
    assert "UCSC" in store.report()


def test_rows_beyond_the_scheme(spark, tmp_path):
    store = IntervalStore.create(spark.createDataFrame([("c", 1 << 40, (1 << 40) + 5, 1)], SCHEMA), str(tmp_path / "s"), bins=TABIX)
    assert store.get_overlapping("c", 1 << 40, 1 << 41).count() == 1 and store.size_stats().first().max_size == 5
    with pytest.raises(Exception, match="bin scheme"):
        store.bin_summary().collect()


def test_a_writer_that_dies_leaves_the_former_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store = IntervalStore.create(spark.createDataFrame([("c", 1, 5, 1)], SCHEMA), path)

    def dies(self, number, state):
        raise KeyboardInterrupt

    for act in (lambda: store.append(spark.createDataFrame([("c", 2, 5, 2)], SCHEMA)), lambda: IntervalStore.create(spark.createDataFrame([("c", 3, 5, 3)], SCHEMA), path, overwrite=True)):
        with monkeypatch.context() as m:
            m.setattr(Snapshots, "commit", dies)
            with pytest.raises(KeyboardInterrupt):
                act()
        assert len(glob.glob(f"{path}/rows/*")) > 1  # its rows are there, and nobody sees them
        again = IntervalStore.open(spark, path)
        assert again.count() == 1 and [r.ord for r in again.rows().collect()] == [1] and again.join_regions(spark.createDataFrame([(1, "c", 0, 9)], Q_SCHEMA)).count() == 1


def test_a_number_is_taken_once(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path / "s"))
    assert kept.latest() is None and kept.commit(1, {"a": 1}) and not kept.commit(1, {"a": 2}) and kept.latest() == (1, {"a": 1})
    assert kept.commit(2, {"a": 3}) and kept.latest() == (2, {"a": 3}) and kept.numbers() == [1, 2]


def test_lost_races_are_run_again(spark, tmp_path):
    """Appends at once, each from a store opened before the others wrote."""
    path = str(tmp_path / "s")
    IntervalStore.create(spark.createDataFrame([("c", 0, 5, 0)], SCHEMA), path)
    stores = [IntervalStore.open(spark, path) for _ in range(4)]
    errors = []

    def add(i):
        try:
            stores[i].append(spark.createDataFrame([("c", 10 * (i + 1), 10 * (i + 1) + 5, i + 1)], SCHEMA))
        except BaseException as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not errors
    last = IntervalStore.open(spark, path)
    assert last.version == 5 and sorted(r.ord for r in last.rows().collect()) == [0, 1, 2, 3, 4]
    # what was added since a store was opened stays beside what it compacts
    before = IntervalStore.open(spark, path)
    IntervalStore.open(spark, path).append(spark.createDataFrame([("c", 90, 95, 9)], SCHEMA))
    assert sorted(r.ord for r in before.compact().rows().collect()) == [0, 1, 2, 3, 4, 9]
    # segments that were replaced can't be compacted, and an overwritten store of other columns can't be added to
    stale, other = IntervalStore.open(spark, path), IntervalStore.open(spark, path)
    IntervalStore.create(spark.createDataFrame([("c", 1, 5)], "chrom string, start long, end long"), path, overwrite=True)
    with pytest.raises(StoreError):
        other.append(spark.createDataFrame([("c", 1, 5, 1)], SCHEMA))
    with pytest.raises(Exception):
        stale.compact()
    assert [tuple(r) for r in IntervalStore.open(spark, path).rows().collect()] == [("c", 1, 5)]
    with pytest.raises(StoreExistsError):
        IntervalStore.create(spark.createDataFrame([("c", 1, 5)], "chrom string, start long, end long"), path)


def test_by_a_shuffled_join_where_tasks_cannot_open_files(made, monkeypatch):
    f, q, store, dq = made
    monkeypatch.setattr(store_module.layout, "can_open", lambda path: False)
    assert joined(store.join_regions(dq)) == pairs(f, q) and store.query_regions(dq).count() == len(pairs(f, q))
