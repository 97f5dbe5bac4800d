"""The table of bins: lookups against brute force, and without the files and row groups that they need not read."""

import glob
import os
import shutil
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
import pytest
from test_store import SCHEMA, features

from rangeloom.errors import InvalidIntervalError, StoreError
from rangeloom.functions import DENSE, TABIX, UCSC
from rangeloom.operators import layout
from rangeloom.sources import IntervalStore, bin_index, store as store_module
from rangeloom.sources.snapshots import Snapshots

ASKED = [("chr1", 0, 1 << 20), ("chr1", 500_000, 500_001), ("chr1", -50, 3), ("a/b=c %d", 131_071, 131_073), ("a/b=c %d", 1 << 19, 1 << 50), ("none", 1, 9), ("chr1", -9, 0), ("chr1", 1 << 60, 1 << 61)]


def overlapping(f, chrom, start, end):
    return sorted(a for a in f if a[0] == chrom and a[1] < end and a[2] > start)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Two segments with an index, one without, one of no rows."""
    path, f = str(tmp_path_factory.mktemp("index") / "s"), features(1200, 21)
    own = lambda lo, hi: spark.createDataFrame(f[lo:hi], SCHEMA)
    IntervalStore.create(own(0, 500), path, bins=UCSC, files=5).append(own(0, 0)).append(own(500, 900)).build_index().append(own(900, 1200))
    return f, IntervalStore.open(spark, path)


@pytest.mark.parametrize("asked", ASKED)
def test_seek(made, asked):
    f, store = made
    assert rows(store.seek(*asked)) == overlapping(f, *asked) == rows(store.get_overlapping(*asked))


def test_seek_in_small_batches_and_without_open_files(made, monkeypatch):
    f, store = made
    with pytest.raises(InvalidIntervalError):
        store.seek("chr1", 5, 5)
    monkeypatch.setattr(store_module.layout, "can_open", lambda path: False)
    assert rows(store.seek(*ASKED[1])) == overlapping(f, *ASKED[1])


def test_rows_of_a_bin(made):
    f, store = made
    held = {}
    for a in f:
        if a[0] == "chr1":
            held.setdefault(UCSC.bin_id(a[1], a[2]), []).append(a)
    assert len({next(i for i, own, _ in UCSC.finest_first if b >= own) for b in held}) > 2
    for b in [*list(held)[:6], min(held), UCSC.total - 1]:
        assert rows(store.bin_rows("chr1", b)) == sorted(held.get(b, [])), b
    assert store.bin_rows("chr1", UCSC.total).count() == store.bin_rows("chr1", -1).count() == 0


def test_the_table(spark, made, tmp_path):
    f, store = made
    with pytest.raises(StoreError, match="without an index"):
        store.bin_ranges()
    whole = IntervalStore.create(spark.createDataFrame(f, SCHEMA), str(tmp_path / "s"), bins=UCSC, files=4).build_index()
    table = whole.bin_ranges().collect()
    assert sum(r.n for r in table) == len(f) and len({(r.chrom, r.bin_id, r.file) for r in table}) == len(table)
    for r in table:
        held = pq.read_table(unquote(urlparse(r.file).path), partitioning=None).slice(r.first_row, r.past_row - r.first_row).to_pylist()
        own = [x for x in held if UCSC.bin_id(x["start"], x["end"]) == r.bin_id]
        assert own[0] == held[0] and own[-1] == held[-1] and len(own) == r.n, "the range begins and ends with the bin's rows"
        assert (r.first, r.past) == (min(x["start"] for x in own), max(x["end"] for x in own))
        assert r.level == max(i for i, o in enumerate(UCSC.offsets) if r.bin_id >= o)
    plan = whole.bin_ranges().where("chrom = 'chr1' AND bin_id BETWEEN 5 AND 9")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "GreaterThanOrEqual(bin_id,5)" in plan


def test_only_what_is_reached_is_read(spark, tmp_path):
    """Other files are taken away and other row groups overwritten with zeros: nobody misses them."""
    path = str(tmp_path / "s")
    # some long features at the front: by their bins' ranges a walk would go through every row group behind them
    f = [("chr1", i * 10, i * 10 + 5, i) for i in range(20_000)] + [("chr1", i, i + 150_000, -i) for i in range(1, 4)] + [("chr2", i, i + 5, i) for i in range(100)]
    conf = spark._jsc.hadoopConfiguration()
    conf.setInt("parquet.block.size", 4096)
    try:
        store = IntervalStore.create(spark.createDataFrame(f, SCHEMA), path, bins=DENSE, files=4).build_index()
    finally:
        conf.unset("parquet.block.size")
    asked = ("chr1", 120_000, 120_040)
    reached = {unquote(urlparse(r.file).path): [(s.first, s.past) for s in r.spans] for r in bin_index.reach(store.bin_ranges(), DENSE, *asked).collect()}
    total = kept = 0
    for file in glob.glob(f"{path}/rows/*/*/*.parquet"):
        total += os.path.getsize(file)
        if file not in reached:
            os.remove(file)
            continue
        meta, at = pq.ParquetFile(file).metadata, 0
        with open(file, "r+b") as out:
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                met = any(a < at + group.num_rows and b > at for a, b in reached[file]) and layout.may_hold(group, [c for c in SCHEMA.replace(",", "").split() if c in ("start", "end", "ord")], asked[1], asked[2])
                at += group.num_rows
                chunks = [group.column(i) for i in range(group.num_columns)]
                size = sum(c.total_compressed_size for c in chunks)
                if met:
                    kept += size
                else:
                    out.seek(min(c.dictionary_page_offset or c.data_page_offset for c in chunks))
                    out.write(bytes(size))
    assert len(reached) == 2 and kept * 5 < total
    assert rows(store.seek(*asked)) == overlapping(f, *asked) and len(overlapping(f, *asked)) == 7


# Writers


def test_index_with_appends_compaction_and_vacuum(spark, tmp_path):
    path, f = str(tmp_path / "s"), features(300, 22)
    own = lambda lo, hi: spark.createDataFrame(f[lo:hi], SCHEMA)
    store = IntervalStore.create(own(0, 100), path).build_index()
    assert store.version == 2 and store.build_index().version == 2, "nothing to add"
    store = store.append(own(100, 200)).build_index()
    assert len(glob.glob(f"{path}/index/*")) == 2 and sum(r.n for r in store.bin_ranges().collect()) == 200
    compact = store.compact()
    assert sum(r.n for r in compact.bin_ranges().collect()) == 200 and rows(compact.seek(*ASKED[0])) == overlapping(f[:200], *ASKED[0])
    compact.vacuum()
    assert len(glob.glob(f"{path}/index/*")) == 1 and rows(IntervalStore.open(spark, path).seek(*ASKED[0])) == overlapping(f[:200], *ASKED[0])
    part = compact.append(own(200, 300)).compact()
    assert not part._meta["segments"][0].get("index"), "one of the segments had none"
    again = IntervalStore.create(own(0, 50), path, overwrite=True)
    assert rows(again.seek(*ASKED[0])) == overlapping(f[:50], *ASKED[0])


def test_two_who_index_at_once_and_one_whose_segment_goes(spark, tmp_path):
    path, f = str(tmp_path / "s"), features(120, 23)
    IntervalStore.create(spark.createDataFrame(f[:60], SCHEMA), path).append(spark.createDataFrame(f[60:], SCHEMA))
    first, second, third = (IntervalStore.open(spark, path) for _ in range(3))
    first.build_index()
    assert sorted(second.build_index()._meta["segments"], key=str) == sorted(first._meta["segments"], key=str) and len(glob.glob(f"{path}/index/*")) == 2
    first.compact()
    third.build_index()  # its segments are no more: what it wrote goes, the compacted one's index stays
    last = IntervalStore.open(spark, path)
    assert len(last._meta["segments"]) == 1 and rows(last.seek(*ASKED[0])) == overlapping(f, *ASKED[0])
    last.vacuum()
    assert len(glob.glob(f"{path}/index/*")) == 1


def test_an_index_that_fails_or_is_not_noted_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store = IntervalStore.create(spark.createDataFrame([("c", 1 << 40, (1 << 40) + 5, 1)], SCHEMA), path, bins=TABIX)
    with pytest.raises(Exception, match="bin scheme"):
        store.build_index()
    assert glob.glob(f"{path}/index/*") == [] and rows(store.seek("c", 1 << 40, 1 << 41)) == [("c", 1 << 40, (1 << 40) + 5, 1)]
    shutil.rmtree(path)
    store = IntervalStore.create(spark.createDataFrame([("c", 1, 5, 1)], SCHEMA), path)
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "commit", lambda self, number, state: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.build_index()
    again = IntervalStore.open(spark, path)
    assert again.version == 1 and rows(again.seek("c", 1, 2)) == [("c", 1, 5, 1)] and rows(again.build_index().seek("c", 1, 2)) == [("c", 1, 5, 1)]
