"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions import DENSE, SPARSE, TABIX, UCSC
from rangeloom.operators import bin_summary, level_stats, lookup, overlap_counts, overlap_join, overlap_semi, size_stats
from rangeloom.plans import fixtures
from rangeloom.scratch import folder
from rangeloom.sources import IntervalStore


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = {"start": "istart", "end": "iend"}
    f, q = fixtures.features(spark, sf_dir), fixtures.regions(spark, sf_dir)

    def pairs(bins) -> DataFrame:
        return overlap_join(f, q, bins, **names).agg(F.count(F.lit(1)), F.sum(F.col("istart") + F.col("qstart")))

    store = IntervalStore.create(f.withColumnsRenamed({"istart": "start", "iend": "end"}), folder(spark, "bench"))
    runs = {
        "store_join_regions": lambda: store.join_regions(q).agg(F.count(F.lit(1)), F.sum(F.col("start") + F.col("qstart"))),
        "overlap_join_tabix": lambda: pairs(TABIX),
        "overlap_join_ucsc": lambda: pairs(UCSC),
        "overlap_join_dense": lambda: pairs(DENSE),
        "overlap_join_sparse": lambda: pairs(SPARSE),
        "overlap_counts": lambda: overlap_counts(f, q, **names),
        "overlap_semi": lambda: overlap_semi(f, q, **names),
        "point_lookup": lambda: lookup(f, "chr2", 1_000_000, 2_000_000, **names),
        "level_stats": lambda: level_stats(f, **names),
        "bin_summary": lambda: bin_summary(f, **names),
        "size_stats": lambda: size_stats(f, **names),
    }
    took = {}
    for name, run in runs.items():
        best = None
        for _ in range(2):  # the first run compiles
            begin = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - begin
            best = spent if best is None else min(best, spent)
        took[name] = round(best, 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
