"""pack, query, stats and random-bed on the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import IntervalError
from .functions.bins import PRESETS
from .operators.stats import bins_by_chrom
from .sources import IntervalStore, compare_sizes, discover, pack, print_tsv, random_bed, read_regions, write_tsv


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rangeloom", description="Interval data on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("pack", help="a file of intervals to a store")
    a.add_argument("input")
    a.add_argument("-o", "--output")
    a.add_argument("--schema", choices=sorted(PRESETS), default="dense")
    a.add_argument("--comment", default="#")
    a.add_argument("--one-based", action="store_true")
    a.add_argument("-f", "--force", action="store_true")
    a = sub.add_parser("query", help="the intervals that overlap a region or a file of regions")
    a.add_argument("region", nargs="?")
    a.add_argument("-i", "--input")
    a.add_argument("-r", "--regions")
    a.add_argument("-o", "--output")
    a.add_argument("--comment", default="#")
    a = sub.add_parser("stats", help="figures on a store's bins")
    a.add_argument("input")
    a.add_argument("--show-bins", action="store_true")
    a = sub.add_parser("sizes", help="what files or stores take on disk, against the first")
    a.add_argument("paths", nargs="+")
    a = sub.add_parser("random-bed", help="a file of random intervals")
    a.add_argument("-o", "--output", required=True)
    a.add_argument("-n", "--num-records", type=int, default=1_000_000)
    a.add_argument("-s", "--seed", type=int)
    return p


def run(spark: SparkSession, argv: list[str]) -> None:
    args = _parser().parse_args(argv)
    if args.command == "pack":
        print(pack(spark, args.input, args.output, bins=args.schema, comment=args.comment, one_based=args.one_based, force=args.force).path)
    elif args.command == "query":
        store = IntervalStore.open(spark, args.input or discover())
        if args.region:
            rows = store.query(args.region)
        elif args.regions:
            rows = store.query_regions(read_regions(spark, args.regions, args.comment), order_by="qid")
        else:
            raise IntervalError("a region or a file of regions is needed")
        if args.output:
            write_tsv(rows, args.output)
        else:
            print(f"{print_tsv(rows)} records", file=sys.stderr)
    elif args.command == "stats":
        store = IntervalStore.open(spark, args.input)
        print(store.report())
        if args.show_bins:
            for r in bins_by_chrom(store.rows(), store.bins).toLocalIterator():
                print(f"{r.chrom}\t{r.bin_id}")
    elif args.command == "sizes":
        for r in compare_sizes(spark, *args.paths).collect():
            print(f"{r.path}\t{r.bytes}\t{r.ratio:.2f}x")
    else:
        write_tsv(random_bed(spark, args.num_records, args.seed), args.output)


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("rangeloom").getOrCreate()
    try:
        run(spark, sys.argv[1:] if argv is None else argv)
    except IntervalError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
