"""Overlap joins, index tables and statistics."""

from .index import bin_index, bounded_lookup, check_sorted, linear_bound_lookup, linear_bounds, linear_index, linear_lookup, sequence_index, unsorted
from .overlap import Spread, coverage, in_index_order, lookup, lookup_region, map_overlapping, measure, overlap_counts, overlap_join, overlap_left, overlap_semi, overlapping_records, overlaps
from .stats import bin_occupancy, bin_summary, bins_by_chrom, describe, descriptors, level_stats, remarks, report, size_histogram, size_quantiles, size_stats, summary
from .visit import visit

__all__ = [
    "Spread", "bin_index", "bounded_lookup", "linear_bound_lookup", "linear_bounds", "bin_occupancy", "bin_summary", "bins_by_chrom", "check_sorted", "coverage", "describe", "descriptors", "in_index_order", "level_stats", "linear_index",
    "linear_lookup", "lookup", "lookup_region", "map_overlapping", "measure", "overlap_counts", "overlap_join", "overlap_left", "overlap_semi", "overlapping_records",
    "overlaps", "remarks", "report", "sequence_index", "size_histogram", "size_quantiles", "size_stats", "summary", "unsorted", "visit",
]
