"""Readers, writers and the store."""

from .bed import has_header, parse_lines, random_bed, read_bed, read_bed_sniffed, read_regions
from .ordered import numbered_lines
from .sinks import display, line, print_tsv, write_tsv
from .store import IntervalStore, compare_sizes, default_output, discover, pack

__all__ = ["IntervalStore", "compare_sizes", "default_output", "discover", "display", "has_header", "line", "numbered_lines", "pack", "parse_lines", "print_tsv", "random_bed", "read_bed", "read_bed_sniffed", "read_regions", "write_tsv"]
