"""Bin arithmetic and region parsing as Column expressions."""

from .bins import DEFAULT, DENSE, PRESETS, SPARSE, TABIX, TABIX_NO_LINEAR, UCSC, UCSC_NO_LINEAR, Bins, scheme
from .regions import AUTOSOMES, Region, autosomes, natural_order, parse_region, parse_regions, region_columns

__all__ = ["AUTOSOMES", "DEFAULT", "DENSE", "PRESETS", "SPARSE", "TABIX", "TABIX_NO_LINEAR", "UCSC", "UCSC_NO_LINEAR", "Bins", "Region", "autosomes", "natural_order", "parse_region", "parse_regions", "region_columns", "scheme"]
