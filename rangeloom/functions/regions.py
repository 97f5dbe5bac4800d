"""Regions `name:start-end` (1-based, both ends included) and sequence names."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidIntervalError, RegionParseError

U32_MOST = (1 << 32) - 1
_PATTERN = "^([^:]+):([0-9]+)-([0-9]+)$"


class Region(NamedTuple):
    """0-based, half-open."""

    chrom: str
    start: int
    end: int


def parse_region(text: str) -> Region:
    m = re.fullmatch(_PATTERN[1:-1], text, re.ASCII)
    if not m:
        raise RegionParseError(f"not a region name:start-end: {text!r}")
    first, last = int(m[2]), int(m[3])
    if not 1 <= first <= U32_MOST or last > U32_MOST:
        raise RegionParseError(f"region out of bounds: {text!r}")
    if last <= first - 1:
        raise InvalidIntervalError(f"invalid interval: {first - 1}-{last}")
    return Region(m[1], first - 1, last)


def region_columns(text: Column) -> tuple[Column, Column, Column]:
    """chrom, start, end of region strings; null where the text is none."""
    number = lambda i: F.regexp_extract(text, _PATTERN, i).try_cast("long")
    start, end = number(2) - 1, number(3)
    good = F.coalesce((start >= 0) & (start < U32_MOST) & (end <= U32_MOST) & (end > start), F.lit(False))
    return F.when(good, F.regexp_extract(text, _PATTERN, 1)), F.when(good, start), F.when(good, end)


def parse_regions(df: DataFrame, col: str, strict: bool = True) -> DataFrame:
    """Add chrom, qstart, qend. strict: a text that is no region fails the query; otherwise it gets nulls."""
    chrom, start, end = region_columns(F.col(col))
    out = df.withColumns({"chrom": chrom, "qstart": start, "qend": end})
    if strict:
        wrong = F.raise_error(F.concat(F.lit("not a region name:start-end: "), F.coalesce(F.col(col), F.lit("null"))))
        out = out.withColumn("chrom", F.when(F.col("chrom").isNull(), wrong.cast("string")).otherwise(F.col("chrom")))
    return out


def natural_order(chrom: Column) -> list[Column]:
    """Sort keys: chr1, chr2, ..., chr10, then X, Y, then other names."""
    name = F.regexp_replace(chrom, "^chr", "")
    number = name.try_cast("int")
    group = F.when(number.isNotNull(), 0).when(name == "X", 1).when(name == "Y", 2).otherwise(3)
    return [group, number, chrom]


#: chr1 to chr22.
AUTOSOMES = [f"chr{i}" for i in range(1, 23)]


def autosomes(df: DataFrame, col: str = "chrom") -> DataFrame:
    return df.where(F.col(col).isin(AUTOSOMES))
