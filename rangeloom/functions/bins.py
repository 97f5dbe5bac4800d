"""Hierarchical bins over half-open integer ranges, as Column expressions with a plain-Python twin.

Level 0 is the coarsest (one bin), the last level has bins of 2**base_shift. An interval belongs to the finest bin
that holds it whole. Bin ids are unique over the levels: a level's ids start where the coarser levels' ids end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import CoordinateRangeError, InvalidIntervalError


@dataclass(frozen=True)
class Bins:
    """A bin scheme. linear_shift: log2 of the linear index's window, or None for no linear index."""

    base_shift: int
    level_shift: int
    levels: int
    linear_shift: int | None = None
    label: str = "Custom"

    def __post_init__(self):
        if self.levels < 1 or self.level_shift < 1 or self.base_shift < 0 or self.top_shift > 62:
            raise ValueError(f"bins of {self.levels} levels from {self.base_shift} by {self.level_shift} bits do not fit 63 bits")

    @property
    def top_shift(self) -> int:
        return self.base_shift + self.level_shift * (self.levels - 1)

    @property
    def limit(self) -> int:
        """Coordinates below this are covered."""
        return 1 << self.top_shift

    @cached_property
    def sizes(self) -> list[int]:
        """Bins of each level, coarsest first."""
        return [1 << self.level_shift * i for i in range(self.levels)]

    @cached_property
    def offsets(self) -> list[int]:
        """The first id of each level, coarsest first."""
        return [sum(self.sizes[:i]) for i in range(self.levels)]

    @property
    def total(self) -> int:
        return sum(self.sizes)

    def shift(self, level: int) -> int:
        return self.base_shift + self.level_shift * (self.levels - 1 - level)

    @property
    def finest_first(self) -> list[tuple[int, int, int]]:
        """(level, first id, shift), finest level first."""
        return [(i, self.offsets[i], self.shift(i)) for i in reversed(range(self.levels))]

    def without_linear(self) -> Bins:
        return Bins(self.base_shift, self.level_shift, self.levels, None, self.label)

    # Column expressions

    def bin_of(self, start: Column, end: Column) -> Column:
        """The id of the finest bin that holds [start, end); an error beyond the covered range."""
        out = None
        for _, first, sh in self.finest_first:
            own = F.shiftright(start, sh) == F.shiftright(end - 1, sh)
            inside = own & (end <= self.limit) & (start >= 0) & (end > start)
            value = F.lit(first).cast("long") + F.shiftright(start, sh)
            out = F.when(inside, value) if out is None else out.when(inside, value)
        text = F.concat(F.lit("interval does not fit the bin scheme: "), start.cast("string"), F.lit("-"), end.cast("string"))
        return out.when(start.isNotNull() & end.isNotNull(), F.raise_error(text).cast("long"))

    def level_of(self, bin_id: Column) -> Column:
        """The level of a bin id, 0 coarsest."""
        out = F.lit(0)
        for i, first in enumerate(self.offsets[1:], 1):
            out = F.when(bin_id >= first, F.lit(i)).otherwise(out)
        return out

    def _inside(self, start: Column, end: Column) -> tuple[Column, Column, Column]:
        """First and last place of the part within the covered range, and whether there is one."""
        first, last = F.greatest(start, F.lit(0).cast("long")), F.least(end, F.lit(self.limit).cast("long")) - 1
        return first, last, (end > start) & (last >= first)

    def bins_of(self, start: Column, end: Column) -> Column:
        """The ids of all bins that [start, end) touches, finest level first. What is beyond the covered range has no bins."""
        first, last, some = self._inside(start, end)
        parts = [F.sequence(F.lit(own).cast("long") + F.shiftright(first, sh), F.lit(own).cast("long") + F.shiftright(last, sh)) for _, own, sh in self.finest_first]
        return F.when(some, F.flatten(F.array(*parts))).otherwise(F.array().cast("array<long>"))

    def fan_out(self, start: Column, end: Column) -> Column:
        """How many bins [start, end) touches, without listing them."""
        first, last, some = self._inside(start, end)
        total = F.lit(0).cast("long")
        for _, _, sh in self.finest_first:
            total = total + F.shiftright(last, sh) - F.shiftright(first, sh) + 1
        return F.when(some, total).when(start.isNotNull() & end.isNotNull(), F.lit(0).cast("long"))

    # Plain Python, for single intervals and tests

    def bin_id(self, start: int, end: int) -> int:
        if end <= start:
            raise InvalidIntervalError(f"invalid interval: {start}-{end}")
        for _, first, sh in self.finest_first:
            if start >> sh == (end - 1) >> sh and start >= 0 and end <= self.limit:
                return first + (start >> sh)
        raise CoordinateRangeError(f"{start}-{end} is beyond {self.limit}")

    def bin_ids(self, start: int, end: int) -> list[int]:
        first, last = max(start, 0), min(end, self.limit) - 1
        return [own + b for _, own, sh in self.finest_first for b in range(first >> sh, (last >> sh) + 1)] if end > start and last >= first else []

    def register(self, spark: SparkSession, prefix: str) -> None:
        """SQL functions <prefix>_bin(start, end), <prefix>_bins(start, end) and <prefix>_level(bin), seen by Catalyst.

        They do as bin_of, bins_of and level_of: the first fails beyond the covered range, the second leaves out what is there.
        """
        case = " ".join(f"WHEN shiftright(s, {sh}) = shiftright(e - 1, {sh}) THEN {first} + shiftright(s, {sh})" for _, first, sh in self.finest_first)
        bad = f"WHEN s < 0 OR e > {self.limit} OR e <= s THEN CAST(raise_error(concat('interval does not fit the bin scheme: ', s, '-', e)) AS BIGINT)"
        parts = ", ".join(f"sequence({first} + shiftright(greatest(s, 0), {sh}), {first} + shiftright(least(e, {self.limit}) - 1, {sh}))" for _, first, sh in self.finest_first)
        some = f"e > s AND e > 0 AND s < {self.limit}"
        level = " ".join(f"WHEN b >= {first} THEN {i}" for i, first in reversed(list(enumerate(self.offsets))))
        for name, args, kind, body in (
            ("bin", "s BIGINT, e BIGINT", "BIGINT", f"CASE {bad} {case} END"),
            ("bins", "s BIGINT, e BIGINT", "ARRAY<BIGINT>", f"CASE WHEN {some} THEN flatten(array({parts})) ELSE CAST(array() AS ARRAY<BIGINT>) END"),
            ("level", "b BIGINT", "INT", f"CASE {level} END"),
        ):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}({args}) RETURNS {kind} RETURN {body}")


# The shapes of the known schemes.
TABIX = Bins(14, 3, 6, 14, "Tabix")
TABIX_NO_LINEAR = Bins(14, 3, 6, None, "Tabix (No Linear Index)")
UCSC = Bins(17, 3, 5, 14, "UCSC")
UCSC_NO_LINEAR = Bins(17, 3, 5, None, "UCSC (No Linear Index)")
DENSE = Bins(14, 3, 10, 8, "Dense")
SPARSE = Bins(20, 4, 4, 16, "Sparse")
PRESETS = {"tabix": TABIX, "tabix-no-linear": TABIX_NO_LINEAR, "ucsc": UCSC, "ucsc-no-linear": UCSC_NO_LINEAR, "dense": DENSE, "sparse": SPARSE}
DEFAULT = TABIX


def scheme(value: Bins | str) -> Bins:
    """A scheme from itself or from a preset's name."""
    if isinstance(value, Bins):
        return value
    try:
        return PRESETS[value.lower()]
    except KeyError:
        raise ValueError(f"no bin scheme {value!r}; there are {', '.join(PRESETS)}") from None
