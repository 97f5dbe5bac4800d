"""Errors that callers can tell apart."""


class IntervalError(ValueError):
    """Base of the library's errors."""


class InvalidIntervalError(IntervalError):
    """An interval whose end is not above its start."""


class RegionParseError(IntervalError):
    """A region that is not `name:start-end`."""


class UnsortedFeaturesError(IntervalError):
    """Features out of order where strict order was asked for."""


class CoordinateRangeError(IntervalError):
    """A coordinate beyond what a bin scheme covers."""


class VisitError(IntervalError):
    """A function that failed on a row: the row, the error as text, and how many rows went well in the tasks that ran."""

    def __init__(self, row: dict, error: str, seen: int):
        super().__init__(f"{error} (row {row})")
        self.row, self.error, self.seen = row, error, seen


class StoreError(IntervalError):
    """A path that holds no store, or more than one where one was expected."""


class StoreExistsError(StoreError):
    """A store that would be overwritten."""
