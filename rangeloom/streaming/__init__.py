"""Streams of regions against stored features: a stateless stream-static join, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.bins import Bins
from ..operators.overlap import overlap_join


def overlap_stream(features: DataFrame, regions: DataFrame, bins: Bins | str | None = None) -> DataFrame:
    """features: static, measured once; regions: a stream with chrom, qstart, qend. Extension."""
    if not regions.isStreaming or features.isStreaming:
        raise ValueError("regions must be a stream and features must not")
    return overlap_join(features, regions, bins, strict=False)
