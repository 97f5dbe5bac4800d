"""Interval data on Spark: ingest, overlap joins, bin statistics."""
