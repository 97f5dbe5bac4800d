"""Features and regions derived from the driver's tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FEATURES = """
SELECT concat('chr', CAST(l_suppkey % 22 + 1 AS {s})) AS chrom,
       (l_orderkey*7919 + l_linenumber*104729 + l_partkey*31) % 50000000 AS istart,
       (l_orderkey*7919 + l_linenumber*104729 + l_partkey*31) % 50000000 + 1 + (l_partkey % 97) * CAST(power(4, l_linenumber) AS bigint) AS iend,
       concat_ws(chr(9), l_returnflag, l_linestatus) AS rest
FROM {t}
"""
_REGIONS = """
SELECT o_orderkey AS qid,
       concat('chr', CAST(o_custkey % 22 + 1 AS {s})) AS chrom,
       (o_orderkey*15485863) % 50000000 AS qstart,
       (o_orderkey*15485863) % 50000000 + 1 + (o_custkey % 50) * 1000 AS qend
FROM {t}
"""
_SPANS = """
SELECT event_type AS chrom, {secs} AS istart, {secs} + 60 + event_id % 3600 AS iend, user_id, event_id AS ord FROM {t}
"""
FEATURES_SQL = _FEATURES.format(s="varchar", t="lineitem")
REGIONS_SQL = _REGIONS.format(s="varchar", t="orders")
SPANS_SQL = _SPANS.format(secs="date_diff('second', timestamp '2024-01-01 00:00:00', ts)", t="events")
WITH = f"WITH features AS ({FEATURES_SQL}), regions AS ({REGIONS_SQL}), spans AS ({SPANS_SQL})"


def _named(sql: str, table: DataFrame) -> DataFrame:
    return table.sparkSession.sql(sql, t=table)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, istart, iend, rest from lineitem."""
    return _named(_FEATURES.format(s="string", t="{t}"), spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, chrom, qstart, qend from orders."""
    return _named(_REGIONS.format(s="string", t="{t}"), spark.read.parquet(f"{sf_dir}/orders.parquet"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom (the event's type), istart, iend (seconds), user_id, ord from events."""
    return _named(_SPANS.format(secs="timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)", t="{t}"), spark.read.parquet(f"{sf_dir}/events.parquet"))
