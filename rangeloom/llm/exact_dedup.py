"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text. A batch of documents is first
reduced to one candidate row per digest (partial aggregation before the shuffle, so a group that holds a third of
all rows costs one row per task), then left-anti-joined with the index by sort-merge on the digest (the index side
is read bucket by bucket, without a shuffle) and appended. Who comes first stays. So that this is the row with the most
code points, documents are fed in batches by length, the longest first: a shorter text that equals an indexed one
without white space finds its digest there and is dropped by the anti-join. Rows then meet the index's rows for their own
digests, which are written first: both sides of that join are shuffled, so Spark splits the partition of a hot digest.

Defined results: a null text counts as empty; texts are equal when identical without white space; of equal texts
the one with the most code points stays, then the smallest doc_id (a null doc_id after all others). A row repeated
whole stays once. group_size counts the rows given. Against an index that holds a digest from before, none of the rows
with it stays, and keep_id is the indexed row's. An empty table gives an empty index and no rows. Other columns, whatever
their names, are carried along by `apply` and ignored by `digests`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, free_names, scratch, text_or_empty, written

SCHEMA = "digest string, keep_id long, keep_chars long, keep_row long, batch string"
#: Least buckets of an index, and about how many digests each is to hold.
BUCKETS, PER_BUCKET = 64, 1 << 20
#: Batches that documents are fed in.
BATCHES = 2


def normalised(col: str = "text"):
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    return F.translate(text_or_empty(col), " \t\n\x0b\x0c\r", "")


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, digest, n_points, row_no of every row. row_no is only unique, and holds once the result is written."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(normalised(text_col).cast("binary"), 256).alias("digest"),
        F.char_length(text_or_empty(text_col)).cast("long").alias("n_points"),
    ).withColumn("row_no", F.monotonically_increasing_id())


def candidates(rows: DataFrame) -> DataFrame:
    """One row per digest: the row that stays."""
    order = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_no"))
    best = rows.groupBy("digest").agg(F.min(order).alias("k"))
    return best.select("digest", F.col("k.doc_id").alias("keep_id"), (-F.col("k.col1")).alias("keep_chars"), F.col("k.row_no").alias("keep_row"))


class DigestIndex:
    """A Parquet table bucketed and sorted by digest, in the warehouse or, to outlive the catalog, at a path."""

    def __init__(self, spark: SparkSession, table: str, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.table, self.path, self.buckets = spark, table, path, buckets
        if not spark.catalog.tableExists(table):
            place = f" LOCATION '{path}'" if path else ""
            columns = ", ".join(f"{n} {t}" for n, t in (c.split() for c in SCHEMA.split(", ")))
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS{place}")

    @classmethod
    def for_rows(cls, rows: DataFrame) -> DigestIndex:
        """A fresh one with buckets for so many rows, in the shared folder."""
        spark = rows.sparkSession
        return cls(spark, f"digest_index_{uuid.uuid4().hex}", scratch(spark, "digest-index"), max(BUCKETS, rows.count() // PER_BUCKET))

    def _write(self, rows: DataFrame) -> None:
        # dealt as the buckets are, by the hash that they are numbered by: one file per bucket and append
        dealt = rows.select(*(c.split()[0] for c in SCHEMA.split(", "))).repartitionById(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))
        writer = dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append_new(self, rows: DataFrame) -> str:
        """Append the digests that the index doesn't hold yet, and return the batch's name. A digest that is there keeps its row."""
        batch = uuid.uuid4().hex
        new = candidates(rows).join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self._write(new.withColumn("batch", F.lit(batch)))
        return batch

    def feed(self, rows: DataFrame, batches: int = BATCHES) -> list[str]:
        """Append written rows in batches by length, the longest first; the batches' names. Equal rows are in one batch."""
        cuts = rows.agg(F.percentile_approx("n_points", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
        names, above = [], None
        for low in [*sorted(set(cuts or ()), reverse=True), 0]:
            part = rows.where(F.col("n_points") >= low)
            names.append(self.append_new(part if above is None else part.where(F.col("n_points") < above)))
            above = low
        return names

    def drop(self) -> None:
        """From the catalog; what lies at a path of its own stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def keepers(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Of each digest among the rows: what the index has of it, and how many rows. Written."""
    own = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    return written(index.read().hint("merge").join(own.hint("merge"), "digest"), "keepers")


def decide(rows: DataFrame, found: DataFrame, batches: list[str]) -> DataFrame:
    """Each row with its digest's keeper and whether it is that row. batches: the names under which the rows were appended."""
    kept = (F.col("row_no") == F.col("keep_row")) & F.col("batch").isin(batches)
    return rows.join(found, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"), "row_no")


def _indexed(rows: DataFrame, index: DigestIndex | None) -> tuple[DataFrame, list[str]]:
    """Feed written rows to an index, one for this call if none is given; what it has of them, and the batches' names."""
    own = index or DigestIndex.for_rows(rows)
    try:
        names = own.feed(rows)
        return keepers(rows, own), names
    finally:
        if index is None:
            own.drop()
            delete(rows.sparkSession, own.path)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. index: one to be deduplicated against and added to."""
    rows = written(digests(docs), "digests")
    return decide(rows, *_indexed(rows, index)).drop("row_no")


def apply(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns."""
    found, names = _indexed(written(digests(docs), "digests"), index)
    # one key per digest and document, so that a hot digest's copies are dealt out by their doc_id
    k, n = free_names(docs, "__key", "__n")
    key = lambda digest: F.concat_ws(":", digest, "doc_id")
    stays = found.where(F.col("batch").isin(names)).select(F.concat_ws(":", "digest", "keep_id").alias(k))
    keyed = docs.withColumn(k, key(F.sha2(normalised().cast("binary"), 256)))
    kept = keyed.join(stays, k, "left_semi")
    # a doc_id that comes more than once with the same text: the longest of its rows
    order = Window.partitionBy(k).orderBy(F.char_length(text_or_empty()).desc(), text_or_empty())
    return kept.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).select(*docs.columns)
