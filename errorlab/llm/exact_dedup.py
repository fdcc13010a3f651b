"""Exact dedup: a persistent digest index, bucketed and sorted by digest.

The index is a bucketed table ``(digest, keep_id, n_rows)``, one row per distinct
normalised text seen so far.  New data is reduced to one row per digest (partial
aggregation first), anti-joined with the index by a sort-merge join that does not
shuffle the index side, and what is new is appended, bucketed and sorted in the same way.

Built-in functions only.  Texts are equal when identical after lower-casing A-Z; null
counts as empty, so all empty texts are one group.  Of equal texts in one load the
largest key stays; texts that the index already holds lose to the indexed key.  The key
stands for the document: rows that repeat a key with an equal text are all counted and
all flagged like their key.  A group of null keys only has a null ``keep_id``.
:func:`keep_one` keeps one row per text all the same.  An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, materialize, row_id, scratch_path, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Digests with more than this share of all rows are joined by broadcast; there are
#: fewer than 1 / HOT_SHARE of them, whatever the data.
HOT_SHARE = 0.001


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lowered, as 32 bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower()), 256))


class DigestIndex:
    """The persistent index.  ``path`` holds its files; ``name`` is its table in the
    session's catalog.  A later session opens the same path with the same bucket count."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, name: str | None = None):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, n_rows BIGINT) "
                  f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
                  f"LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame) -> None:
        """Append the rows of ``groups`` (``digest, keep_id, n_rows``) whose digest is new."""
        fresh = groups.hint("merge").join(self.table().select("digest"), "digest", "left_anti")
        fresh.select("digest", "keep_id", "n_rows").write.mode("append").format("parquet") \
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)


def groups_of(keyed: DataFrame) -> DataFrame:
    """One row per digest of a load: largest key and number of rows."""
    return keyed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows"))


def classify(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Load ``docs`` into the index and say for each row what stays:
    ``doc_id, keep_id, group_size, kept, text_sha256``.  ``group_size`` counts the rows
    of the load that brought the digest into the index."""
    keyed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                    digest(F.col("text")).alias("digest")), "digests")
    groups = groups_of(keyed)
    index.add(groups)
    # Hot groups: a bounded list, joined without moving their rows to one task.
    total = keyed.count()
    hot = groups.where(F.col("n_rows") > F.lit(max(1000.0, total * HOT_SHARE))).select("digest")
    hot_ids = F.broadcast(index.table().join(F.broadcast(hot), "digest"))  # fewer than 1 / HOT_SHARE rows
    plenty = keyed.join(hot_ids, "digest")
    rest = keyed.join(hot_ids.select("digest"), "digest", "left_anti") \
        .hint("merge").join(index.table(), "digest")
    return plenty.unionByName(rest).select(
        "doc_id", "keep_id", F.col("n_rows").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder, with as many buckets as a shuffle has parts."""
    return DigestIndex(spark, scratch_path(spark, "digest-index"),
                       int(spark.conf.get("spark.sql.shuffle.partitions")))


def keep_one(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Exactly one row of ``docs``, with all its columns, per text that is new to the
    index: the one with the largest key, and one of those that repeat it."""
    found = classify(docs, index or new_index(docs.sparkSession))
    told = found.select(row_id(F.col("doc_id"), F.col("text_sha256")).alias("id"), F.col("kept").alias("stays"))
    return keep_rows(docs, F.lower(F.hex(digest(F.col("text")))), told)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), new_index(spark))


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
