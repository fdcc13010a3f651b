"""Shared patterns that keep ranked and per-group work parallel at scale.

histogram_cut
    Exact "the n rows with the smallest hash in each group" without putting a
    whole group into one task.  Pass 1 counts rows per (group, hash bucket);
    those counts are small (groups x buckets, capped by the row count).  A
    running sum over the buckets of each group finds the bucket where n falls.
    Pass 2 keeps every row of lower buckets outright and ranks only the rows
    of the cut bucket, with a window partitioned by (group, bucket).  A group
    holding a third of the data is spread over 2^bits windows.

dense_index
    0..n-1 row numbers in an explicit order.  Rows are bucketed by an
    expression of the row itself (never by sampled ranges), bucket sizes are
    counted, the running offsets of the (few) buckets are computed and joined
    back, and rows are numbered inside their bucket.  No unpartitioned window
    over the data.

prefix_sums
    Running sums in an order within groups, with the same two-level idea.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from . import sizing


def histogram_cut(df: DataFrame, group_cols: Sequence[str], hash_col: str,
                  n, tie_cols: Sequence[str] = (), bits: int = 12) -> DataFrame:
    """Keep, for each group, the ``n`` rows with the smallest ``hash_col``.

    ``hash_col`` is a non-negative 32-bit integer column (see ``rng.u32``);
    ``tie_cols`` break equal hashes.  ``n`` is an int or the name of a column
    carrying each group's quota (constant inside a group).
    """
    group_cols = list(group_cols)
    quota = F.col(n) if isinstance(n, str) else F.lit(int(n))
    shift = 32 - bits
    with_bucket = df.withColumn("_bucket", F.shiftright(F.col(hash_col), shift).cast("int")) \
                    .withColumn("_quota", quota)
    with_bucket = kept(with_bucket)  # counted, then read twice
    counts = with_bucket.groupBy(*group_cols, "_bucket").agg(
        F.count(F.lit(1)).alias("_cnt"), F.first("_quota").alias("_quota"))
    w = Window.partitionBy(*group_cols).orderBy("_bucket")
    cut = (counts
           .withColumn("_upto", F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("_before", F.col("_upto") - F.col("_cnt"))
           .filter(F.col("_before") < F.col("_quota"))
           .select(*group_cols, "_bucket",
                   (F.col("_upto") <= F.col("_quota")).alias("_whole"),
                   (F.col("_quota") - F.col("_before")).alias("_need")))
    chosen = with_bucket.join(cut, on=group_cols + ["_bucket"], how="inner")
    order = [F.col(hash_col)] + [F.col(c) for c in tie_cols]
    rank_w = Window.partitionBy(*group_cols, "_bucket").orderBy(*order)
    whole = chosen.filter(F.col("_whole"))
    partial = (chosen.filter(~F.col("_whole"))
               .withColumn("_rn", F.row_number().over(rank_w))
               .filter(F.col("_rn") <= F.col("_need"))
               .drop("_rn"))
    return whole.unionByName(partial).drop("_bucket", "_whole", "_need", "_quota")


def dense_index(df: DataFrame, order_cols: Sequence[str], bucket: Column,
                name: str = "idx", max_buckets: int = 1 << 16) -> DataFrame:
    """Add ``name`` = 0..n-1 following ``order_cols``.

    ``bucket`` must be an expression of the row that is non-decreasing in the
    order (for example ``floor(key / width)``), so that all rows of a bucket
    precede all rows of the next one.  The bucket table has at most
    ``max_buckets`` rows; it is checked before it is broadcast.
    """
    return _number(kept(df.withColumn("_b", bucket.cast("bigint"))), order_cols, name, max_buckets)


def _number(with_b: DataFrame, order_cols: Sequence[str], name: str, max_buckets: int) -> DataFrame:
    """``dense_index`` of a table that is cheap to read again and has its bucket ``_b``."""
    sizes = with_b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_b",
        (F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_n")).alias("_off"))
    offsets = sizing.broadcast_if_small(offsets, max_buckets)
    w = Window.partitionBy("_b").orderBy(*[F.col(c) for c in order_cols])
    return (with_b.join(offsets, "_b")
            .withColumn(name, F.col("_off") + F.row_number().over(w) - 1)
            .drop("_b", "_off"))


def hash_bucket(h: Column, bits: int = 12) -> Column:
    """Bucket of a 32-bit hash: its top ``bits`` bits (order preserving)."""
    return F.shiftright(h, 32 - bits)


def dense_index_by_range(df: DataFrame, key: str, buckets: int = 1 << 14,
                         name: str = "idx") -> DataFrame:
    """``dense_index`` in ``key`` order with ``buckets`` equal-width key ranges.

    The key range comes from one aggregate (min, max); the bucket is then an
    expression of the row, so recomputed tasks number rows identically.
    """
    df = kept(df)
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    if lo is None:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    width = max(1, -(-(int(hi) - int(lo) + 1) // buckets))
    bucket = F.floor((F.col(key) - F.lit(int(lo))) / F.lit(width))
    return _number(df.withColumn("_b", bucket.cast("bigint")), [key], name, buckets)


def prefix_sums_desc(df: DataFrame, group_cols: Sequence[str], order_col: str,
                     value_cols: Sequence[str], bits: int = 12) -> DataFrame:
    """``cum_<v>`` = sum of ``v`` over rows of the group with ``order_col`` >=
    this row's (order_col is a score in [0, 1], unique within the group).

    Level 1: totals per (group, bucket = floor(score * 2^bits)) and their running
    sums over buckets (<= 2^bits rows per group).  Level 2: running sums inside
    each (group, bucket).  The two are added; no window spans a whole group.
    """
    g = list(group_cols)
    nb = 1 << bits
    with_b = df.withColumn("_b", F.least(F.floor(F.col(order_col) * nb), F.lit(nb)).cast("int"))
    tot = with_b.groupBy(*g, "_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    wb = Window.partitionBy(*g).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*g, "_b", *[F.coalesce(F.sum(f"_t_{v}").over(wb), F.lit(0)).alias(f"_o_{v}")
                                  for v in value_cols])
    wi = Window.partitionBy(*g, "_b").orderBy(F.desc(order_col)).rowsBetween(Window.unboundedPreceding, 0)
    out = with_b.join(offs, g + ["_b"])
    for v in value_cols:
        out = out.withColumn(f"cum_{v}", F.col(f"_o_{v}") + F.sum(v).over(wi))
    return out.drop("_b", *[f"_o_{v}" for v in value_cols])
