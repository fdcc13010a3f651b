"""Sampling, balancing, batching.

Random choices are keyed hashes; ranked choices use ``scale`` patterns so no
class, batch or index is computed inside one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..session import kept
from . import scale


# I1 ------------------------------------------------------------------------
def dense_index(df: DataFrame, key: str, name: str = "idx", buckets: int = 1 << 14) -> DataFrame:
    """0..n-1 in ``key`` order (range buckets from one min/max aggregate)."""
    return scale.dense_index_by_range(df, key, buckets, name)


# B1 ------------------------------------------------------------------------
def balance_pairs(df: DataFrame, class_col: str, pair_col: str = "pair_id", is_error_col: str = "is_error",
                  seed: int = 17) -> DataFrame:
    """Equal class sizes, pairs kept whole.

    Originals (``is_error`` false) are counted per class; the smallest observed
    class size n is the quota; per class the n originals with the smallest
    keyed hash are kept (histogram cut: exact, parallel inside each class);
    their partners come along by a semi join on the pair key.
    """
    df = kept(df)  # counted, cut and joined
    orig = df.filter(~F.col(is_error_col)).select(pair_col, class_col)
    n = orig.groupBy(class_col).count().agg(F.min("count")).first()[0]
    if n is None:
        return df.limit(0)
    h = orig.withColumn("_h", rng.u32(seed, "balance", F.col(pair_col)))
    keep = scale.histogram_cut(h, [class_col], "_h", int(n), tie_cols=[pair_col]).select(pair_col)
    return df.join(keep, pair_col, "left_semi")


# B2 ------------------------------------------------------------------------
def class_weights(df: DataFrame, target: str, exponent: float = 1.0) -> DataFrame:
    """``(class, count, weight)`` with weight = (n / (k * count))^e over the k
    observed classes (the class table is tiny; its window has no key)."""
    c = df.groupBy(F.col(target).alias("class_id")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(F.lit(1))
    return c.select("class_id", "count",
                    F.pow(F.sum("count").over(w) / (F.count(F.lit(1)).over(w) * F.col("count")),
                          F.lit(exponent)).alias("weight"))


# B3 ------------------------------------------------------------------------
def real_examples(df: DataFrame, col: str = "target_code") -> DataFrame:
    return df.filter(F.col(col) == 0)


def error_examples(df: DataFrame, col: str = "target_code") -> DataFrame:
    return df.filter(F.col(col) == 1)


# B4 ------------------------------------------------------------------------
def take_subset(df: DataFrame, n: int, order: str, predicate=None) -> DataFrame:
    """Optional predicate, then the first n rows in an explicit order."""
    if predicate is not None:
        df = df.filter(predicate)
    return df.orderBy(order).limit(n)


# B5 ------------------------------------------------------------------------
def even_rows(df: DataFrame, is_error_col: str = "is_error") -> DataFrame:
    return df.filter(~F.col(is_error_col))


# B6 ------------------------------------------------------------------------
def ok_centre(df: DataFrame, win_col: str, ids, size: int) -> DataFrame:
    """Rows whose window centre is one of ``ids``."""
    return df.filter(F.element_at(F.col(win_col), size // 2 + 1).isin(list(ids)))


# B7 ------------------------------------------------------------------------
def sample_batch(df: DataFrame, key: str, size: int, seed: int = 17, step: int = 0) -> DataFrame:
    """A batch of ``size`` rows without replacement: the top-k by keyed hash."""
    h = rng.u32(seed, "batch", F.lit(step), F.col(key))
    return df.withColumn("_h", h).orderBy("_h", key).limit(size).drop("_h")


# B8 ------------------------------------------------------------------------
def make_batches(df: DataFrame, key: str, size: int, seed: int = 17, epoch: int = 0,
                 drop_short: bool = False) -> DataFrame:
    """Shuffle by keyed hash, then consecutive batches (``batch_id``); the
    last batch may be short unless ``drop_short``."""
    h = df.withColumn("_h", rng.u32(seed, "epoch", F.lit(epoch), F.col(key)))
    idx = scale.dense_index(h, ["_h", key], scale.hash_bucket(F.col("_h"), 12), "_idx")
    out = idx.withColumn("batch_id", F.floor(F.col("_idx") / size).cast("bigint"))
    if drop_short:
        full = df.count() // size
        out = out.filter(F.col("batch_id") < full)
    return out.drop("_h", "_idx")


# B9 ------------------------------------------------------------------------
def pairwise_shuffle(df: DataFrame, pair_col: str = "pair_id", is_error_col: str = "is_error",
                     seed: int = 17) -> DataFrame:
    """Permute pairs, keeping each original next to its partner:
    ``new_idx`` = 2 * (rank of the pair by hash) + is_error."""
    df = kept(df)  # ranked and joined
    pairs = df.filter(~F.col(is_error_col)).select(pair_col)
    h = pairs.withColumn("_h", rng.u32(seed, "pairwise", F.col(pair_col)))
    ranked = scale.dense_index(h, ["_h", pair_col], scale.hash_bucket(F.col("_h"), 12), "_r").drop("_h")
    return df.join(ranked, pair_col).withColumn(
        "new_idx", 2 * F.col("_r") + F.col(is_error_col).cast("int")).drop("_r")


# B10 -----------------------------------------------------------------------
def reference_shares(df: DataFrame, class_col: str, reference: DataFrame) -> DataFrame:
    """Observed class shares next to reference percentages normalised to 1
    (both tables have one row per class)."""
    obs = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))
    obs = obs.withColumn("share", F.col("n") / F.sum("n").over(w))
    ref = reference.withColumn("ref_share", F.col("pct") / F.sum("pct").over(w)).drop("pct")
    return obs.join(ref, class_col, "full_outer")
