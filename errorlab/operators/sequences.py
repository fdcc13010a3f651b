"""Ordered sequences and run-log analytics (§2.14, R1-R7).

Long form ``(seq_id, t, v)``.  Neighbour access uses equi-joins on
(seq_id, t + offset) rather than windows keyed by the sequence alone, so a
sequence holding a large share of all rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scale


def sequence_index(df: DataFrame, seq_col: str, order_cols: Sequence[str], day,
                   name: str = "t") -> DataFrame:
    """0-based position inside each sequence following ``order_cols``.

    Two levels: counts per (sequence, day) and their running offsets (one row
    per sequence-day), then row numbers inside each (sequence, day).
    """
    d = df.withColumn("_d", F.col(day) if isinstance(day, str) else day)
    cnt = d.groupBy(seq_col, "_d").agg(F.count(F.lit(1)).alias("_n"))
    off = cnt.select(seq_col, "_d", (F.sum("_n").over(
        Window.partitionBy(seq_col).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_o"))
    w = Window.partitionBy(seq_col, "_d").orderBy(*order_cols)
    return d.join(off, [seq_col, "_d"]).withColumn(name, (F.col("_o") + F.row_number().over(w) - 1).cast("int")) \
        .drop("_d", "_o")


# X1 ------------------------------------------------------------------------
def temporal_difference(seq: DataFrame, seq_col: str = "seq_id", t_col: str = "t", v_col: str = "v") -> DataFrame:
    """x[t+1] - x[t]; the sequence shrinks by one (self equi-join on t+1)."""
    nxt = seq.select(F.col(seq_col), (F.col(t_col) - 1).alias(t_col), F.col(v_col).alias("_next"))
    return seq.join(nxt, [seq_col, t_col]).select(seq_col, t_col, (F.col("_next") - F.col(v_col)).alias("d"))


# X2 ------------------------------------------------------------------------
def split_by_filter(vectors: DataFrame, id_col: str, vec_col: str, k: int, w: int) -> DataFrame:
    """Cut each vector into k blocks of width w: ``(id, block, j, v)``."""
    ex = vectors.select(id_col, F.posexplode(vec_col).alias("_i", "v")).filter(F.col("_i") < k * w)
    return ex.select(id_col, F.floor(F.col("_i") / w).cast("int").alias("block"),
                     F.pmod(F.col("_i"), F.lit(w)).cast("int").alias("j"), F.col("v").cast("double").alias("v"))


# X3 ------------------------------------------------------------------------
def max_energy_window(seq: DataFrame, w: int, group_cols: Sequence[str] = ("seq_id",), t_col: str = "t",
                      v_col: str = "v") -> DataFrame:
    """The w consecutive steps with the greatest sum of squares per group
    (smallest start on ties; only full windows), returned as rows.

    Window sums: each row is offered to the w windows that contain it
    (explode of offsets, equi-join on the start), then summed per start;
    the best start per group is a struct max; the range join back is an
    explode of the w positions and an equi-join on (group, t).
    """
    g = list(group_cols)
    e = seq.select(*g, t_col, (F.col(v_col) * F.col(v_col)).alias("_e"))
    starts = e.select(*g, t_col, "_e", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("_o")) \
        .select(*g, (F.col(t_col) - F.col("_o")).alias("_s"), "_e")
    sums = starts.filter(F.col("_s") >= 0).groupBy(*g, "_s").agg(F.sum("_e").alias("energy"),
                                                                 F.count(F.lit(1)).alias("_n"))
    best = sums.filter(F.col("_n") == w).groupBy(*g).agg(
        F.max(F.struct("energy", (-F.col("_s")).alias("_ns"))).alias("_b"))
    rows = best.select(*g, (-F.col("_b._ns")).alias("start"), F.col("_b.energy").alias("energy")) \
        .withColumn(t_col, F.explode(F.sequence(F.col("start"), F.col("start") + w - 1)))
    return rows.join(seq, g + [t_col]).select(*g, "start", t_col, v_col, "energy")


# X4 ------------------------------------------------------------------------
def zero_diagonal(cells: DataFrame, i: str = "i", j: str = "j", v: str = "v") -> DataFrame:
    return cells.withColumn(v, F.when(F.col(i) == F.col(j), F.lit(0.0)).otherwise(F.col(v)))


# X5 ------------------------------------------------------------------------
def embed(tokens: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
          max_vectors: int | None = None) -> DataFrame:
    """Frozen vector per token id.  Every token stays: id 0 (unknown / padding) and ids
    without a vector get NULL."""
    from . import sizing
    v = sizing.broadcast_if_small(vectors.select(id_col, vec_col), 1_000_000, bound=max_vectors)
    return tokens.join(v.filter(F.col(id_col) != 0), id_col, "left")


# X6 ------------------------------------------------------------------------
def max_pool(embedded: DataFrame, group_col: str, width: int, vec_col: str = "embedding") -> DataFrame:
    """Maximum per dimension over time: ``(group, dim, max_v)`` (partial
    aggregation before the shuffle).  Every group has ``width`` rows; tokens without a
    vector don't count, and a group of such tokens only has NULL in every dimension."""
    none = F.array_repeat(F.lit(None), width).cast("array<double>")
    vec = F.coalesce(F.col(vec_col).cast("array<double>"), none)
    return embedded.select(group_col, F.posexplode(vec).alias("dim", "_v")) \
        .groupBy(group_col, "dim").agg(F.max("_v").alias("max_v"))


# ---------------------------------------------------------------------------
# Run logs: (run_id, epoch, batch, metric, size)
# ---------------------------------------------------------------------------

def running_mean(log: DataFrame, metric: str = "metric") -> DataFrame:
    """Cumulative mean of the batch metric inside each (run, epoch)."""
    w = Window.partitionBy("run_id", "epoch").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("running_mean", F.avg(metric).over(w))


def weighted_epoch_mean(log: DataFrame, metric: str = "metric", size: str = "size") -> DataFrame:
    """R2: sum(metric * size) / sum(size) per (run, epoch)."""
    return log.groupBy("run_id", "epoch").agg(
        F.try_divide(F.sum(F.col(metric) * F.col(size)), F.sum(size)).alias("epoch_mean"), F.sum(size).alias("n"))


def best_so_far(epochs: DataFrame, metric: str = "val_loss", mode: str = "min") -> DataFrame:
    """Running best and its epoch (epoch-level rows: a run has few)."""
    key = F.col(metric) if mode == "min" else -F.col(metric)
    w = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    b = F.min(F.struct(key.alias("_k"), F.col("epoch").alias("_e"))).over(w)
    return epochs.withColumn("_b", b).withColumn("best", F.col("_b._k") if mode == "min" else -F.col("_b._k")) \
        .withColumn("best_epoch", F.col("_b._e")).drop("_b")


def early_stop(epochs: DataFrame, patience: int, metric: str = "val_loss", mode: str = "min") -> DataFrame:
    """First epoch with epoch - best_epoch > patience, else the last epoch."""
    b = best_so_far(epochs, metric, mode)
    return b.groupBy("run_id").agg(
        F.coalesce(F.min(F.when(F.col("epoch") - F.col("best_epoch") > patience, F.col("epoch"))),
                   F.max("epoch")).alias("stop_epoch"))


def lr_drop(epochs: DataFrame, patience: int, divisor: float = 10.0, lr: float = 1.0,
            metric: str = "val_loss") -> DataFrame:
    """Learning rate divided once, from the first epoch where the metric
    has not improved for ``patience`` epochs."""
    b = best_so_far(epochs, metric)
    first = b.filter(F.col("epoch") - F.col("best_epoch") >= patience).groupBy("run_id") \
        .agg(F.min("epoch").alias("_drop"))
    return b.join(first, "run_id", "left").withColumn(
        "lr", F.when(F.col("_drop").isNotNull() & (F.col("epoch") >= F.col("_drop")), F.lit(lr / divisor))
        .otherwise(F.lit(lr)).cast("double")).drop("_drop")


def best_per_group(runs: DataFrame, group_col: str, metric: str = "val_loss") -> DataFrame:
    """Per group, the run with the lowest metric (ties: smaller run id)."""
    return runs.groupBy(group_col).agg(F.min(F.struct(metric, "run_id")).alias("_b")) \
        .select(group_col, F.col("_b.run_id").alias("run_id"), F.col(f"_b.{metric}").alias(metric))


def feature_comparison(epochs: DataFrame, feature_col: str, features: Sequence[str], metric: str) -> DataFrame:
    """Metric per epoch, one column per feature set (pivot on a
    checked-small list)."""
    return epochs.groupBy("epoch").pivot(feature_col, list(features)).agg(F.avg(metric))
