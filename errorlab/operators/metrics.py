"""Evaluation metrics as grouped aggregates.

Every report is one grouped pass: the reference's loops over classes, lengths
or words become grouping keys.  A k x k count table per group is the only
intermediate; it is tiny next to the scored rows.

Undefined ratios are 0 (precision with no predictions, recall with no true
rows, F with P = R = 0); macro averages run over the union of classes seen in
truth and prediction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scale


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def fbeta(p: Column, r: Column, beta: float) -> Column:
    b2 = beta * beta
    return F.when((p + r) > 0, (1 + b2) * p * r / (b2 * p + r)).otherwise(F.lit(0.0))


# M1 ------------------------------------------------------------------------
def confusion(df: DataFrame, y: str, yhat: str, classes: Sequence[int] | None = None,
              group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group..., y, yhat, n)`` with every cell of the class grid, empty
    cells included.  The grid comes from a checked-small class list exploded
    per class (no join of the data with itself)."""
    g = list(group_cols)
    counts = df.groupBy(*g, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        classes = sorted(r[0] for r in df.select(F.col(y)).union(df.select(F.col(yhat))).distinct().collect())
    cls = F.array(*[F.lit(int(c)) for c in classes])
    groups = df.select(*g).distinct() if g else df.sparkSession.range(1).select()
    grid = groups.select(*g, F.explode(cls).alias("y")).select(*g, "y", F.explode(cls).alias("yhat"))
    return grid.join(counts, g + ["y", "yhat"], "left").select(*g, "y", "yhat", F.coalesce("n", F.lit(0)).alias("n"))


# M2 ------------------------------------------------------------------------
def prf_per_class(df: DataFrame, y: str, yhat: str, beta: float = 1.0,
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group..., class_id, precision, recall, fscore, support)``."""
    g = list(group_cols)
    counts = df.groupBy(*g, F.col(y).alias("_y"), F.col(yhat).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    true_c = counts.groupBy(*g, F.col("_y").alias("class_id")).agg(
        F.sum("_n").alias("support"), F.sum(F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)).alias("tp"))
    pred_c = counts.groupBy(*g, F.col("_p").alias("class_id")).agg(F.sum("_n").alias("predicted"))
    t = true_c.join(pred_c, g + ["class_id"], "full_outer").fillna(0, ["support", "tp", "predicted"])
    p = _ratio(F.col("tp"), F.col("predicted"))
    r = _ratio(F.col("tp"), F.col("support"))
    return t.select(*g, "class_id", p.alias("precision"), r.alias("recall"),
                    fbeta(p, r, beta).alias("fscore"), F.col("support").cast("bigint").alias("support"))


# M3 ------------------------------------------------------------------------
def prf_average(per_class: DataFrame, average: str = "macro", group_cols: Sequence[str] = ()) -> DataFrame:
    """Macro or support-weighted average of M2; support = number of rows."""
    g = list(group_cols)
    s = F.col("support")
    if average == "macro":
        aggs = [F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                F.avg("fscore").alias("fscore")]
    elif average == "weighted":
        aggs = [(F.sum(F.col(c) * s) / F.sum(s)).alias(c) for c in ("precision", "recall", "fscore")]
    else:
        raise ValueError("average must be macro or weighted (binary: use binary_prf)")
    return per_class.groupBy(*g).agg(*aggs, F.sum(s).alias("support"))


def binary_prf(df: DataFrame, y: Column, yhat: Column, betas=(1.0, 0.5), group_cols: Sequence = ()) -> DataFrame:
    """Precision/recall/F of the positive class 1 (detection, M7/M12)."""
    agg = df.groupBy(*group_cols).agg(
        F.sum((y & yhat).cast("int")).alias("tp"), F.sum(yhat.cast("int")).alias("flagged"),
        F.sum(y.cast("int")).alias("positives"), F.count(F.lit(1)).alias("n"))
    p = _ratio(F.col("tp"), F.col("flagged"))
    r = _ratio(F.col("tp"), F.col("positives"))
    cols = [p.alias("precision"), r.alias("recall")] + \
           [fbeta(p, r, b).alias("f" + str(b).replace(".", "").rstrip("0")) for b in betas]
    return agg.select(*group_cols, *cols, "n")


# M5 ------------------------------------------------------------------------
def fbeta_from_counts(df: DataFrame, y: str, yhat: str, k: int, beta: float = 0.5,
                      eps: float = 1e-9) -> DataFrame:
    """Fβ with eps smoothing from one-hot truth and prediction:
    ``(scope, class_id, fbeta)`` per class plus 'macro' and 'weighted'."""
    rows = df.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                                              lambda i: F.struct((F.col(y) == i).cast("int").alias("t"),
                                                                 (F.col(yhat) == i).cast("int").alias("h"))))
                     .alias("class_id", "c"))
    per = rows.groupBy("class_id").agg(
        F.sum(F.col("c.t") * F.col("c.h")).alias("tp"),
        F.sum(((F.col("c.h") - F.col("c.t")) == 1).cast("int")).alias("fp"),
        F.sum(((F.col("c.h") - F.col("c.t")) == -1).cast("int")).alias("fn"),
        F.sum("c.t").alias("support"))
    p = F.col("tp") / (F.col("tp") + F.col("fp") + eps)
    r = F.col("tp") / (F.col("tp") + F.col("fn") + eps)
    b2 = beta * beta
    per = per.withColumn("fbeta", (1 + b2) * p * r / (b2 * p + r + eps))
    macro = per.agg(F.avg("fbeta").alias("fbeta")).select(F.lit("macro").alias("scope"),
                                                          F.lit(None).cast("int").alias("class_id"), "fbeta")
    weighted = per.agg((F.sum(F.col("fbeta") * F.col("support")) / F.sum("support")).alias("fbeta")) \
        .select(F.lit("weighted").alias("scope"), F.lit(None).cast("int").alias("class_id"), "fbeta")
    return per.select(F.lit("class").alias("scope"), F.col("class_id").cast("int"), "fbeta") \
        .unionByName(macro).unionByName(weighted)


# M6 ------------------------------------------------------------------------
def accuracy(df: DataFrame, y: str, yhat: str, group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols).agg(F.avg((F.col(y) == F.col(yhat)).cast("int")).alias("accuracy"),
                                       F.count(F.lit(1)).alias("n"))


# M9 ------------------------------------------------------------------------
def pr_curve(long_scores: DataFrame, class_col: str = "k", label_col: str = "label", p_col: str = "p",
             bits: int = 12) -> DataFrame:
    """One-vs-rest precision/recall at every distinct score of every class,
    plus the end point (precision 1, recall 0, threshold NULL).

    Cumulative counts from the highest score down use two-level prefix sums
    (``scale.prefix_sums_desc``): no window holds a whole class.
    """
    pos = (F.col(label_col) == F.col(class_col)).cast("long")
    agg = long_scores.groupBy(F.col(class_col).alias("k"), F.col(p_col).alias("threshold")).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    cum = scale.prefix_sums_desc(agg, ["k"], "threshold", ["pos", "neg"], bits)
    totals = agg.groupBy("k").agg(F.sum("pos").alias("_P"))
    pts = cum.join(totals, "k").select(
        "k", "threshold",
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        _ratio(F.col("cum_pos"), F.col("_P")).alias("recall"))
    ends = totals.select("k", F.lit(None).cast("double").alias("threshold"),
                         F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(ends)


# M15 -----------------------------------------------------------------------
def size_vs_f1(pairs_prf: DataFrame, exclude: str | None = None, word_col: str = "current") -> DataFrame:
    df = pairs_prf if exclude is None else pairs_prf.filter(F.col(word_col) != exclude)
    return df.agg(F.corr(F.col("support").cast("double"), F.col("fscore")).alias("corr"),
                  F.count(F.lit(1)).alias("n_pairs"))


def window_first(df: DataFrame, order, group_cols) -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
