"""Error injection, random but reproducible.

Every draw is keyed by business keys (see ``functions.rng``).  A loop of n
errors is unrolled into ``max_n`` successive projections, each applying one
step when ``step <= n``; the steps are plain string expressions that stay in
whole-stage codegen (no interpreted lambdas, no Python).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.text import (OPERATORS, corruption_step, draw_sql, edit_columns, edit_names, effective_count_sql,
                              method_end, prep_columns, prep_levels)
from ..session import kept
from . import scale, sizing


def apply_errors(df: DataFrame, src: str, out: str, op_col: str, n_col: str, max_n: int,
                 seed: int, tag: str, key_cols: Sequence[str]) -> DataFrame:
    """``out`` = ``src`` after ``n_col`` steps of the operator named in ``op_col``.

    ``delete`` never removes a whole string: its count is capped at len - 1.
    """
    # Every value is kept non-nullable (coalesce with the previous value, a
    # no-op for non-null input) so that no inferred IS NOT NULL filter is
    # pushed below these projections, where it would inline the whole chain.
    n_eff = f"_n_{out}"
    df = (df.withColumn(n_eff, F.coalesce(F.expr(effective_count_sql(op_col, n_col, src)), F.lit(0)))
            .withColumn(out, F.coalesce(F.col(src), F.lit(""))))
    drop = [n_eff]
    for step in range(1, max_n + 1):
        draws = draw_sql("spark", seed, tag, key_cols, step)
        # a hash is computed where the row's operator and count use it
        users = (f"{n_eff} >= {step}", f"{n_eff} >= {step} AND {op_col} IN ('insert', 'replace')",
                 f"{n_eff} >= {step} AND {op_col} = 'transpose'")
        df = df.withColumns({name: F.expr(f"CASE WHEN {use} THEN coalesce({e}, 0L) ELSE 0L END")
                             for use, (name, e) in zip(users, draws)})
        for level in prep_levels(out, tag, step):
            df = df.withColumns({name: F.expr(e) for name, e in level})
        df = df.withColumns(edit_columns(op_col, out, n_eff, tag, step))
        df = df.withColumn(out, F.coalesce(corruption_step(out, n_eff, tag, step), F.col(out), F.lit("")))
        drop += [name for name, _ in draws] + prep_columns(tag, step) + edit_names(tag, step)
    return df.drop(*drop)


def joined_keys(key_cols: Sequence[str]) -> Column:
    """The keys as one string, which gives the draws that the keys themselves give (hashes
    join their parts and leave out nulls) and is made once per row."""
    cols = [F.col(k).cast("string") for k in key_cols]
    return F.when(F.coalesce(*cols).isNotNull(), F.concat_ws("|", *cols))


# C1-C4 ---------------------------------------------------------------------
def corrupt_with(df: DataFrame, op: str, n: int, token_col: str = "token", out: str = "corrupted",
                 seed: int = 17, key_cols: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    """Apply ``n`` errors of one operator (insert/delete/replace/transpose)."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    df = df.withColumn("_op", F.lit(op)).withColumn("_n", F.lit(n))
    return apply_errors(df, token_col, out, "_op", "_n", n, seed, "token", key_cols).drop("_op", "_n")


def insert_chars(df, n=1, **kw):
    return corrupt_with(df, "insert", n, **kw)


def delete_chars(df, n=1, **kw):
    return corrupt_with(df, "delete", n, **kw)


def replace_chars(df, n=1, **kw):
    return corrupt_with(df, "replace", n, **kw)


def transpose_chars(df, n=1, **kw):
    return corrupt_with(df, "transpose", n, **kw)


# C5 ------------------------------------------------------------------------
def draw_operator(seed: int, key_cols: Sequence[str], ops: Sequence[str] = OPERATORS):
    arr = F.array(*[F.lit(o) for o in ops])
    return F.element_at(arr, (rng.pick(len(ops), seed, "op", *[F.col(k) for k in key_cols]) + 1).cast("int"))


def draw_count(seed: int, salt: str, key_cols: Sequence[str], counts: Sequence[int]):
    arr = F.array(*[F.lit(int(c)) for c in counts])
    return F.element_at(arr, (rng.pick(len(counts), seed, salt, *[F.col(k) for k in key_cols]) + 1).cast("int"))


def corrupt(df: DataFrame, n_errors: Sequence[int] = (1,), token_col: str = "token",
            out: str = "corrupt_token", seed: int = 17,
            key_cols: Sequence[str] = ("doc_id", "pos", "copy")) -> DataFrame:
    """One of the four operators chosen uniformly per row (``error_type``),
    error count drawn from ``n_errors`` (``n_token_errors``)."""
    df = (df.withColumn("error_type", method_end(draw_operator(seed, key_cols)))
            .withColumn("n_token_errors", draw_count(seed, "n_token", key_cols, n_errors)))
    return apply_errors(df, token_col, out, "error_type", "n_token_errors", max(n_errors),
                        seed, "token", key_cols)


# C6 ------------------------------------------------------------------------
def corrupt_context(df: DataFrame, n_errors: Sequence[int] = (0,), lead_col: str = "lead",
                    trail_col: str = "trail", seed: int = 17,
                    key_cols: Sequence[str] = ("doc_id", "pos", "copy"),
                    op_col: str = "error_type") -> DataFrame:
    """The row's operator applied to both contexts, with its own count
    (``n_context_errors``; 0 leaves the contexts untouched)."""
    df = df.withColumn("n_context_errors", draw_count(seed, "n_context", key_cols, n_errors))
    m = max(n_errors)
    df = apply_errors(df, lead_col, lead_col + "_c", op_col, "n_context_errors", m, seed, "lead", key_cols)
    df = apply_errors(df, trail_col, trail_col + "_c", op_col, "n_context_errors", m, seed, "trail", key_cols)
    return df


# C7 / C8 -------------------------------------------------------------------
def confusion_swap(df: DataFrame, centre_col: str, values: Sequence, key_col: str,
                   seed: int = 17, out: str = "current") -> DataFrame:
    """Each row followed by a copy (``is_error`` true) whose centre is a
    different member of ``values`` picked by hash.  Every other column,
    targets included (C8), is carried into both rows by the explode."""
    arr = F.array(*[F.lit(v) for v in values])
    other = F.element_at(F.array_except(arr, F.array(F.col(centre_col))),
                         (rng.pick(len(values) - 1, seed, "swap", F.col(key_col)) + 1).cast("int"))
    return (df.withColumn("is_error", F.explode(F.array(F.lit(False), F.lit(True))))
              .withColumn(out, F.when(F.col("is_error"), other).otherwise(F.col(centre_col))))


# C9 ------------------------------------------------------------------------
def permute_centre(df: DataFrame, key_col: str, centre_col: str, seed: int = 17,
                   buckets: int = 1 << 14, out: str = "permuted") -> DataFrame:
    """Permute ``centre_col`` across all rows.

    Row i in key order receives the centre of the row ranked i in hash order.
    Two dense indexes (each bucketed by an expression of the row) and one
    equi-join on the index; no row moves through the driver.
    """
    df = kept(df)
    h = rng.u32(seed, "permute", F.col(key_col))
    by_key = scale.dense_index_by_range(df, key_col, buckets, "_i")
    by_hash = scale.dense_index(df.select(key_col, centre_col).withColumn("_h", h),
                                ["_h", key_col], scale.hash_bucket(F.col("_h"), 12), "_i")
    donors = by_hash.select("_i", F.col(centre_col).alias(out))
    return by_key.join(donors, "_i").drop("_i")


# C10 -----------------------------------------------------------------------
def regularize_centre(df: DataFrame, centre_col: str, key_col: str, seed: int = 17,
                      out: str = "regularized", max_values: int = 10_000) -> DataFrame:
    """Replace the centre by a random *different* value of the observed set.

    The observed set is collected only behind a size check (it is a class
    set); set difference replaces the reference's rejection loop.
    """
    values = sizing.small_list(df.select(centre_col).distinct().orderBy(centre_col), centre_col, max_values)
    if values is None:
        raise ValueError("too many distinct centre values for a literal set")
    arr = F.array(*[F.lit(v) for v in values])
    rest = F.array_except(arr, F.array(F.col(centre_col)))
    pick = (rng.pick(F.greatest(F.size(rest), F.lit(1)), seed, "regularize", F.col(key_col)) + 1).cast("int")
    return df.withColumn(out, F.when(F.size(rest) > 0, F.element_at(rest, pick)).otherwise(F.col(centre_col)))


# C11 -----------------------------------------------------------------------
def edit_operations(pairs: DataFrame, correct: str = "correct", error: str = "error") -> DataFrame:
    """Classify single-edit (correct, error) pairs: ``op`` in insert/delete/
    replace with the characters involved (``from_ch`` -> ``to_ch``)."""
    a, b = F.col(correct), F.col(error)
    n = F.least(F.length(a), F.length(b))
    first = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                 lambda i: F.substring(a, i, 1) != F.substring(b, i, 1)))
    pos = F.coalesce(first, n + 1)
    op = (F.when(F.length(b) == F.length(a) + 1, "insert")
          .when(F.length(b) == F.length(a) - 1, "delete").otherwise("replace"))
    from_ch = F.when(op == "insert", F.lit("")).otherwise(F.substring(a, pos, 1))
    to_ch = F.when(op == "delete", F.lit("")).otherwise(F.substring(b, pos, 1))
    return pairs.select(correct, error, op.alias("op"), from_ch.alias("from_ch"), to_ch.alias("to_ch"))


def learned_corruption(pairs: DataFrame, correct: str = "correct", error: str = "error") -> DataFrame:
    """Edit-operation model estimated from real single-edit pairs:
    ``(op, from_ch, to_ch, n, p)`` with p the share inside the operator; the
    cumulative form is what keyed draws sample from."""
    ops = edit_operations(pairs, correct, error).groupBy("op", "from_ch", "to_ch").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    return ops.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("op")))
