"""Dataset assembly and splitting.

``build_examples`` is the flagship job: corpus text -> labelled spelling-error
examples with contexts and character codes.  Physical plan:

* contexts are computed on each document row (``contexts_from_text``): no
  shuffle by document, no window over a whole document;
* the vocabulary (<= max_features rows) and the nearest-word table (one row per
  vocabulary term) are broadcast behind that bound;
* copies are an ``explode`` of a small sequence; corruption and encoding are
  per-row expressions.

So the whole job is a single narrow stage over the documents once the two
small tables exist.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..session import kept
from . import corrupt as C
from . import scale, sizing
from . import text as T
from . import windows as W

CONTEXT_FACTOR = 1_000_000    # context_id = doc_id * CONTEXT_FACTOR + pos


@dataclass(frozen=True)
class ExampleSpec:
    max_token_length: int = 15
    lead: int = 10
    trail: int = 10
    leading_separator: str = "{"
    trailing_separator: str = "}"
    copies: int = 2
    n_token_errors: Sequence[int] = (1, 2)
    n_context_errors: Sequence[int] = (0, 1)
    seed: int = 17

    @property
    def max_ctx(self) -> int:
        return 2 * max(self.n_context_errors)

    @property
    def window_width(self) -> int:
        return (self.lead + self.max_token_length + self.trail + len(self.leading_separator)
                + len(self.trailing_separator) + max(self.n_token_errors) + self.max_ctx)


# D1 / D2 -------------------------------------------------------------------
def build_examples(docs: DataFrame, vocab: DataFrame, nearest_df: DataFrame, chars: DataFrame | None,
                   spec: ExampleSpec = ExampleSpec(), max_features: int = 100_000,
                   encode: bool = True, keep: Sequence[str] | None = None, joined: bool = False) -> DataFrame:
    """Corrupted copies of every occurrence of every vocabulary term.

    ``nearest_df`` is ``(term, nearest, distance)`` (N3).  Returns the scalar
    columns of the reference frame plus four ``array<int>`` code columns when
    ``encode`` (else the strings ``lead_c``, ``trail_c`` and ``full_window``); ``keep`` names
    the scalar columns wanted beside the codes, ``joined`` gives codes as strings ("1,2,3").
    """
    v = sizing.broadcast_if_small(
        vocab.filter(F.length("term") <= spec.max_token_length).select("term", "term_id"), bound=max_features)
    nb = sizing.broadcast_if_small(nearest_df.select("term", "nearest", "distance"), bound=max_features)
    ctx = W.contexts_from_text(docs.select("doc_id", "text"), spec.lead, spec.trail, terms=v)
    ex = (ctx.drop("token").join(nb, "term", "left")
          .withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(spec.copies))))
          .withColumn("_key", C.joined_keys(("doc_id", "pos", "copy"))))
    keys = ("_key",)
    ex = C.corrupt(ex, spec.n_token_errors, token_col="term", out="corrupt_token", seed=spec.seed, key_cols=keys)
    ex = C.corrupt_context(ex, spec.n_context_errors, seed=spec.seed, key_cols=keys)
    context_id = F.col("doc_id") * CONTEXT_FACTOR + F.col("pos")
    window = F.rpad(F.concat(F.col("lead_c"), F.lit(spec.leading_separator), F.col("corrupt_token"),
                             F.lit(spec.trailing_separator), F.col("trail_c")), spec.window_width, " ")
    ex = (ex.withColumn("context_id", context_id)
            .withColumn("example_id", context_id * spec.copies + F.col("copy") - 1)
            .withColumn("full_window", window)
            .select(F.col("term_id").alias("correction"), "error_type", "context_id", "example_id",
                    F.col("distance").cast("double").alias("edit_distance_to_nearest_term"), "nearest",
                    F.length("term").alias("term_length"), F.col("term").alias("correct_token"),
                    "corrupt_token", "lead_c", "trail_c", "full_window", "doc_id", "pos", "copy",
                    "n_token_errors", "n_context_errors"))
    if not encode:
        return ex
    return T.encode_columns(ex, chars, {
        "full_error": ("full_window", spec.window_width),
        "leading_context": ("lead_c", spec.lead + spec.max_ctx),
        "spelling_error": ("corrupt_token", spec.max_token_length + max(spec.n_token_errors)),
        "trailing_context": ("trail_c", spec.trail + spec.max_ctx)}, keep, joined)


def corrupted_occurrences(tokens: DataFrame, vocab: DataFrame, spec: ExampleSpec = ExampleSpec(),
                          max_features: int = 100_000) -> DataFrame:
    """The examples of ``build_examples`` without contexts and nearest words: same rows,
    keys and spellings (draws depend on the keys alone), one narrow stage over the tokens."""
    v = sizing.broadcast_if_small(
        vocab.filter(F.length("term") <= spec.max_token_length).select("term", "term_id"), bound=max_features)
    ex = tokens.join(v, tokens["token"] == v["term"]).drop("token") \
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(spec.copies)))) \
        .withColumn("_key", C.joined_keys(("doc_id", "pos", "copy")))
    ex = C.corrupt(ex, spec.n_token_errors, token_col="term", out="corrupt_token", seed=spec.seed, key_cols=("_key",))
    context_id = F.col("doc_id") * CONTEXT_FACTOR + F.col("pos")
    return ex.select(F.col("term_id").alias("correction"), "error_type", context_id.alias("context_id"),
                     (context_id * spec.copies + F.col("copy") - 1).alias("example_id"),
                     F.col("term").alias("correct_token"), "corrupt_token", "doc_id", "pos", "copy", "n_token_errors")


# D3 ------------------------------------------------------------------------
def group_split(df: DataFrame, by: Sequence[str], train: float = 0.8, valid: float = 0.5,
                seed: int = 17, out: str = "split") -> DataFrame:
    """train/valid/test so that no group crosses a split.

    The split is a function of the group key's hash: stable, no shuffle, and
    recomputation after a lost executor gives the same answer.  ``valid`` is
    a share of what is not train.  Sizes are approximate (per group).
    """
    u = F.pmod(rng.u32(seed, "split", *[F.col(c) for c in by]), F.lit(1_000_000))
    t_cut = int(round(train * 1_000_000))
    v_cut = int(round((train + (1 - train) * valid) * 1_000_000))
    return df.withColumn(out, F.when(u < t_cut, "train").when(u < v_cut, "valid").otherwise("test"))


def exact_group_split(df: DataFrame, by: Sequence[str], train: float = 0.8, valid: float = 0.5,
                      seed: int = 17, out: str = "split") -> DataFrame:
    """``group_split`` to exact quotas: whole groups, in the order of their key's hash, fill
    train while the rows so far stay within its quota, then valid (a share of the rest),
    then test.

    Running sums over the groups are two-level: row counts per hash bucket, running totals
    of the (at most 2^14) buckets, and running sums inside a bucket, so no window spans all
    groups.  Counts are partial before the shuffle; the rows get their split by one join.
    """
    by = list(by)
    df = kept(df)  # counted and joined
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    groups = kept(groups.withColumn("_h", rng.u32(seed, "split", *[F.col(c) for c in by])) \
        .withColumn("_b", scale.hash_bucket(F.col("_h"), 14)))
    buckets = groups.groupBy("_b").agg(F.sum("_n").alias("_rows"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = buckets.select("_b", (F.sum("_rows").over(upto) - F.col("_rows")).alias("_off"),
                             F.sum("_rows").over(whole).alias("_all"))
    inside = Window.partitionBy("_b").orderBy("_h", *by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("_off") + F.sum("_n").over(inside)
    shares = [int(round(x * 1000)) for x in (train, train + (1 - train) * valid)]
    cuts = [F.floor(F.col("_all") * x / 1000) for x in shares]
    placed = groups.join(F.broadcast(offsets), "_b").withColumn("_end", end) \
        .select(*by, F.when(F.col("_end") <= cuts[0], "train").when(F.col("_end") <= cuts[1], "valid")
                .otherwise("test").alias(out))
    return df.join(placed, by)


# D4 ------------------------------------------------------------------------
def leakage_check(df: DataFrame, by: str, split_col: str = "split") -> DataFrame:
    """``(split_a, split_b, n_shared)``: group keys present in two splits
    (0 everywhere means no leakage).  Distinct keys per split, then an
    equi-join on the key."""
    keys = df.select(by, split_col).distinct()
    a = keys.select(F.col(by), F.col(split_col).alias("split_a"))
    b = keys.select(F.col(by), F.col(split_col).alias("split_b"))
    splits = df.sparkSession.createDataFrame(
        [("train", "valid"), ("train", "test"), ("valid", "test")], "split_a string, split_b string")
    shared = a.join(b, by).filter(F.col("split_a") < F.col("split_b")) \
        .groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("n_shared"))
    canon = shared.select(F.least("split_a", "split_b").alias("x"), F.greatest("split_a", "split_b").alias("y"),
                          "n_shared")
    grid = splits.select(F.least("split_a", "split_b").alias("x"), F.greatest("split_a", "split_b").alias("y"),
                         "split_a", "split_b")
    return (grid.join(canon, ["x", "y"], "left")
            .select("split_a", "split_b", F.coalesce("n_shared", F.lit(0)).alias("n_shared")))


# D5 ------------------------------------------------------------------------
def range_split(df: DataFrame, key: str, train: float = 0.8, valid: float = 0.1,
                buckets: int = 1 << 14) -> DataFrame:
    """Consecutive ranges in key order: first ``train`` share, then ``valid``."""
    df = kept(df)
    indexed = scale.dense_index_by_range(df, key, buckets)
    n = df.count()
    t_end = n * int(round(train * 1000)) // 1000
    v_end = n * int(round((train + valid) * 1000)) // 1000
    return indexed.withColumn("split", F.when(F.col("idx") < t_end, "train")
                              .when(F.col("idx") < v_end, "valid").otherwise("test"))


# D6 ------------------------------------------------------------------------
def binary_real_word(df: DataFrame, col: str, dictionary: DataFrame, word_col: str = "term",
                     out: str = "is_real_word") -> DataFrame:
    """1 if ``col`` is a dictionary word, else 0 (left join on the word)."""
    d = sizing.broadcast_if_small(dictionary.select(F.col(word_col).alias("_w")).distinct().withColumn("_hit", F.lit(1)))
    return (df.join(d, df[col] == d["_w"], "left")
            .withColumn(out, F.coalesce("_hit", F.lit(0)))
            .drop("_w", "_hit"))
