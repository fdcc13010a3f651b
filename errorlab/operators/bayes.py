"""Sparse naive Bayes as tables.

A model is two tables: the count of every (feature, class) that occurs, and a row per
class.  Fitting is one aggregation; nothing is collected.  Scoring never looks at classes
that share no feature with a row: log P(class | row) is

    log prior(c) + size * log(a / (total(c) + a v)) + sum over features log(1 + n(f, c) / a)

so the sum runs over an equi-join of the row's features with the counts, and for rows
whose best class may share no feature the best of the first two terms, which depends on
the row's size alone, competes as well.  That gives the exact maximum over all classes.

Logarithms are kept as whole millionths: sums do not depend on the order of rows, and any
engine gets the same answer.  Ties go to the smallest class.  Several models can live in
one pair of tables, told apart by the columns ``by`` (for example a grid of feature sets);
several smoothing constants ``alphas`` are scored in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

MILLION = 1_000_000
#: Counts up to which a model is sent to the tasks, and scores that a task holds at once.
SMALL, CELLS = 8_000_000, 1 << 22
#: The key of a single model.
ONE = "_model"


def _log(x: Column) -> Column:
    return F.round(F.log(x) * MILLION).cast("bigint")


def _shift() -> Column:
    """Labels are below this number."""
    return F.lit(10 ** 12).cast("decimal(13,0)")


def _answer(labels, bases, starts, posts, weights, found, sizes, row_ends):
    """Best label of each row.  ``bases``: (prior, per feature) of every class; the postings of
    feature ``f`` are ``posts[starts[f]:starts[f + 1]]`` (class numbers); ``found``: the rows'
    features, -1 for unknown ones.  Whole numbers below 2^53 throughout, so sums are exact."""
    out, k = np.empty(len(sizes), np.int64), len(labels)
    step, a = max(1, CELLS // k), 0
    # postings up to each row: a step holds at most about CELLS of them (or one row's)
    upto = np.concatenate(([0], np.cumsum(np.where(found >= 0, starts[found + 1] - starts[np.maximum(found, 0)], 0))))[row_ends]
    while a < len(sizes):
        z = min(a + step, len(sizes), max(a + 1, int(np.searchsorted(upto, upto[a] + CELLS, "right")) - 1))
        rows = np.repeat(np.arange(z - a), row_ends[a + 1:z + 1] - row_ends[a:z])
        f = found[row_ends[a]:row_ends[z]]
        rows, f = rows[f >= 0], f[f >= 0]
        many = starts[f + 1] - starts[f]
        at = np.repeat(starts[f] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        cell = np.repeat(rows, many) * k + posts[at]
        sums = np.bincount(cell, weights[at], (z - a) * k).astype(np.int64).reshape(z - a, k)
        sums += bases[0] + sizes[a:z, None] * bases[1]
        out[a:z] = labels[np.argmax(sums, 1)]  # the first of equal ones, the smallest label
        a = z
    return out


def _packed(posts: DataFrame, by, n: int) -> DataFrame:
    """``posts`` with one row per model and feature: its labels (64 bits each) and, for each
    smoothing constant, its weights (32 bits each) as bytes, packed in the tasks."""
    held = posts.groupBy(*by, "feature").agg(F.collect_list(F.struct("label", *[f"_w{i}" for i in range(n)])).alias("_p"))
    schema = StructType(held.schema.fields[:-1] + [StructField(c, BinaryType()) for c in ["labels", *[f"_w{i}" for i in range(n)]]])

    def step(batches):
        for b in batches:
            lists = b.column(b.num_columns - 1)
            flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            columns = [flat.field(0).to_numpy().astype(np.int64), *[flat.field(1 + i).to_numpy().astype(np.int32) for i in range(n)]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array([c[s:e].tobytes() for s, e in zip(ends, ends[1:])], pa.binary())
                                                                 for c in columns]], schema.names)

    return held.mapInArrow(step, schema)


def _predict_in_tasks(by, rows: DataFrame, carried, posts: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """``predict`` with the model in every task: each row is scored where it is, no shuffle."""
    models = {}
    def by_model(t: pa.Table):
        places = {}
        for i, key in enumerate(zip(*(t.column(c).to_pylist() for c in by))):
            places.setdefault(key, []).append(i)
        return ((key, t.take(pa.array(some))) for key, some in places.items())

    for key, t in by_model(classes.orderBy(*by, "label").toArrow()):  # a row per class
        models[key] = {"labels": t["label"].to_numpy().astype(np.int64),
                       "bases": [(t[f"_p{i}"].to_numpy().astype(np.int64), t[f"_u{i}"].to_numpy().astype(np.int64)) for i in range(n)]}
    # the counts come packed, 12 bytes each (4 more per further constant), not as rows
    for key, t in by_model(_packed(posts, by, n).toArrow()):
        def joined(column, kind):
            return np.frombuffer(b"".join(x.as_buffer() for x in t[column]), kind)

        many = [x.as_buffer().size // 8 for x in t["labels"]]
        models[key] |= {"names": t["feature"].combine_chunks(), "starts": np.concatenate(([0], np.cumsum(many))),
                        "posts": np.searchsorted(models[key]["labels"], joined("labels", np.int64)).astype(np.int32),
                        "weights": [joined(f"_w{i}", np.int32) for i in range(n)]}
    shared = rows.sparkSession.sparkContext.broadcast(models)
    answers = [f"prediction_{i}" for i in range(n)]
    out = rows.select(*carried, *by, "_f")
    schema = StructType(out.schema.fields[:-1] + [StructField(a, LongType()) for a in answers])

    def step(batches):
        import pyarrow.compute as pc

        for b in batches:
            feats, keys = b.column(b.num_columns - 1), [b.column(b.num_columns - 1 - len(by) + i) for i in range(len(by))]
            groups = {}
            for i, key in enumerate(zip(*(c.to_pylist() for c in keys))):
                groups.setdefault(key, []).append(i)
            told = [np.zeros(b.num_rows, np.int64) for _ in answers]
            known = np.zeros(b.num_rows, bool)
            for key, places in groups.items():
                m = shared.value.get(key)
                if m is None:
                    continue
                mine = feats.take(pa.array(places))
                sizes = pc.fill_null(pc.list_value_length(mine), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = mine.flatten()
                if "names" in m:
                    found = pc.fill_null(pc.index_in(flat, value_set=m["names"], skip_nulls=True), -1).to_numpy(zero_copy_only=False)
                    post = (m["starts"], m["posts"], m["weights"])
                else:
                    found, post = np.full(len(flat), -1), (np.zeros(1, int), np.zeros(0, int), [np.zeros(0, np.int32)] * n)
                ends = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
                known[places] = sizes >= 0
                for i in range(n):
                    told[i][places] = _answer(m["labels"], m["bases"][i], post[0], post[1], post[2][i], found, sizes, ends)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(t, pa.int64(), mask=~known) for t in told]], schema.names)

    return out.mapInArrow(step, schema)


@dataclass
class NaiveBayes:
    """``counts``: (by..., feature, label, n); ``classes``: (by..., label, docs, total,
    all_docs), where ``total`` counts the class's features.  Labels are whole numbers from
    0 on.  Both tables are read several times: :meth:`save` a model that is costly to make."""

    counts: DataFrame
    classes: DataFrame
    by: tuple[str, ...] = (ONE,)

    def save(self, path: str) -> None:
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        self.classes.write.mode("overwrite").parquet(f"{path}/classes")

    @classmethod
    def load(cls, spark, path: str, by: Sequence[str] = ()) -> NaiveBayes:
        return cls(spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/classes"), tuple(by) or (ONE,))


def fit(rows: DataFrame, label: str, features: str, by: Sequence[str] = (), weight: str | None = None) -> NaiveBayes:
    """Count tables of ``rows`` (``label``, array ``features``); ``weight`` is the number of
    times that a row stands for."""
    if not by:  # one model
        rows, by = rows.withColumn(ONE, F.lit(0)), [ONE]
    by = list(by)
    n = F.col(weight) if weight else F.lit(1)
    rows = rows.select(*by, F.col(label).alias("label"), F.col(features).alias("_f"), n.cast("bigint").alias("_w"))
    # An outer explode: a plain one has the optimizer push "not empty" below whatever made the features.
    counts = rows.select(*by, "label", "_w", F.explode_outer("_f").alias("feature")).filter(F.col("feature").isNotNull()) \
        .groupBy(*by, "feature", "label").agg(F.sum("_w").alias("n"))
    docs = rows.groupBy(*by, "label").agg(F.sum("_w").alias("docs"))
    totals = counts.groupBy(*by, "label").agg(F.sum("n").alias("total"))
    classes = docs.join(totals, [*by, "label"], "left").fillna(0, ["total"]) \
        .withColumn("all_docs", F.sum("docs").over(Window.partitionBy(*by)))  # a row per class
    return NaiveBayes(counts, classes, tuple(by))


def predict(model: NaiveBayes, rows: DataFrame, key: str, features: str, alphas: Sequence[float] = (1.0,),
            carry: Sequence[str] = ()) -> DataFrame:
    """``(by..., key, carry..., prediction_0, prediction_1, ...)``: the most probable class of
    each distinct ``key`` under each smoothing constant.  ``rows`` must hold one row per key
    (and model); a row without features gets the most frequent class.  A model of at most
    ``SMALL`` counts goes to the tasks, a larger one is joined."""
    by, ks = list(model.by), range(len(alphas))
    if by == [ONE]:
        rows = rows.withColumn(ONE, F.lit(0))
    rows = rows.select(*by, F.col(key).alias("_k"), F.col(features).alias("_f"), *carry).withColumn("_size", F.size("_f"))
    if by == [ONE]:
        classes = model.classes.withColumn("features", F.lit(model.counts.select("feature").distinct().count()))
    else:
        classes = model.classes.join(model.counts.groupBy(*by).agg(F.count_distinct("feature").alias("features")), by)
    classes = classes.select(
        *by, "label", *[x for i, a in enumerate(alphas) for x in (
            _log(F.col("docs") / F.col("all_docs")).alias(f"_p{i}"),
            _log(F.lit(float(a)) / (F.col("total") + F.lit(float(a)) * F.col("features"))).alias(f"_u{i}"))])

    def score(i: int, size: Column, found: Column) -> Column:
        """Score and class in one number, which a hash aggregate can take the maximum of."""
        s = F.col(f"_p{i}") + size * F.col(f"_u{i}") + found
        return s.cast("decimal(25,0)") * _shift() - F.col("label").cast("decimal(13,0)")

    posts = model.counts.select(*by, "feature", "label", *[_log(1 + F.col("n") / F.lit(float(a))).alias(f"_w{i}")
                                                           for i, a in enumerate(alphas)])
    if dict(posts.dtypes)["feature"] == "string" and model.counts.limit(SMALL + 1).count() <= SMALL:
        told = _predict_in_tasks(by, rows, ["_k", *carry], posts, classes, len(ks))
        return told.select(*[b for b in by if b != ONE], F.col("_k").alias(key), *carry, *[f"prediction_{i}" for i in ks])

    # What a class gets without any shared feature, for every size up to the largest.
    widest = rows.agg(F.max("_size")).first()[0] or 0
    least = classes.withColumn("_size", F.explode(F.sequence(F.lit(0), F.lit(max(widest, 0))))) \
        .groupBy(*by, "_size").agg(*[F.max(score(i, F.col("_size"), F.lit(0))).alias(f"_d{i}") for i in ks])
    # The sum over shared features.
    own = rows.select(*by, "_k", "_size", F.explode_outer("_f").alias("feature")).filter(F.col("feature").isNotNull()) \
        .groupBy(*by, "_k", "_size", "feature").agg(F.count(F.lit(1)).alias("_tf"))
    sums = own.join(posts, [*by, "feature"]).groupBy(*by, "_k", "_size", "label") \
        .agg(*[F.sum(F.col("_tf") * F.col(f"_w{i}")).alias(f"_s{i}") for i in ks])
    best = sums.join(classes, [*by, "label"]).groupBy(*by, "_k") \
        .agg(*[F.max(score(i, F.col("_size"), F.col(f"_s{i}"))).alias(f"_b{i}") for i in ks])
    out = rows.drop("_f").join(best, [*by, "_k"], "left").join(least, [*by, "_size"], "left")
    return out.select(*[b for b in by if b != ONE], F.col("_k").alias(key), *carry, *[
        F.pmod(-F.greatest(f"_b{i}", f"_d{i}"), _shift()).cast("long").alias(f"prediction_{i}") for i in ks])


def predict_sql(alpha: float, rows: str, counts: str, classes: str) -> str:
    """The oracle's twin: ``rows(m, k, f, tf, size)``, ``counts(m, feature, label, n)`` and
    ``classes(m, label, docs, total, all_docs, features)``, ``m`` telling models apart, give
    ``(m, k, prediction)``."""
    a = f"CAST({alpha} AS DOUBLE)"

    def log(x):
        return f"CAST(round(ln({x}) * {MILLION}) AS BIGINT)"

    base = f"{log('c.docs / c.all_docs')} + r.size * {log(f'{a} / (c.total + {a} * c.features)')}"
    return f"""
    SELECT m, k, arg_max(label, s * 1000000 - label) AS prediction FROM (
      SELECT r.m, r.k, c.label, any_value({base}) + sum(r.tf * p.w) AS s
      FROM {rows} r
      JOIN (SELECT m, feature, label, {log(f'1 + n / {a}')} AS w FROM {counts}) p ON p.m = r.m AND p.feature = r.f
      JOIN {classes} c ON c.m = p.m AND c.label = p.label GROUP BY r.m, r.k, c.label
      UNION ALL
      SELECT x.m, x.k, y.label, y.s FROM (SELECT DISTINCT m, k, size FROM {rows}) x JOIN (
        SELECT r.m, r.size, max(s) AS s, arg_max(label, s * 1000000 - label) AS label FROM (
          SELECT r.m, r.size, c.label, {base} AS s
          FROM (SELECT DISTINCT m, size FROM {rows}) r JOIN {classes} c ON c.m = r.m) r GROUP BY r.m, r.size) y
        ON y.m = x.m AND y.size = x.size) GROUP BY m, k"""
