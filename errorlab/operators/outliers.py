"""Outlier distances.

Moments are JVM-side aggregates (Spark ML ``Summarizer`` and ``Correlation``,
tree aggregation over partitions).  Only d x d matrices reach the driver (d is
the vector dimension, a property of the schema, not of the data size); the
per-row quadratic forms run vectorised in NumPy inside ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType



def _with_double(df: DataFrame, name: str) -> StructType:
    return StructType(list(df.schema.fields) + [StructField(name, DoubleType())])


def _vec(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.col(col).cast("array<double>")))


def moments(df: DataFrame, col: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and maximum-likelihood covariance (divided by n) of an array column."""
    v = _vec(df, col)
    s = v.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("_features")).alias("s")).first()["s"]
    mean = np.array(s["mean"].toArray())
    var = np.array(s["variance"].toArray())            # sample variance (n - 1)
    n = int(s["count"])
    corr = np.array(Correlation.corr(v, "_features").first()[0].toArray())
    sd = np.sqrt(var)
    cov = corr * np.outer(sd, sd) * (n - 1) / n
    cov[np.isnan(cov)] = 0.0
    return mean, cov, n


def _distance_fn(col: str, mean: np.ndarray, inv: np.ndarray, out: str):
    def fn(batches):
        for pdf in batches:
            if len(pdf) == 0:
                yield pdf.assign(**{out: pd.Series([], dtype="float64")})
                continue
            x = np.vstack(pdf[col].to_numpy()).astype("float64") - mean
            d = np.einsum("ij,jk,ik->i", x, inv, x)
            yield pdf.assign(**{out: d})
    return fn


def mahalanobis(df: DataFrame, col: str, out: str = "distance", mean=None, cov=None) -> DataFrame:
    """O1: squared Mahalanobis distance of each row to the sample mean."""
    if mean is None or cov is None:
        mean, cov, _ = moments(df, col)
    inv = np.linalg.pinv(cov)
    return df.mapInPandas(_distance_fn(col, mean, inv, out), _with_double(df, out))


@dataclass
class Shape:
    """A fitted location and scatter."""

    mean: np.ndarray
    cov: np.ndarray

    @property
    def inverse(self) -> np.ndarray:
        return np.linalg.pinv(self.cov)

    @property
    def log_det(self) -> float:
        """Log of the determinant, over the directions with any spread."""
        values = np.linalg.eigvalsh(self.cov)
        values = values[values > max(values.max(initial=0.0), 1e-300) * 1e-12]
        return float(np.log(values).sum()) - 1e6 * (len(self.cov) - len(values))


def _matrix(pdf: pd.DataFrame, col: str) -> np.ndarray:
    return np.vstack(pdf[col].to_numpy()).astype("float64")


def _ranks(x: np.ndarray, keys: pd.Series, shapes: Sequence[Shape], seed: int) -> np.ndarray:
    """For each shape and row a 96-bit rank in three 32-bit words: the bits of the squared
    distance (of doubles that are not negative these are in the order of the values), then
    a hash of the row's key, so that equal distances have an order too."""
    h = pd.util.hash_array((keys.astype("string").fillna("") + f"|{seed}").to_numpy(dtype=object), categorize=False)
    out = np.empty((len(shapes), len(x), 3), np.uint64)
    for i, s in enumerate(shapes):
        d = np.einsum("ij,jk,ik->i", x - s.mean, s.inverse, x - s.mean)
        bits = np.maximum(d, 0.0).view(np.uint64)
        out[i] = np.column_stack([bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF), h >> np.uint64(32)])
    return out


#: Bits that one pass over the data tells apart.
CUT_BITS = 16


def _cuts(df: DataFrame, col: str, key: str, shapes: Sequence[Shape], h: int, seed: int) -> list[int]:
    """For each shape the rank of its ``h``-th nearest row, found 16 bits at a time: each
    pass counts the rows of the bucket in which the cut falls by the next bits, so no
    sort is needed and no distance scale can put all rows into one bucket's task."""
    found, need = [0] * len(shapes), [h] * len(shapes)
    open_ = list(range(len(shapes)))
    for shift in range(96 - CUT_BITS, -1, -CUT_BITS):
        def count(batches, shift=shift, found=tuple(found), open_=tuple(open_)):
            for pdf in batches:
                if not len(pdf):
                    continue
                words = _ranks(_matrix(pdf, col), pdf[key], shapes, seed)
                for i in open_:
                    rank = words[i]
                    word, low = rank[:, 2 - shift // 32], shift % 32
                    same = np.ones(len(pdf), bool)
                    for at in range(shift + CUT_BITS, 96, CUT_BITS):  # bits settled by earlier passes
                        mine = rank[:, 2 - at // 32] >> np.uint64(at % 32) & np.uint64(0xFFFF)
                        same &= mine == np.uint64(found[i] >> at & 0xFFFF)
                    bucket, n = np.unique(word[same] >> np.uint64(low) & np.uint64(0xFFFF), return_counts=True)
                    yield pd.DataFrame({"i": np.full(len(n), i), "bucket": bucket.astype("int64"), "n": n})

        counts: dict[int, list] = {}
        for r in df.select(col, key).mapInPandas(count, "i int, bucket long, n long") \
                .groupBy("i", "bucket").agg(F.sum("n").alias("n")).collect():  # at most 2^16 rows a shape
            counts.setdefault(r["i"], []).append((r["bucket"], r["n"]))
        for i in list(open_):
            for bucket, n in sorted(counts.get(i, [])):
                if n >= need[i]:
                    found[i] |= bucket << shift
                    if n == need[i]:  # the whole bucket is inside
                        found[i] |= (1 << shift) - 1
                        open_.remove(i)
                    break
                need[i] -= n
            else:
                found[i] |= (1 << shift + CUT_BITS) - 1  # fewer rows than asked for: all
                open_.remove(i)
        if not open_:
            break
    return found


def _inside(rank: np.ndarray, cut: int) -> np.ndarray:
    """Which ranks are at most ``cut``."""
    out, same = np.zeros(len(rank), bool), np.ones(len(rank), bool)
    for j in range(3):
        mine = np.uint64(cut >> (64 - 32 * j) & 0xFFFFFFFF)
        out |= same & (rank[:, j] < mine)
        same &= rank[:, j] == mine
    return out | same


def _subset_shapes(df: DataFrame, col: str, key: str, shapes: Sequence[Shape], cuts: Sequence[int], seed: int) -> list[Shape]:
    """Mean and covariance of each shape's subset, from sums per task (d + d^2 numbers)."""
    def sums(batches):
        held: dict[int, tuple] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf, col)
            words = _ranks(x, pdf[key], shapes, seed)
            for i, cut in enumerate(cuts):
                y = x[_inside(words[i], cut)] - shapes[i].mean  # centred on the old mean: no cancellation
                n, a, b = held.get(i, (0, 0.0, 0.0))
                held[i] = n + len(y), a + y.sum(axis=0), b + y.T @ y
        if held:
            yield pd.DataFrame({"i": list(held), "n": [v[0] for v in held.values()],
                                "sums": [np.concatenate([v[1], v[2].ravel()]) for v in held.values()]})

    parts = df.select(col, key).mapInPandas(sums, "i int, n long, sums array<double>")
    told = parts.select("i", "n", F.posexplode("sums").alias("p", "v")).groupBy("i", "p") \
        .agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    d, out = len(shapes[0].mean), []
    for i, s in enumerate(shapes):
        mine = {r["p"]: r["v"] for r in told if r["i"] == i}
        n = next(r["n"] for r in told if r["i"] == i)
        total = np.array([mine[p] for p in range(d + d * d)]) / n
        shift = total[:d]
        out.append(Shape(s.mean + shift, total[d:].reshape(d, d) - np.outer(shift, shift)))
    return out


def minimum_covariance(df: DataFrame, col: str, key: str, starts: int = 4, first_steps: int = 2, iterations: int = 10,
                       best: int = 2, h_share: float | None = None, seed: int = 17) -> Shape:
    """The subset of ``h`` rows with the smallest covariance determinant, as its shape.

    Several starts: the classical shape of all rows, and those of small random subsets
    (the d + 1 or 2 d rows, whichever is more, with the smallest key hashes of a start).
    Concentration steps replace each subset by the ``h`` rows nearest to its shape; the
    determinant never grows.  After ``first_steps`` only the ``best`` starts go on, for
    up to ``iterations`` more or until nothing changes.  All starts share every pass over the data; the driver holds d x d
    matrices and counts only.  ``h`` defaults to (n + d + 1) // 2.
    """
    n, d = df.count(), len(df.select(col).first()[0])
    h = int(h_share * n) if h_share else (n + d + 1) // 2
    few = max(d + 1, 2 * d)
    shapes = [Shape(*moments(df, col)[:2])]
    for k in range(1, starts):
        order = F.xxhash64(F.col(key), F.lit(seed * 1000 + k))
        rows = df.select(col, key).orderBy(order, key).limit(few).collect()  # 2 d rows
        x = np.array([r[0] for r in rows], "float64")
        shapes.append(Shape(x.mean(axis=0), np.cov(x.T, bias=True).reshape(d, d) + 1e-9 * np.eye(d)))
    for step in range(first_steps + iterations):
        before = [s.log_det for s in shapes]
        shapes = _subset_shapes(df, col, key, shapes, _cuts(df, col, key, shapes, h, seed), seed)
        if step + 1 == first_steps:
            shapes = sorted(shapes, key=lambda s: s.log_det)[:best]
        elif step >= first_steps and all(b - s.log_det < 1e-10 for b, s in zip(before, shapes)):
            break
    return min(shapes, key=lambda s: s.log_det)


def robust_mahalanobis(df: DataFrame, col: str, key: str, out: str = "robust_distance", **options) -> DataFrame:
    """O2: squared Mahalanobis distance of each row to the minimum covariance determinant
    estimate (see :func:`minimum_covariance` for ``options``)."""
    shape = minimum_covariance(df, col, key, **options)
    return mahalanobis(df, col, out, shape.mean, shape.cov)


def pca_project(df: DataFrame, col: str, k: int = 2):
    """O3: principal components (Spark ML PCA); returns (DataFrame, model)."""
    v = _vec(df, col)
    model = PCA(k=k, inputCol="_features", outputCol="_pc").fit(v)
    out = model.transform(v).withColumn("pc", vector_to_array("_pc")).drop("_features", "_pc")
    return out, model


def recon_error(df: DataFrame, col: str, k: int = 2, out: str = "recon_error") -> DataFrame:
    """Squared error of the rank-k PCA reconstruction of each row."""
    projected, model = pca_project(df, col, k)
    pcs = np.array(model.pc.toArray())                  # d x k, bounded by the schema

    def fn(batches):
        for pdf in batches:
            if len(pdf) == 0:
                yield pdf.assign(**{out: pd.Series([], dtype="float64")})
                continue
            x = np.vstack(pdf[col].to_numpy()).astype("float64")
            r = x - (x @ pcs) @ pcs.T
            yield pdf.assign(**{out: (r * r).sum(axis=1)})

    return projected.mapInPandas(fn, _with_double(projected, out))


def scale01(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(x - min) / (max - min), NaN ignored in min/max and kept as NaN."""
    out = out or col + "_01"
    clean = F.when(~F.isnan(col), F.col(col))
    lo, hi = df.agg(F.min(clean), F.max(clean)).first()
    span = (hi - lo) if hi is not None and hi != lo else 1.0
    return df.withColumn(out, (F.col(col) - F.lit(lo)) / F.lit(span))


def grid(df: DataFrame, xcol: str, ycol: str, n: int = 50, widen: float = 0.1) -> DataFrame:
    """N x n evenly spaced points over the range of two columns widened by
    ``widen`` of the range on each side (two nested explodes, no join)."""
    (x0, x1, y0, y1) = df.agg(F.min(xcol), F.max(xcol), F.min(ycol), F.max(ycol)).first()
    dx, dy = (x1 - x0) * widen, (y1 - y0) * widen
    x0, x1, y0, y1 = x0 - dx, x1 + dx, y0 - dy, y1 + dy
    sp = df.sparkSession
    return (sp.range(n).select(F.col("id").cast("int").alias("ix"))
            .select("ix", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("iy"))
            .select("ix", "iy", (F.lit(x0) + F.col("ix") * F.lit((x1 - x0) / (n - 1))).alias("gx"),
                    (F.lit(y0) + F.col("iy") * F.lit((y1 - y0) / (n - 1))).alias("gy")))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of two columns."""
    return df.agg(F.corr(a, b).alias("pearson"), F.count(F.lit(1)).alias("n"))
