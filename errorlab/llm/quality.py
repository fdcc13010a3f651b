"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of each document (lengths, shares of symbol classes, repetition) are
standardised by the mean and deviation over all documents.  ``FEATURES`` random Fourier
features, ``sqrt(2 / D) cos(w x + b)``, approximate a Gaussian kernel over them.  Ridge
scores come from the normal equations: every task sums ``Z'Z`` and ``Z'y`` over its
labelled rows, Spark adds the sums, the driver solves one ``D x D`` system.  An isotonic
fit of the labels on the scores, from counts in ``BINS`` equal score ranges, makes them
probabilities.

All labelled rows that learning may use are used.  A key with several labels counts as
good if one of them is.  Null texts count as empty; statistics of empty texts are zero.
Without labels every text scores one half; rows that repeat a key are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import longs, materialize, pick, table, text_steps, utf8
from .hashing import prefix, runs, span

FEATURES = 256
RIDGE = 1e-3
BINS = 2000
THRESHOLD = 0.3
STATISTICS = ("bytes", "words", "lines", "word_length", "upper", "digit", "mark", "pipe", "bang", "blank",
              "non_ascii", "distinct_words", "distinct_lines", "repeated_line_bytes", "longest_word",
              "marked_words")

_CLASS = np.zeros(256, np.int64)  # 0 lower case and control, then as named
for _i, _codes in enumerate((range(65, 91), range(48, 58), [*range(34, 48), *range(58, 65), *range(91, 97), 123, 125, 126],
                             [124], [33], [9, 10, 13, 32], range(128, 256)), 1):
    _CLASS[list(_codes)] = _i
_IS_WORD = _CLASS != 6
_IS_LINE = np.arange(256) != 10


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different values per text, and which elements repeat an earlier one."""
    order = np.lexsort((h, doc))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return np.bincount(doc[~again], minlength=n), again


def statistics(arr: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    buf, offs = utf8(arr)
    n = len(arr)
    size = np.diff(offs)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * 8 + _CLASS[buf], minlength=8 * n).reshape(n, 8)
    share = kinds / np.maximum(size, 1)[:, None]
    pre = prefix(buf)
    ws, we, wf = runs(buf, offs, _IS_WORD)
    ls, le, lf = runs(buf, offs, _IS_LINE)
    words, lines = np.diff(wf), np.diff(lf)
    w_doc, l_doc = np.repeat(np.arange(n), words), np.repeat(np.arange(n), lines)
    d_words, _ = _distinct(w_doc, span(pre, ws, we), n)
    d_lines, again = _distinct(l_doc, span(pre, ls, le), n)
    repeated = np.bincount(l_doc, np.where(again, le - ls, 0), n)
    longest = np.zeros(n)
    np.maximum.at(longest, w_doc, we - ws)
    marked = np.bincount(w_doc, _CLASS[buf[we - 1]] == 3, n)
    length = np.bincount(w_doc, we - ws, n) / np.maximum(words, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), length,
        share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6], share[:, 7],
        d_words / np.maximum(words, 1), d_lines / np.maximum(lines, 1), repeated / np.maximum(size, 1),
        np.log1p(longest), marked / np.maximum(words, 1)]).astype(np.float64)


def with_statistics(docs: DataFrame) -> DataFrame:
    def step(batches):
        for b in text_steps(batches):
            x = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])
                 .cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.mapInArrow(step, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Kernel:
    """Random Fourier features of standardised statistics."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, width: float, size: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(0, 1 / width, (len(mean), size))
        self.b = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b)
        return np.column_stack([z, np.ones(len(z))])


def normal_equations(labelled: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, int]:
    """``Z'Z``, ``Z'y`` and the number of rows of ``labelled(x, y)``: summed per task,
    then entry by entry over the tasks."""
    d = len(kernel.b) + 1

    def step(batches):
        zz, zy, n = np.zeros((d, d)), np.zeros(d), 0
        for b in batches:
            z, y = kernel(_matrix(b.column("x"))), b.column("y").to_numpy(zero_copy_only=False)
            zz += z.T @ z
            zy += z.T @ y
            n += len(y)
        if n:
            rows = np.column_stack([zz, zy, np.full(d, n)])
            yield pa.RecordBatch.from_arrays(
                [longs(range(d)), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), d + 2)
                 .cast(pa.list_(pa.float64()))], ["i", "row"])

    sums = labelled.mapInArrow(step, "i long, row array<double>") \
        .select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((d, d + 2))
    for r in sums.collect():  # (D + 1) (D + 3) numbers, whatever the data
        total[r["i"], r["j"]] = r["v"]
    return total[:, :d], total[:, d], int(round(total[0, d + 1]))


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block mean scores and the rising block means of the label."""
    blocks: list[list[float]] = []
    for s, y, w in zip(score, label, weight):
        blocks.append([s * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


class Classifier:
    def __init__(self, kernel: Kernel | None, w: np.ndarray | None, at: np.ndarray, level: np.ndarray):
        self.kernel, self.w, self.at, self.level = kernel, w, at, level

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.w if self.kernel else np.zeros(len(x))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.level), 0, 1)


def learnable(doc_id: Column) -> Column:
    """Rows that learning may use: crc32 of the key as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def train(measured: DataFrame, labels: DataFrame, size: int = FEATURES, ridge: float = RIDGE,
          width: float | None = None) -> Classifier:
    k = len(STATISTICS)
    spread = measured.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(k)
                            for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([spread[f"m{i}"] or 0.0 for i in range(k)])
    deviation = np.array([spread[f"s{i}"] or 0.0 for i in range(k)])
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")) \
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learnable(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    labelled = materialize(measured.join(known, "doc_id").select("x", "y"), "labelled")
    kernel = Kernel(mean, deviation, width or np.sqrt(k), size)
    zz, zy, n = normal_equations(labelled, kernel)
    if not n:
        return Classifier(None, None, np.zeros(1), np.full(1, 0.5))
    w = np.linalg.solve(zz + ridge * n * np.eye(len(zz)), zy)
    plain = Classifier(kernel, w, np.zeros(1), np.zeros(1))

    def bins(batches):
        for b in batches:
            s = plain.raw(_matrix(b.column("x")))
            at = np.clip(np.floor((s + 0.5) * (BINS / 2)), 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([longs(at), pa.array(s), b.column("y")], ["bin", "s", "y"])

    binned = labelled.mapInArrow(bins, "bin long, s double, y double").groupBy("bin") \
        .agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).collect()  # at most BINS rows
    rows = np.array(sorted((r["s"], r["y"], r["n"]) for r in binned))
    return Classifier(kernel, w, *isotonic(*rows.T))


def score(measured: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""

    def step(batches):
        for b in batches:
            s = model(_matrix(b.column("x"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             ["doc_id", "score", "predicted"])

    scored = measured.mapInArrow(step, "doc_id long, score double, predicted int")
    held = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    measured = materialize(with_statistics(pick(table(spark, sf_dir, "documents"))), "statistics")
    return score(measured, train(measured, table(spark, sf_dir, "labels")))
