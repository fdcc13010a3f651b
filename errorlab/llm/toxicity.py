"""Toxicity: bags of character n-gram embeddings averaged into a linear softmax.

Every word of the lower-cased text, with a blank on either side, gives its character
(byte) n-grams of 3 to 5; each n-gram is hashed to one of ``BUCKETS`` embeddings.  A
text is a row of overlapping windows of ``WINDOW`` bytes; a window's vector is the mean
of its n-gram embeddings (shorter windows are filled up with neutral ones) and a linear
softmax on it scores the window.  A text scores as its highest window, so that one
insult in a very long text counts.  Embeddings and softmax are learned jointly by Adam
in numpy from labelled texts: in every epoch the highest window of each text takes the
text's label.  Only buckets whose share among label 1 differs clearly from that among
label 0 are learned, the others stay neutral.  A misspelt word shares most of its
n-grams with the word it stands for, so it lands near it without having been seen.

Learning uses at most ``max_docs`` labelled texts and ``max_bytes`` of their bytes,
chosen by a hash of the key (a documented bound; whole texts only).  Scoring is linear
below the maximum: the learned model folds into one number per bucket, and every text
is scored whole, in vectorised steps, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, table, text_steps, utf8
from .hashing import mix

BUCKETS = 1 << 17
ORDERS = (3, 4, 5)
BLANK = 32
WINDOW, STRIDE = 96, 48
#: n-grams that a full window has, about; shorter windows divide by it as well.
FILL = 160
THRESHOLD = 0.7

_BITS = BUCKETS.bit_length() - 1
_SYMBOL = np.full(256, BLANK, np.uint8)
_SYMBOL[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
_TABLES = (mix(np.arange(max(ORDERS) * 256, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)) \
    .astype(np.uint32).reshape(max(ORDERS), 256)


def symbols(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a blank for every other symbol and one at either end of
    each text, and the ``n + 1`` offsets of the texts."""
    padded = pc.binary_join_element_wise("", pc.utf8_lower(arr.cast(pa.string())), "", " ")
    buf, offs = utf8(padded)
    return _SYMBOL[buf], offs


def ngrams(b: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the start positions and buckets of its n-grams."""
    blank = b == BLANK
    n = len(b)
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    h = np.zeros(n, np.uint32)
    inner = np.zeros(n, bool)
    for k in range(min(max(ORDERS), n)):
        m = n - k
        h = h[:m] + _TABLES[k][b[k:]]
        if k >= 2:
            inner = inner[:m] | blank[k - 1:n - 1]
        if k + 1 in ORDERS:
            at = np.flatnonzero(~inner[:m] & (doc[:m] == doc[k:]))
            yield at, ((h[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)).astype(np.int32)


def windows(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the windows: every half window, one at least per text."""
    sizes = np.diff(offs)
    count = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(sizes)), count)
    start = offs[doc] + (np.arange(first[-1]) - first[doc]) * STRIDE
    return start, np.minimum(start + WINDOW, offs[doc + 1]), first


@dataclass
class Model:
    """``push`` is what an n-gram of a bucket adds to the logit of its window."""

    push: np.ndarray
    bias: float

    def scores(self, arr: pa.Array) -> np.ndarray:
        if len(arr) == 0:
            return np.zeros(0)
        b, offs = symbols(arr)
        at_byte = np.zeros(len(b) + 1)
        for at, bucket in ngrams(b, offs):
            at_byte[at + 1] += self.push[bucket]
        run = np.cumsum(at_byte)
        start, end, first = windows(offs)
        top = np.maximum.reduceat(run[end] - run[start], first[:-1])
        return 1 / (1 + np.exp(-np.clip(top + self.bias, -50, 50)))


def _telling(ids: list[np.ndarray], y: np.ndarray, keep: int, least: int, clear: float) -> tuple[np.ndarray, np.ndarray]:
    """Buckets whose share of texts differs most between the labels, and the log odds."""
    seen = [np.bincount(np.concatenate([ids[i] for i in np.flatnonzero(y == k)]), minlength=BUCKETS) for k in (0, 1)]
    odds = [np.log((s + 0.5) / (n - s + 0.5)) for s, n in zip(seen, np.bincount(y, minlength=2))]
    spread = sum(1 / (s + 0.5) + 1 / (n - s + 0.5) for s, n in zip(seen, np.bincount(y, minlength=2)))
    z = (odds[1] - odds[0]) / np.sqrt(spread)
    z[seen[0] + seen[1] < least] = 0
    top = np.argsort(-np.abs(z), kind="stable")[:keep]
    top = np.sort(top[np.abs(z[top]) >= clear])
    return top, (odds[1] - odds[0])[top]


def fit(texts: list[str], labels: list[int], dim: int = 8, epochs: int = 150, rate: float = 0.3,
        keep: int = 4096, least: int = 3, clear: float = 3.0, decay: float = 1e-4, noise: float = 0.05,
        seed: int = 7) -> Model:
    """Train embeddings and softmax together.  Without both labels present every text
    gets the share of label 1 (one half when there is no text)."""
    y = np.asarray(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    sizes, seen = [], []
    for t in texts:
        b, offs = symbols(pa.array([t], pa.string()))
        sizes.append(len(b))
        seen.append(np.unique(np.concatenate([x[1] for x in ngrams(b, offs)] or [np.zeros(0, np.int32)])))
    learned, odds = _telling(seen, y, keep, least, clear)
    if not len(learned):
        p = y.mean()
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    slot = np.full(BUCKETS, -1, np.int64)
    slot[learned] = np.arange(len(learned))
    # The windows' learned n-grams, as (window, slot) pairs; a position is in up to two windows.
    offs = np.concatenate([[0], np.cumsum(sizes)])
    start, end, first = windows(offs)
    pos, sl = [], []
    for t, o in zip(texts, offs):
        for at, bucket in ngrams(*symbols(pa.array([t], pa.string()))):
            found = slot[bucket]
            pos.append(at[found >= 0] + o)
            sl.append(found[found >= 0])
    pos, sl = np.concatenate(pos), np.concatenate(sl)
    last = np.searchsorted(start, pos, "right") - 1
    win, row = [], []
    for back in range(WINDOW // STRIDE):
        w = last - back
        ok = (w >= 0) & (pos < end[w]) & (pos >= start[w])
        win.append(w[ok])
        row.append(sl[ok])
    win, row = np.concatenate(win), np.concatenate(row)
    order = np.argsort(win, kind="stable")
    win, row = win[order], row[order]
    n_win, n_doc = len(start), len(y)
    doc_of = np.repeat(np.arange(n_doc), np.diff(first))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (len(learned), dim))
    emb[:, 0] = odds
    out = rng.normal(0, 0.05, (dim, 2))
    out[0] = [-2, 2]
    bias = np.log(np.bincount(y, minlength=2) / n_doc)
    params, moments = [emb, out, bias], [[np.zeros_like(x), np.zeros_like(x)] for x in (emb, out, bias)]
    for step in range(1, epochs + 1):
        push = emb @ (out[:, 1] - out[:, 0]) / FILL
        logit = np.bincount(win, push[row], n_win)
        best = np.lexsort((logit, doc_of))[first[1:] - 1]
        where = np.full(n_win, -1)
        where[best] = np.arange(n_doc)
        mine = where[win]
        d, r = mine[mine >= 0], row[mine >= 0]
        mean = np.stack([np.bincount(d, emb[r, k], n_doc) for k in range(dim)], 1) / FILL
        z = mean @ out + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        # A share ``noise`` of clean texts bears label 1: P(1) = noise + (1 - noise) p.
        pull = np.where(y == 1, -(1 - noise) * p[:, 1] * p[:, 0] / (noise + (1 - noise) * p[:, 1]), p[:, 1])
        p = np.stack([-pull, pull], 1)
        back = p @ out.T / FILL
        grads = [np.stack([np.bincount(r, back[d, k], len(learned)) for k in range(dim)], 1) / n_doc + decay * emb,
                 mean.T @ p / n_doc, p.mean(0)]
        for x, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    push = np.zeros(BUCKETS, np.float32)
    push[learned] = emb @ (out[:, 1] - out[:, 0]) / FILL
    return Model(push, float(bias[1] - bias[0]))


def learnable(doc_id: Column) -> Column:
    """Rows that learning may use: crc32 of the key as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_bytes: int = 12 << 20) -> Model:
    """Fit on a bounded sample of the labelled rows that learning may use.

    Rows with a null key, text or label teach nothing; a key labelled twice counts as
    toxic if one of its labels does.  No labels: every text scores one half.
    """
    rows = labelled_sample(docs, labels, "toxic", learnable, max_docs, max_bytes)
    return fit([t for t, _ in rows], [k for _, k in rows])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, repeated rows
    included; null and empty texts score as texts without n-grams.  A null key is not
    held out."""
    def step(batches):
        for b in text_steps(batches):
            s = model.scores(pc.fill_null(b.column("text"), ""))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")) \
        .mapInArrow(step, "doc_id long, score double, predicted int")
    held = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""
    def step(batches):
        for b in text_steps(batches):
            s = model.scores(pc.fill_null(b.column(b.schema.get_field_index("text")), ""))
            yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(step, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
