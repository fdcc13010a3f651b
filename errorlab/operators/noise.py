"""Learned corruption: edit operations estimated from real pairs of a
word and its misspelling, and misspellings drawn from them.

Estimation.  A pair may have several minimal alignments; each operation counts with the
share of them that contain it (dynamic programming over the tight edges of the edit
graph, both ways).  Counts are whole millionths, so sums do not depend on the order of
rows.  Operations are conditioned on the character they happen at: ``replace`` and
``delete`` on the one that changes, ``insert`` on the one before (``^`` at the start).

Drawing.  A place in the word is drawn by the error rates of its characters, then an
operation by the counts of that character; draws are hashes of the row's keys.  The model
has a row per (character, operation, character) that occurs, bounded by the alphabet, and
goes to the tasks as one table.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

MILLION = 1_000_000
START = "^"
#: Cost of an operation that the model has never seen.
UNSEEN = -math.log(1e-6)
#: Words, and pairs of words, that a task remembers at most.
REMEMBERED = 200_000


def expected_operations(word: str, error: str) -> Counter:
    """``(op, from, to)`` -> share of the minimal alignments of the two strings with that
    operation (summed over places); ``match`` included."""
    n, m = len(word), len(error)
    band = max(abs(n - m), 2)
    while True:  # alignments of cost <= band stay within the band around the diagonal
        dist, ways = _forward(word, error, band)
        if dist[n, m] <= band:
            break
        band *= 2
    ahead, out = Counter({(n, m): 1}), Counter()  # completions along tight edges
    for i in range(n, -1, -1):
        for j in range(min(m, i + band), max(0, i - band) - 1, -1):
            if ahead[i, j]:
                for cell, cost, op in _edges(word, error, i, j):
                    if cell in dist and dist[cell] + cost == dist[i, j]:
                        ahead[cell] += ahead[i, j]
                        out[op] += ways[cell] * ahead[i, j] / ways[n, m]
    return out


def _edges(word: str, error: str, i: int, j: int):
    """Steps into cell (i, j): the cell before, cost, operation."""
    if i:
        yield (i - 1, j), 1, ("delete", word[i - 1], "")
    if j:
        yield (i, j - 1), 1, ("insert", word[i - 1] if i else START, error[j - 1])
    if i and j:
        same = word[i - 1] == error[j - 1]
        yield (i - 1, j - 1), 0 if same else 1, ("match" if same else "replace", word[i - 1], error[j - 1])


def _forward(word: str, error: str, band: int) -> tuple[dict, dict]:
    """Distance to each cell of the band, and the number of minimal alignments up to it."""
    dist, ways = {(0, 0): 0}, {(0, 0): 1}
    for i in range(len(word) + 1):
        for j in range(max(0, i - band), min(len(error), i + band) + 1):
            if i or j:
                steps = [(dist[cell] + cost, ways[cell]) for cell, cost, _ in _edges(word, error, i, j) if cell in dist]
                dist[i, j] = min(d for d, _ in steps)
                ways[i, j] = sum(w for d, w in steps if d == dist[i, j])
    return dist, ways


def estimate(pairs: DataFrame, correct: str = "correct", error: str = "error", weight: str | None = None) -> DataFrame:
    """``(op, from_ch, to_ch, n)``: expected counts in millionths; pairs that repeat are
    aligned once."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    distinct = pairs.groupBy(F.col(correct).alias("a"), F.col(error).alias("b")).agg(w.cast("long").alias("w"))

    def step(batches):
        for b in batches:
            held: Counter = Counter()
            for word, wrong, n in zip(*(c.to_pylist() for c in b.columns)):
                for op, share in expected_operations(word, wrong).items():
                    held[op] += n * round(share * MILLION)
            if held:
                ops, n = zip(*held.items())
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in zip(*ops)), pa.array(n, pa.int64())],
                                                 ["op", "from_ch", "to_ch", "n"])

    return distinct.filter(F.col("a").isNotNull() & F.col("b").isNotNull()) \
        .mapInArrow(step, "op string, from_ch string, to_ch string, n long") \
        .groupBy("op", "from_ch", "to_ch").agg(F.sum("n").alias("n"))


class EditModel:
    """The estimated operations, ready for draws and costs."""

    def __init__(self, rows: Sequence[tuple[str, str, str, int]]):
        edits: dict[str, Counter] = {"": Counter()}
        seen: Counter = Counter()
        for op, c, to, n in rows:
            if op != "insert":
                seen[c] += n
            if op != "match":
                edits.setdefault(c, Counter())[op, to] += n
                edits[""][op, to] += n  # any character: for those that the pairs do not have
        seen[START] = sum(seen.values())  # no better count of starts: their rate stays low
        seen[""] = sum(seen.values())
        #: Per character the operations in order, their running counts, and the error rate.
        self.table = {c: (ops := sorted(e), list(accumulate(e[o] for o in ops))) for c, e in edits.items() if e}
        self.rate = {c: max(1, sums[-1] * MILLION // max(seen[c], 1)) for c, (_, sums) in self.table.items()}
        self.cost = {(op, c, to): -math.log(n / seen[c]) for c, e in edits.items() if c
                     for (op, to), n in e.items() if 0 < n <= seen[c]}
        self._words: dict = {}  # what a task has worked out: rates of a word, distance of a pair
        self._pairs: dict = {}

    @classmethod
    def collected(cls, model: DataFrame) -> EditModel:
        rows = model.select("op", "from_ch", "to_ch", "n").filter(F.col("n") > 0).collect()  # bounded by the alphabet
        return cls([tuple(r) for r in rows])

    @staticmethod
    def _held(memory: dict, key, made):
        """``made(key)``, remembered; at most ``REMEMBERED`` answers are kept."""
        if (found := memory.get(key)) is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            found = memory[key] = made(key)
        return found

    def _places(self, word: str) -> tuple[list[str], list[int]]:
        """The table's keys of the word's places, and the running sums of their error rates."""
        places = [c if c in self.table else "" for c in START + word]
        rates = [self.rate[c] for c in places]
        if START not in self.table:
            rates[0] = 0
        return places, list(accumulate(rates))

    def corrupt(self, word: str, key: str, n: int, seed: int) -> str:
        """``word`` after ``n`` drawn operations; its last character is never deleted."""
        for step in range(n if self.table else 0):
            u, v = (int(hashlib.md5(f"{seed}|{salt}|{key}|{step}".encode()).hexdigest()[:8], 16)
                    for salt in ("noise:place", "noise:edit"))
            places, sums = self._held(self._words, word, self._places)
            if not sums[-1]:
                return word
            at = bisect_right(sums, u % sums[-1])
            ops, counts = self.table[places[at]]
            op, to = ops[bisect_right(counts, v % counts[-1])]
            if op == "insert":  # behind the place; all that happens at the start is an insertion
                word = word[:at] + to + word[at:]
            elif op == "replace":
                word = word[:at - 1] + to + word[at:]
            elif len(word) > 1:
                word = word[:at - 1] + word[at:]
        return word

    def distance(self, word: str, error: str) -> float:
        """Least cost (negative log probability) of turning ``word`` into ``error``."""
        return self._held(self._pairs, (word, error), self._distance)

    def _distance(self, pair: tuple[str, str]) -> float:
        word, error = pair
        cost, last = self.cost, None
        for i in range(len(word) + 1):
            row = []
            for j in range(len(error) + 1):
                c = word[i - 1] if i else START
                if not i and not j:
                    best = 0.0
                else:
                    best = math.inf
                    if i:
                        best = last[j] + cost.get(("delete", c, ""), UNSEEN)
                    if j:
                        best = min(best, row[j - 1] + cost.get(("insert", c, error[j - 1]), UNSEEN))
                    if i and j:
                        step = 0.0 if c == error[j - 1] else cost.get(("replace", c, error[j - 1]), UNSEEN)
                        best = min(best, last[j - 1] + step)
                row.append(best)
            last = row
        return last[-1]


def corrupt(df: DataFrame, model: DataFrame, key_cols: Sequence[str], token_col: str = "token", out: str = "corrupted",
            n: int = 1, seed: int = 17, cost_out: str = "cost") -> DataFrame:
    """``df`` with ``out``, the token after ``n`` operations drawn by the row's keys, and
    ``cost_out``, the weighted edit distance between the two.  Null tokens stay null."""
    shared = df.sparkSession.sparkContext.broadcast(EditModel.collected(model))
    schema = StructType(df.schema.fields + [StructField(out, StringType()), StructField(cost_out, DoubleType())])
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]).alias("_key")

    def step(batches):
        edits = shared.value
        for b in batches:
            words, keys = b.column(schema.names.index(token_col)).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            wrong = [None if w is None else edits.corrupt(w, k, n, seed) for w, k in zip(words, keys)]
            costs = [None if w is None else edits.distance(w, x) for w, x in zip(words, wrong)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(wrong, pa.string()), pa.array(costs, pa.float64())],
                                             schema.names)

    return df.select("*", key).mapInArrow(step, schema)
