"""Secret scans: base patterns, and character Markov models of random strings.

Base spans are the matches of fixed patterns (``assign``, ``access``, ``hex``).  Further
candidates are runs of 16 or more key characters that overlap no base span; a candidate
is a secret (``random``) when its mean log-likelihood ratio per transition under two
first-order character models, random strings against ordinary identifiers, exceeds
``THRESHOLD``.

Both models are trained from labelled samples: the base spans of at most ``SAMPLE_DOCS``
documents that have some are random strings, all other runs of key characters in at most
``SAMPLE_DOCS`` documents are ordinary identifiers (both chosen by a hash of the key, a
documented bound, whole texts).  Transition counts come from a Spark aggregation of at
most ``2 * SYMBOLS^2`` rows and are smoothed towards the uniform distribution, so without
any labelled secret a random string is a uniform one.

Built-in functions only; each row is scanned by itself, without a shuffle.  Null and
empty texts have no spans.  Positions are code points, the end is exclusive.  Rows that
repeat a key give a row each.  Long match lists are placed by two-level prefix sums, so
a text with very many matches stays far from quadratic.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, table

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a maximal run, so the same as AKIA[A-Z0-9]+ of 18 or more characters
HEX = r"[0-9a-f]{16,}"  # likewise
ASSIGN_LEAST = 12
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{3,}"
KINDS = ("assign", "access", "hex", "random")

FIRST, SYMBOLS = 43, 80  # '+' .. 'z'
ALPHABET = [c - FIRST for c in (*b"+-/=_", *range(48, 58), *range(65, 91), *range(97, 123))]
SAMPLE_DOCS = 1000
SMOOTH = 20.0
THRESHOLD = 0.7


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def running(lengths: Column) -> Column:
    """Inclusive prefix sums of an array of longs, in chunks of about its square root."""
    def chunked(x: Column) -> Column:
        step, chunks = x["step"], x["chunks"]
        return F.transform(x["n"], lambda _, i: let(
            F.floor(i / step), lambda c: chunks[c.cast("int")]
            + _sum(F.slice(x["n"], (c * step + 1).cast("int"), (i - c * step + 1).cast("int")))))

    def sums(x: Column) -> Column:
        count = F.ceil(F.size(x["n"]) / x["step"])
        each = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)).cast("int")),
                           lambda c: _sum(F.slice(x["n"], c * x["step"] + 1, x["step"])))
        before = let(each, lambda e: F.transform(e, lambda _, c: F.when(c == 0, F.lit(0).cast("long"))
                                                 .otherwise(_sum(F.slice(e, F.lit(1), c)))))
        return F.struct(x["n"].alias("n"), x["step"].alias("step"), before.alias("chunks"))

    step = F.greatest(F.ceil(F.sqrt(F.size(lengths))), F.lit(1)).cast("int")
    return let(F.struct(lengths.alias("n"), step.alias("step")), lambda x: let(sums(x), chunked))


def spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """The matches of ``pattern`` whose ``group`` has ``least`` characters, as
    ``array<struct<start, order, end, match>>``: leftmost, not overlapping."""
    rx = F.lit(pattern)
    parts = F.struct(F.regexp_extract_all(text, rx, F.lit(0)).alias("m"),
                     F.regexp_extract_all(text, rx, F.lit(group)).alias("g"),
                     F.split(text, pattern, -1).alias("p"))

    def placed(x: Column) -> Column:
        lengths = F.transform(x["m"], lambda m, i: (F.length(x["p"][i]) + F.length(m)).cast("long"))
        return let(running(lengths), lambda ends: F.filter(
            F.transform(x["m"], lambda m, i: F.struct(
                (ends[i] - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("order"), ends[i].alias("end"),
                m.alias("match"), F.length(x["g"][i]).alias("size"))),
            lambda s: s["size"] >= least))

    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,match:string,size:int>>")
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    return {"assign": spans(text, "assign", ASSIGN, 2, ASSIGN_LEAST), "access": spans(text, "access", ACCESS),
            "hex": spans(text, "hex", HEX)}


def sample_of(docs: DataFrame, size: int, seed: int, some: Column | None = None) -> DataFrame:
    """At most ``size`` keys, by a hash, among the rows with ``some``, with one of their
    texts each.  Only keys are ordered; texts come by a join with the bounded list."""
    keys = (docs if some is None else docs.where(some)).where(F.col("doc_id").isNotNull()) \
        .select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(size)
    return docs.join(F.broadcast(keys), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))


def labelled_samples(docs: DataFrame, size: int = SAMPLE_DOCS) -> DataFrame:
    """``random, string``: strings labelled as random or as ordinary identifiers."""
    some = F.col("text").rlike("|".join((ASSIGN.replace("(?i)", "(?i:") + ")", ACCESS, HEX)))
    with_base, others = sample_of(docs, size, 1, some), sample_of(docs, size, 2)
    values = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)),
                      F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
                      F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = F.regexp_extract_all(plain, F.lit(ORDINARY), F.lit(0))
    return with_base.select(F.lit(True).alias("random"), F.explode(values).alias("string")) \
        .where(F.length("string") >= ASSIGN_LEAST) \
        .unionByName(others.select(F.lit(False).alias("random"), F.explode(ordinary).alias("string")))


def _codes(string: Column) -> Column:
    return F.transform(F.split(string, "", -1), lambda c: F.ascii(c) - FIRST)


def train(samples: DataFrame, smooth: float = SMOOTH) -> list[float]:
    """``log P(b | a, random) - log P(b | a, ordinary)`` at ``a * SYMBOLS + b``."""
    codes = samples.select("random", _codes(F.regexp_replace("string", "[^A-Za-z0-9+/_=-]", "")).alias("c"))
    pairs = codes.select("random", F.explode(F.expr("zip_with(slice(c, 1, greatest(size(c) - 1, 0)), slice(c, 2, size(c)), "
                                                    f"(a, b) -> a * {SYMBOLS} + b)")).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in
              pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    ratio = [0.0] * (SYMBOLS * SYMBOLS)
    for a in ALPHABET:
        row = {k: [counts.get((k, a * SYMBOLS + b), 0) for b in ALPHABET] for k in (True, False)}
        for i, b in enumerate(ALPHABET):
            like = [math.log((row[k][i] + smooth / len(ALPHABET)) / (sum(row[k]) + smooth)) for k in (True, False)]
            ratio[a * SYMBOLS + b] = like[0] - like[1]
    return ratio


def mean_ratio(string: Column, ratio: list[float]) -> Column:
    """Mean log-likelihood ratio over the transitions of a string of key characters."""
    weights = F.split(F.lit(",".join(f"{x:.6g}" for x in ratio)), ",").cast("array<double>")
    return let(_codes(string), lambda c: F.aggregate(
        F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)),
                   lambda a, b: weights[a * SYMBOLS + b]),
        F.lit(0.0), lambda s, x: s + x) / (F.size(c) - 1))


def scan(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the base spans of each kind and ``random``, the spans the models add."""
    text = F.col("text")
    base = docs.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(text).items()])
    taken = F.concat("assign", "access", "hex")
    candidates = spans(text, "random", CANDIDATE)
    added = F.filter(candidates, lambda c: (mean_ratio(c["match"], ratio) > threshold)
                     & ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return base.select("doc_id", "assign", "access", "hex", added.alias("random"))


def written(found: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(
        ":", names[s["order"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    docs = pick(docs)
    return scan(docs, train(labelled_samples(docs)), threshold)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.concat(base, "random")).alias("spans"))
