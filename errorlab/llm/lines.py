"""Line dedup: a segment-partition edit join over the distinct lines of all documents.

Lines are what stands between line feeds, of one or more characters (code points).  Two
different lines are linked when their edit distance is at most ``TAU = 2`` and at most
half the length of the longer one, which limits lines of up to three characters.

1. A line is split into ``TAU + 1`` segments of nearly equal length.  Two edits leave one
   of them untouched, so a linked line of equal or greater length holds it at a
   position shifted by as much as the edits before it allow.  Each distinct line enters
   its segments into the index, under its length, the segment's number and its hash, and
   probes the indexes of the lengths ``n - TAU .. n`` with its substrings at the positions
   that can matter.  Empty segments, of lines of one or two characters, are left out: a
   link within the bound leaves another one untouched.  Index and probes meet by the hash, in as many tasks as a shuffle has
   parts.  Entries and probes carry their line's marks, the parities of its characters and
   of its pairs of neighbours.  An edit flips at most two of the former and four of the
   latter, so two lines that differ in more marks than ``TAU`` edits explain have no link,
   and a frequent segment sends few candidate pairs on to the texts.
2. Candidates are verified on their texts: an automaton of ``TAU + 1`` bitmaps over the
   ``2 TAU + 1`` diagonals of the band consumes the lines, many pairs at a time.
3. A line is *equal* when the same line stands earlier (by key, then line number), and
   *near* when it is linked with a line whose first occurrence is earlier than its own.

Copies of a line are one entry, so a line that a third of all documents hold costs one.
Null and empty texts have no lines.  Rows without a key are left alone; rows that repeat
a key count as one document per row in the report, their equal lines as one occurrence.
Lines are told apart by 64-bit hashes.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs, materialize, pick, table, text_steps
from .hashing import bounds, inverses, mix, prefix, span

TAU = 2
LEAST = 1
FLUSH = 2_000_000
PAIRS = 1 << 20


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, and the ``n + 1`` offsets."""
    buf = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return buf, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def lines_of(buf: np.ndarray, offs: np.ndarray):
    """Start, end, text and number of each line of ``LEAST`` or more characters."""
    feed = buf == 10
    start, end, first = bounds(~feed, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    before = np.concatenate([[0], np.cumsum(feed)])
    number = before[start] - before[offs[doc]]
    ok = end - start >= LEAST
    return start[ok], end[ok], doc[ok], number[ok]


def marks(buf: np.ndarray, offs: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each line, which of 32 classes of characters (low bits) and 32 classes of
    neighbours (high bits; a line feed follows the last character) occur an odd number of
    times."""
    after = np.append(buf[1:], np.uint32(10))
    after[offs[1:][offs[1:] > 0] - 1] = 10
    single = (buf * np.uint32(0x9E3779B1)) >> np.uint32(27)
    double = ((buf * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(27)
    bits = (np.uint64(1) << single.astype(np.uint64)) | (np.uint64(1 << 32) << double.astype(np.uint64))
    run = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bits)])
    return run[end] ^ run[start]


def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``TAU`` edits can explain the difference of two marks."""
    differ = a ^ b
    return (np.bitwise_count(differ & np.uint64(0xFFFFFFFF)) <= 2 * TAU) \
        & (np.bitwise_count(differ >> np.uint64(32)) <= 4 * TAU)


def segment(length: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and size of segment ``i``; the last ones take what is left over."""
    size, more = length // (TAU + 1), length % (TAU + 1)
    short = TAU + 1 - more
    return i * size + np.maximum(0, i - short), size + (i >= short)


def entries(pre: np.ndarray, start: np.ndarray, end: np.ndarray, line: np.ndarray, mark: np.ndarray):
    """Keys, lines and marks of all index entries (lowest bit 0) and probes (lowest bit 1)."""
    length, inv = end - start, inverses(pre)
    keys, lines, seen = [], [], []

    def add(at, size, indexed, i, role, ok):
        k = mix(span(pre, at[ok], (at + size)[ok], inv) + mix((indexed[ok] * 4 + i).astype(np.uint64)))
        keys.append((k & ~np.uint64(1)) | np.uint64(role))
        lines.append(line[ok])
        seen.append(mark[ok])

    for i in range(TAU + 1):
        at, size = segment(length, i)
        add(start + at, size, length, i, 0, size > 0)
        for less in range(TAU + 1):
            indexed = length - less
            at, size = segment(indexed, i)
            few = indexed <= TAU  # with an empty segment the others are sought wherever edits can move them
            lo = np.where(few, at - TAU, np.maximum(at - i, at + less - (TAU - i)))
            hi = np.where(few, at + TAU, np.minimum(at + i, at + less + (TAU - i)))
            for step in range(2 * TAU + 1):
                p = lo + step
                ok = (p <= hi) & (p >= 0) & (p + size <= length) & (indexed >= LEAST) & (size > 0)
                if ok.any():
                    add(start + p, size, indexed, i, 1, ok)
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(seen)


def occurrences(docs: DataFrame) -> DataFrame:
    """``line, doc_id, number`` of every line."""

    def step(batches):
        for b in text_steps(batches):
            buf, offs = points(b.column("text").to_pylist())
            start, end, doc, number = lines_of(buf, offs)
            if len(start):
                yield pa.RecordBatch.from_arrays(
                    [longs(span(prefix(buf), start, end).view(np.int64)), b.column("doc_id").take(longs(doc)),
                     longs(number)], ["line", "doc_id", "number"])

    return docs.mapInArrow(step, "line long, doc_id long, number long")


def candidates(docs: DataFrame, parts: int) -> DataFrame:
    """``a < b``: hashes of lines that share a segment where two edits allow it, and whose
    marks do not rule a link out."""

    def step(batches):
        held, size = [], 0

        def flush():
            columns = [np.concatenate(c) for c in zip(*held)]
            owner = ((columns[0] >> np.uint64(1)) % np.uint64(parts)).astype(np.min_scalar_type(parts))
            order = np.argsort(owner, kind="stable")
            cut = np.searchsorted(owner[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [longs(full), *(pa.array([c[order[cut[p]:cut[p + 1]]].tobytes() for p in full], pa.binary())
                                for c in columns)], ["part", "keys", "lines", "marks"])

        for b in text_steps(batches):
            buf, offs = points(b.column("text").to_pylist())
            start, end, _, _ = lines_of(buf, offs)
            if not len(start):
                continue
            pre = prefix(buf)
            line, one = np.unique(span(pre, start, end), return_index=True)
            held.append(entries(pre, start[one], end[one], line, marks(buf, offs, start[one], end[one])))
            size += len(held[-1][0])
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def meet(batches):
        came: dict[str, list] = {"keys": [], "lines": [], "marks": []}
        for b in batches:
            for name, held in came.items():
                held += [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(name)]
        if not came["keys"]:
            return
        k, v, m = (np.concatenate(held) for held in came.values())
        came.clear()
        sides = []
        for role in (0, 1):
            mine = (k & np.uint64(1)) == role
            kk, vv, mm = k[mine] >> np.uint64(1), v[mine], m[mine]
            order = np.lexsort((vv, kk))
            kk, vv, mm = kk[order], vv[order], mm[order]
            new = np.ones(len(kk), bool)  # a line that several tasks have seen comes once
            new[1:] = (kk[1:] != kk[:-1]) | (vv[1:] != vv[:-1])
            sides.append((kk[new], vv[new], mm[new]))
        (ik, iv, im), (pk, pv, pm) = sides
        if not len(ik) or not len(pk):  # nothing to meet here
            return
        lo, hi = np.searchsorted(ik, pk, "left"), np.searchsorted(ik, pk, "right")
        n = hi - lo
        some = (n > 1) | ((n == 1) & (iv[np.minimum(lo, len(iv) - 1)] != pv))
        lo, n, pv, pm = lo[some], n[some], pv[some], pm[some]
        ends = np.cumsum(n)
        at = 0
        while at < len(n):  # bounded steps, whatever a segment's frequency
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            for a in range(0, int(n[at]) if upto == at + 1 else 1, PAIRS):
                if upto == at + 1:
                    right = np.arange(lo[at] + a, lo[at] + min(int(n[at]), a + PAIRS))
                    left = np.full(len(right), at)
                else:
                    m = n[at:upto]
                    left = np.repeat(np.arange(at, upto), m)
                    right = np.repeat(lo[at:upto], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                ok = may_link(pm[left], im[right])
                left, right = pv[left[ok]], iv[right[ok]]
                ok = left != right
                x, y = np.minimum(left, right)[ok].view(np.int64), np.maximum(left, right)[ok].view(np.int64)
                if len(x):
                    pair = np.unique(np.column_stack([x, y]), axis=0)
                    yield pa.RecordBatch.from_arrays([longs(pair[:, 0]), longs(pair[:, 1])], ["a", "b"])
            at = upto

    return docs.mapInArrow(step, "part long, keys binary, lines binary, marks binary").repartition(parts, "part") \
        .mapInArrow(meet, "a long, b long").distinct()


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most edits that link lines of lengths ``a`` and ``b``."""
    return np.minimum(TAU, np.maximum(a, b) // 2)


def within(a: list[np.ndarray], b: list[np.ndarray], tau: int = TAU) -> np.ndarray:
    """Edit distances of pairs of code point arrays; ``tau + 1`` stands for more.

    Bit ``d + tau`` of bitmap ``e`` says that, after ``j`` symbols of ``b``, position
    ``j + d`` of ``a`` is reached with ``e`` edits."""
    la, lb = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    out = np.full(len(a), tau + 1)
    if not len(a):
        return out
    fa, fb = np.concatenate(a + [np.zeros(1, np.uint32)]), np.concatenate(b + [np.zeros(1, np.uint32)])
    sa, sb = np.cumsum(la) - la, np.cumsum(lb) - lb
    band = np.uint32((1 << (2 * tau + 1)) - 1)
    live = np.flatnonzero(np.abs(la - lb) <= tau)
    reach = [np.full(len(live), sum(1 << (tau + d) for d in range(e + 1)), np.uint32) for e in range(tau + 1)]
    j = 0
    while len(live):
        done = lb[live] == j
        if done.any():
            goal = np.uint32(1) << (la[live] - lb[live] + tau).astype(np.uint32)
            for e in range(tau, -1, -1):
                out[live[done & ((reach[e] & goal) != 0)]] = e
        go = ~done & (reach[tau] != 0)
        if not go.all():
            live, reach = live[go], [r[go] for r in reach]
            if not len(live):
                break
        symbol = fb[sb[live] + j]
        match = np.zeros(len(live), np.uint32)
        for d in range(-tau, tau + 1):
            p = j + d
            ok = (p < la[live]) if p >= 0 else np.zeros(len(live), bool)
            same = ok & (fa[np.where(ok, sa[live] + p, 0)] == symbol)
            match |= same.astype(np.uint32) << np.uint32(d + tau)
        old, below = reach, None
        reach = []
        for e in range(tau + 1):
            r = old[e] & match
            if e:
                r = r | old[e - 1] | (old[e - 1] >> np.uint32(1)) | (below << np.uint32(1))
            below = r & band
            reach.append(below)
        j += 1
    return out


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``line, text`` for ``wanted(line, doc_id, number)``: one occurrence of each."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("number", "line")).alias("wanted"))

    def step(batches):
        for b in text_steps(batches):
            line, text = [], []
            for t, w in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                rows = t.split("\n")
                for x in w:
                    if x["number"] < len(rows):
                        line.append(x["line"])
                        text.append(rows[x["number"]])
            if line:
                yield pa.RecordBatch.from_arrays([longs(line), pa.array(text, pa.string())], ["line", "text"])

    made = docs.hint("merge").join(lists, "doc_id").mapInArrow(step, "line long, text string")
    return made.groupBy("line").agg(F.max("text").alias("text"))  # a key may have several rows


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, distance`` of the pairs within the bound of their lengths."""
    left, right = (texts.select(F.col("line").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "ta", "tb")

    def step(batches):
        for b in text_steps(batches, "ta"):
            a, c = ([np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in b.column(n).to_pylist()]
                    for n in ("ta", "tb"))
            edits = within(a, c).astype(np.int32)
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(edits)], ["a", "b", "distance"])
            yield out.filter(pa.array(edits <= bound(*(np.array([len(x) for x in s], np.int64) for s in (a, c)))))

    return both.mapInArrow(step, "a long, b long, distance int")


def edit_join(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences, first occurrences (``line, doc_id, number``) and links (``a, b,
    distance``) of the lines of ``docs``."""
    docs = pick(docs).where(F.col("doc_id").isNotNull())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = materialize(occurrences(docs), "lines")
    first = materialize(seen.groupBy("line").agg(F.min(F.struct("doc_id", "number")).alias("at"))
                        .select("line", "at.doc_id", "at.number"), "first-lines")
    pairs = materialize(candidates(docs, parts), "line-pairs")
    used = pairs.select(F.col("a").alias("line")).union(pairs.select("b")).distinct()
    texts = materialize(line_texts(docs, first.join(used, "line", "left_semi")), "line-texts")
    return seen, first, materialize(verified(pairs, texts), "line-links")


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_equal, n_near, n_links`` and ``gone``, the numbers
    of its equal and near lines in order.  ``n_links`` counts the links of the different
    lines whose first occurrence the document holds."""
    seen, first, links = edit_join(docs)
    at = first.select("line", F.struct("doc_id", "number").alias("at"))
    ends = links.join(at.select(F.col("line").alias("a"), F.col("at").alias("at_a")), "a") \
        .join(at.select(F.col("line").alias("b"), F.col("at").alias("at_b")), "b")
    sides = ends.select(F.col("a").alias("line"), (F.col("at_b") < F.col("at_a")).alias("near")) \
        .unionByName(ends.select(F.col("b").alias("line"), (F.col("at_a") < F.col("at_b")).alias("near")))
    linked = sides.groupBy("line").agg(F.max("near").alias("near"), F.count(F.lit(1)).alias("n"))
    facts = materialize(at.join(linked, "line", "left").select(
        "line", "at", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("n", F.lit(0)).alias("n")), "line-facts")
    here = F.struct(F.col("doc_id"), F.col("number"))
    told = seen.distinct().join(facts, "line").withColumn("equal", here != F.col("at")) \
        .groupBy("doc_id").agg(
            F.sum(F.col("equal").cast("long")).alias("n_equal"),
            F.sum((F.col("near") & ~F.col("equal")).cast("long")).alias("n_near"),
            F.sum(F.when(~F.col("equal"), F.col("n")).otherwise(0)).alias("n_links"),
            F.sort_array(F.collect_list(F.when(F.col("equal") | F.col("near"), F.col("number")))).alias("gone"))
    zero = F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(told, "doc_id", "left").select(
        "doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_equal", "n_near", "n_links")],
        F.coalesce("gone", F.array().cast("array<bigint>")).alias("gone"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, equal and near lines taken out of ``text``."""
    gone = report(docs.where(F.col("doc_id").isNotNull())).where(F.size("gone") > 0) \
        .groupBy("doc_id").agg(F.first("gone").alias("_gone")).withColumnRenamed("doc_id", "_key")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("_gone", i.cast("bigint"))), "\n")
    return docs.join(gone, F.col("doc_id") == F.col("_key"), "left") \
        .withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
