"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles (``hashing.shingles``): weight
``(1 + ln tf) * idf``.  Document frequencies are counted over all documents in a sketch
of ``SKETCH`` hashed counters (a count-min row); with ``share = df / N`` the damped
``idf = 1 + DAMP * ln(1 / share) / ln(N)`` lies between 1 and ``1 + DAMP``, so that
passages which many documents share count less, but copies in a large group stay alike.

1. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per document
   (per shingle and draw ``r, c ~ Gamma(2,1)``, ``beta ~ U(0,1)``; sample the shingle
   with the smallest ``c / exp(r (t - beta + 1))``, ``t = floor(ln w / r + beta)``).
   The variates come from one table of ``TABLE`` entries that the shingle's hash
   addresses anew for every draw.  Two documents share a sample with the probability of
   their weighted Jaccard similarity.
2. Documents with the same weighted set form a node, so copies are never expanded.
   Bands of ``ROWS`` samples are the buckets.
3. A pair counts as a link when its exact weighted Jaccard similarity reaches the
   threshold.  Two rounds of few pairs come first, so that a large group of near copies
   is one component early: in each bucket, then in the intersections of two neighbouring
   bands, one delegate of each component against up to ``PIVOTS`` of them.
4. Then every pair of nodes that share a band and are not in one component yet is compared,
   in the first band they share.  A bucket is dealt into blocks of about ``BLOCK`` nodes,
   a component with as many nodes there into blocks of its own, and each pair of blocks
   that can hold two components is one group of rows.  So the classes are the components
   of all links that share a band; the time for a bucket of texts that stay apart grows
   with the square of their number, the memory of a task does not.
5. The result names for each document the smallest key of its component.

Documents without words (null, empty) have no shingles and are never linked.  Rows with
a null key take part but cannot be a class id unless alone.  Rows that repeat a key have
one row each.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, longs, materialize, pick, row_id, table, text_steps
from .components import components
from .hashing import mix, shingles

SKETCH = 1 << 18
SLICE = 1 << 13
BANDS, ROWS = 10, 4
TABLE = 1 << 16
DAMP = 0.25
PIVOTS = 4
BLOCK = 64
THRESHOLD = 0.8

_rng = np.random.default_rng(2010)
_R = _rng.gamma(2.0, 1.0, TABLE).astype(np.float32)
_C = np.log(_rng.gamma(2.0, 1.0, TABLE)).astype(np.float32)
_BETA = _rng.random(TABLE).astype(np.float32)
_DRAW = mix(np.arange(1, 1 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)
_SHIFT = np.uint64(64 - (TABLE.bit_length() - 1))


def weighted_sets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, how often each occurs, and the
    ``n + 1`` offsets of the texts."""
    h, offs = shingles(arr)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    return h[at], tf, np.searchsorted(doc[at], np.arange(len(offs)))


def counter(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SKETCH - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per counter and their number, over all rows.  Every task sends its
    counters as ``SKETCH / SLICE`` blobs, which are added up slice by slice."""

    def count(batches):
        seen, n = np.zeros(SKETCH, np.int64), 0
        for b in text_steps(batches):
            h, _, offs = weighted_sets(b.column("text"))
            doc = np.repeat(np.arange(b.num_rows, dtype=np.int64), np.diff(offs))
            seen += np.bincount(np.unique(doc * SKETCH + counter(h)) % SKETCH, minlength=SKETCH)
            n += b.num_rows
        if n:
            parts = seen.reshape(-1, SLICE)
            yield pa.RecordBatch.from_arrays(
                [longs(range(len(parts))), longs([n] + [0] * (len(parts) - 1)),
                 pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "n", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for b in batches:
            for s, k, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                sums[s] = sums.get(s, 0) + np.frombuffer(c, np.int64)
                n[s] = n.get(s, 0) + k
        if sums:
            yield pa.RecordBatch.from_arrays(
                [longs(list(sums)), longs(list(n.values())),
                 pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "n", "counts"])

    schema = "slice long, n long, counts binary"
    rows = docs.mapInArrow(count, schema).repartition(8, "slice").mapInArrow(add, schema).collect()
    seen = np.zeros(SKETCH, np.int64)
    for r in rows:
        seen[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    return seen, sum(r["n"] for r in rows)


def idf_table(seen: np.ndarray, n: int) -> np.ndarray:
    share = np.maximum(seen, 1) / max(n, 1)
    damped = 1 + DAMP * np.log(1 / np.minimum(share, 1)) / np.log(max(n, 3))
    return np.minimum(damped, 1 + DAMP).astype(np.float32)


def sample(h: np.ndarray, weight: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The weighted samples: one row per text that has shingles, one column per draw."""
    first = offs[:-1][np.diff(offs) > 0]
    sizes = np.diff(offs)[np.diff(offs) > 0]
    out = np.empty((len(first), len(_DRAW)), np.uint64)
    log_w = np.log(weight).astype(np.float32)
    for k, odd in enumerate(_DRAW):
        at = (h * odd) >> _SHIFT
        r, beta = _R[at], _BETA[at]
        t = np.floor(log_w / r + beta)
        a = _C[at] - r * (t - beta + 1)
        best = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), sizes))
        won = best[np.searchsorted(best, first)]
        out[:, k] = mix(h[won] + t[won].astype(np.int64).astype(np.uint64) * odd)
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    keys = samples.reshape(len(samples), BANDS, ROWS)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.ones((len(samples), 1), np.uint64)
    for j in range(ROWS):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + keys[:, :, j])
    return acc


def set_hash(h: np.ndarray, tf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of the whole weighted set of each text (0 for an empty one)."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + mix(tf.astype(np.uint64))))])
    return np.where(np.diff(offs) > 0, mix(run[offs[1:]] - run[offs[:-1]]), np.uint64(0))


def signatures(docs: DataFrame, idf) -> DataFrame:
    """``doc_id, node, keys``: the node is the hash of the weighted set."""

    def step(batches):
        for b in text_steps(batches):
            h, tf, offs = weighted_sets(b.column("text"))
            full = np.diff(offs) > 0
            keys = np.zeros((b.num_rows, BANDS), np.uint64)
            if full.any():
                weight = (1 + np.log(tf)) * idf.value[counter(h)]
                keys[full] = bands(sample(h, weight, offs))
            flat = pa.FixedSizeListArray.from_arrays(longs(keys.ravel().view(np.int64)), BANDS).cast(
                pa.list_(pa.int64()))
            node = pa.array(set_hash(h, tf, offs).view(np.int64), mask=~full)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), node, flat], ["doc_id", "node", "keys"])

    return docs.mapInArrow(step, "doc_id long, node long, keys array<long>")


def row_nodes(docs: DataFrame) -> DataFrame:
    """``id, doc_id, node`` of every row (see ``common.row_id``)."""

    def step(batches):
        for b in text_steps(batches):
            h, tf, offs = weighted_sets(b.column("text"))
            node = pa.array(set_hash(h, tf, offs).view(np.int64), mask=np.diff(offs) == 0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("doc_id"), node], ["id", "doc_id", "node"])

    return docs.select(row_id(F.col("doc_id"), F.xxhash64("text")).alias("id"), "doc_id", "text") \
        .mapInArrow(step, "id string, doc_id long, node long")


def vectors(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, shingles, times`` of the nodes in ``wanted(node, doc_id)``."""

    def step(batches):
        for b in text_steps(batches):
            h, tf, offs = weighted_sets(b.column("text"))
            parts = [(h[i:j].tobytes(), tf[i:j].astype(np.int32).tobytes()) for i, j in zip(offs, offs[1:])]
            yield pa.RecordBatch.from_arrays(
                [longs(set_hash(h, tf, offs).view(np.int64)), pa.array([p[0] for p in parts], pa.binary()),
                 pa.array([p[1] for p in parts], pa.binary())], ["node", "shingles", "times"])

    texts = docs.hint("merge").join(wanted.select("doc_id"), "doc_id", "left_semi")
    made = texts.mapInArrow(step, "node long, shingles binary, times binary")
    # A key with several texts brings more sets than asked for, a key with repeated rows the same one twice.
    return made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def verify(pairs: DataFrame, vecs: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose exact weighted Jaccard similarity reaches the threshold."""
    left, right = (vecs.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_s"), F.col("times").alias(f"{x}_t"))
                   for x in "ab")
    # Neither side has a bound, so neither is ever broadcast.
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")

    def step(batches):
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            like = np.array([similarity(*(np.frombuffer(col[c][i].as_buffer(), kind) for c, kind in
                                          (("a_s", np.uint64), ("a_t", np.int32), ("b_s", np.uint64), ("b_t", np.int32))),
                                        idf.value) for i in range(b.num_rows)])
            yield pa.RecordBatch.from_arrays([col["a"], col["b"], pa.array(like, pa.float64())], ["a", "b", "similarity"])

    return both.mapInArrow(step, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def similarity(ha, ta, hb, tb, idf: np.ndarray) -> float:
    wa, wb = (1 + np.log(ta)) * idf[counter(ha)], (1 + np.log(tb)) * idf[counter(hb)]
    return weighted_jaccard(ha, wa, hb, wb)


def weighted_jaccard(ha, wa, hb, wb) -> float:
    j = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    same = hb[j] == ha
    low = np.minimum(wa[same], wb[j[same]]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


def link_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id``: near-duplicate classes of all rows of ``docs``."""
    signed, nodes, known = node_components(pick(docs), threshold)
    classes = known.join(nodes.select("node", "doc_id"), "node") \
        .groupBy("component").agg(F.min("doc_id").alias("class_id")).join(known, "component").select("node", "class_id")
    named = nodes.select("node", "doc_id").join(classes, "node", "left") \
        .select("node", F.coalesce("class_id", "doc_id").alias("class_id"))
    return signed.select("doc_id", "node").join(named, "node", "left") \
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def node_components(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, the nodes, and ``node, component`` of those that share a
    bucket with another one."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(idf_table(*document_frequencies(docs)))
    signed = materialize(signatures(docs, idf), "signatures")
    nodes = signed.where(F.col("node").isNotNull()).groupBy("node") \
        .agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    member = nodes.select("node", "doc_id", F.explode("keys").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    member = materialize(member.join(shared, "bucket", "left_semi"), "buckets")
    held = materialize(nodes.join(member.select("node").distinct(), "node", "left_semi"), "held")
    vecs = materialize(vectors(docs, held.select("node", "doc_id")), "vectors")
    known = held.select("node", F.col("node").alias("component"))
    for rounds in (1, 2):
        # The second round looks into the intersections of two bands, where the closest texts meet.
        inner = member if rounds == 1 else held.select("node", F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(
                F.col("keys")[i], F.col("keys")[(i + 1) % BANDS]))).alias("bucket"))
        pairs = materialize(_delegates(inner.select("bucket", "node").join(known, "node"), rounds), "pairs")
        known = _merge(known, materialize(verify(pairs, vecs, idf, threshold), "found"))
    known = _merge(known, materialize(remaining_links(member, known, held, vecs, idf, threshold), "found"))
    return signed, nodes, known


def _delegates(member: DataFrame, turn: int) -> DataFrame:
    """Pairs ``a < b``: in each bucket the pivots, delegates of up to ``PIVOTS`` components
    (one in the first round), against one delegate of every other component."""
    lot = F.xxhash64("node", "bucket", F.lit(turn))
    one = member.groupBy("bucket", "component").agg(F.min(F.struct(lot.alias("lot"), "node")).alias("best"))
    turns = 1 if turn == 1 else PIVOTS
    pivot = one.groupBy("bucket", F.pmod(F.col("best.lot"), F.lit(turns)).alias("class")) \
        .agg(F.min("best").alias("pivot"))
    return one.hint("merge").join(pivot, "bucket").where(F.col("best.node") != F.col("pivot.node")) \
        .select(F.least("best.node", "pivot.node").alias("a"), F.greatest("best.node", "pivot.node").alias("b")) \
        .distinct()


def remaining_links(member: DataFrame, known: DataFrame, held: DataFrame, vecs: DataFrame, idf,
                    threshold: float) -> DataFrame:
    """Links ``a, b`` that join all components of ``known(node, component)`` which a pair
    of nodes in a bucket of ``member(bucket, node)`` links."""
    at = member.select("bucket", "node").join(known, "node")
    sizes = at.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("components"),
                                        F.sum(F.when(F.col("n") < BLOCK, F.col("n"))).alias("small")) \
        .where("components > 1").select("bucket", "small")
    own = F.col("n") >= BLOCK
    number = F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.when(own, F.col("n")).otherwise(F.col("small")) / BLOCK))
    # No side has a bound, so none is ever broadcast.
    placed = materialize(
        at.hint("merge").join(sizes.hint("merge").join(mixed, "bucket"), ["bucket", "component"])
        .select("bucket", "node", "component", F.struct(
            own.alias("own"), F.when(own, F.col("component")).otherwise(0).alias("of"), number.alias("number")).alias("block")),
        "blocks")
    blocks = placed.select("bucket", "block").distinct()
    met = blocks.withColumnRenamed("block", "l").hint("merge").join(blocks.withColumnRenamed("block", "r"), "bucket") \
        .where((F.col("l") <= F.col("r")) & ~(F.col("l.own") & F.col("r.own") & (F.col("l.of") == F.col("r.of"))))
    groups = met.select("bucket", F.struct("bucket", "l", "r").alias("group"),
                        F.explode(F.array_distinct(F.array("l", "r"))).alias("block"))
    rows = groups.hint("merge").join(placed, ["bucket", "block"]).select(
        F.to_json("group").alias("group"), (F.col("block") != F.col("group.l")).alias("right"),
        (F.col("group.l") == F.col("group.r")).alias("alone"), "bucket", "node", "component")
    full = vecs.hint("merge").join(held.select("node", "keys"), "node")
    rows = rows.hint("merge").join(full, "node").repartition("group").sortWithinPartitions("group")

    def step(batches):
        name, rest = None, []
        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in ("group", "right", "alone", "bucket", "node", "component",
                                                               "keys", "shingles", "times"))):
                if row[0] != name:
                    if rest:
                        yield links_of(rest, idf.value, threshold)
                    name, rest = row[0], []
                rest.append(row[1:])
        if rest:
            yield links_of(rest, idf.value, threshold)

    return rows.mapInArrow(step, "a long, b long")


def links_of(rows: list[tuple], idf: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Links between the two blocks of a group (or inside its only one) that join all
    components it links: ``right, alone, bucket, node, component, keys, shingles, times``."""
    right = np.array([r[0] for r in rows])
    keys = np.array([r[5] for r in rows], np.int64)
    h = [np.frombuffer(r[6], np.uint64) for r in rows]
    w = [(1 + np.log(np.frombuffer(r[7], np.int32))) * idf[counter(x)] for r, x in zip(rows, h)]
    total = np.array([x.sum() for x in w])
    band = int(np.argmax(keys[0] == rows[0][2]))
    top: dict[int, int] = {}

    def find(c):
        while top.get(c, c) != c:
            c = top[c]
        return c

    out = []
    for i in range(len(rows)):
        j = np.arange(i + 1, len(rows)) if rows[i][1] else np.flatnonzero(right & ~right[i])
        # The similarity is at most the ratio of the weights; an earlier band has compared the pair.
        like = np.minimum(total[j], total[i]) >= threshold * (1 - 1e-6) * np.maximum(total[j], total[i])
        for k in j[like & ~(keys[j, :band] == keys[i, :band]).any(1)]:
            a, b = find(rows[i][4]), find(rows[k][4])
            if a != b and weighted_jaccard(h[i], w[i], h[k], w[k]) >= threshold:
                top[a] = b
                out.append(sorted((rows[i][3], rows[k][3])))
    return pa.RecordBatch.from_arrays([longs([x[0] for x in out]), longs([x[1] for x in out])], ["a", "b"])


def _merge(known: DataFrame, found: DataFrame) -> DataFrame:
    """Components after the links of a round, contracted to the components before it."""
    at = known.withColumnRenamed("component", "c")
    links = found.join(at.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a") \
        .join(at.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b") \
        .select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a != b").distinct()
    label = components(links).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return materialize(known.join(label, "component", "left")
                       .select("node", F.coalesce("to", "component").alias("component")), "known")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Exactly one row of ``docs``, with all its columns, per class: the one with the
    smallest key (null keys last, ties by a hash of the text).  Rows without words are
    never linked, so all of them stay."""
    picked = pick(docs)
    _, _, known = node_components(picked, threshold)
    rows = materialize(row_nodes(picked), "row-nodes")
    linked = rows.where(F.col("node").isNotNull()).join(known, "node", "left") \
        .select("id", "doc_id", F.coalesce("component", "node").alias("class"))
    first = linked.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id"))["id"].alias("first"))
    told = linked.join(first, "class").select("id", (F.col("id") == F.col("first")).alias("stays"))
    return keep_rows(docs, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), told)


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return link_classes(table(spark, sf_dir, "documents"))
