"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is the set of its five-word shingles.  Items are partitioned by size (powers
of two of their shingle counts); each class takes as many MinHash samples per item as it
needs, all shingles in the smallest classes.  A sample is the item's shingle with the
smallest value of one hash function; it lies in a document with the probability of the
item's containment there, however long the document is.  A document is a candidate for
an item when it holds at least the class's least number of samples, set so that an item
at the threshold is missed with a probability below ``MISS``.  Candidates are verified by
exact containment of the item's whole shingle set.

The test items are a query set: they go to the tasks in blocks of at most
``block_shingles`` shingles, and every block is held against all documents, whole texts,
in one pass without a shuffle.  More items mean more blocks, never a cap.

An item of one to four words has a single shingle, of all its words; it is held against
the documents' runs of as many words.  Items without words are never matched.  Items with
equal or null ids are one item each row, and their ids are given as they are.  Null texts
are empty.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs, pick, table, text_steps, utf8
from .hashing import SHINGLE, WORD_RX, mix, shingles, word_grams, words

THRESHOLD = 0.8
MISS = 1e-4
SAMPLES = 32
FILTER_BITS = 22


def least_hits(samples: int, threshold: float) -> int:
    """The largest number of hits that ``samples`` draws of probability ``threshold``
    fall short of with a probability below ``MISS``."""
    below, k = 0.0, 0
    while k < samples:
        below += math.comb(samples, k) * threshold ** k * (1 - threshold) ** (samples - k)
        if below >= MISS:
            break
        k += 1
    return max(1, k)


@dataclass
class Block:
    """Samples of a block's items, sorted by shingle, and the items' whole sets."""

    item_ids: list
    sets: list[np.ndarray]
    hits: np.ndarray
    keys: np.ndarray
    owner: np.ndarray
    filter: np.ndarray
    #: Items of fewer than five words: length -> hash -> items.
    short: dict[int, dict[int, list[int]]]


def samples(s: np.ndarray) -> np.ndarray:
    """The shingles with the smallest values of ``SAMPLES`` hash functions, each once."""
    lots = np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(np.array([s[np.argmin(mix(s + x))] for x in lots], np.uint64))


def build_block(item_ids: list, sets: list[np.ndarray], lengths: list[int], threshold: float) -> Block:
    keys, owner, hits = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
    short: dict[int, dict[int, list[int]]] = {}
    for i, s in enumerate(sets):
        if lengths[i] < SHINGLE:
            short.setdefault(lengths[i], {}).setdefault(int(s[0]), []).append(i)
            hits.append(1)
            continue
        size_class = 1 << (len(s) - 1).bit_length()  # items of a class share what follows
        if size_class <= SAMPLES:
            mine = s
            hits.append(math.ceil(len(s) * threshold - 1e-9))
        else:
            # Draws that took the same shingle count once, so the least number is that of the distinct ones.
            mine = samples(s)
            hits.append(least_hits(len(mine), threshold))
        keys.append(mine)
        owner.append(np.full(len(mine), i))
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Block(item_ids, sets, np.array(hits), keys, owner, bits, short)


def search(block: Block, arr: pa.Array, threshold: float):
    """Rows ``(text, item, shared)`` of the contained items."""
    return _search_short(block, arr) + _search_long(block, arr, threshold)


def _search_short(block: Block, arr: pa.Array) -> list[tuple[int, int, int]]:
    found = set()
    for n, items in block.short.items():
        h, doc = word_grams(arr, n)
        at = np.flatnonzero(np.isin(h, np.fromiter(items, np.uint64, len(items))))
        found.update((d, i, 1) for x, d in zip(h[at].tolist(), doc[at].tolist()) for i in items[x])
    return sorted(found)


def _search_long(block: Block, arr: pa.Array, threshold: float) -> list[tuple[int, int, int]]:
    if not len(block.keys):
        return []
    h, offs = shingles(arr)
    near = np.flatnonzero(block.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    lo, hi = (np.searchsorted(block.keys, h[near], side) for side in ("left", "right"))
    near, lo, hi = near[hi > lo], lo[hi > lo], hi[hi > lo]
    if not len(near):
        return []
    doc = np.searchsorted(offs, near, "right") - 1
    # One hit per document and sample row, however often the shingle occurs there.
    span = hi - lo
    rows = np.repeat(lo, span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
    hit = np.unique(np.repeat(doc, span) * np.int64(len(block.keys)) + rows)
    pair, n = np.unique((hit // len(block.keys)) * len(block.sets) + block.owner[hit % len(block.keys)],
                        return_counts=True)
    found = []
    for p in pair[n >= block.hits[pair % len(block.sets)]]:
        d, i = int(p // len(block.sets)), int(p % len(block.sets))
        shared = int(np.isin(block.sets[i], h[offs[d]:offs[d + 1]]).sum())
        if shared >= threshold * len(block.sets[i]) - 1e-9:
            found.append((d, i, shared))
    return found


def item_blocks(benchmark: DataFrame, threshold: float, block_shingles: int):
    """Blocks of the test items, brought to the driver one bounded block at a time."""
    ids: list = []
    sets: list[np.ndarray] = []
    lengths: list[int] = []
    held = 0
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string")) \
        .where(F.col("text").isNotNull())
    for r in items.toLocalIterator():
        text = pa.array([r["text"]], pa.string())
        length = len(words(*utf8(pc.utf8_lower(text)))[0])
        if not length:
            continue
        h = np.unique(shingles(text)[0])
        if ids and held + len(h) > block_shingles:
            yield build_block(ids, sets, lengths, threshold)
            ids, sets, lengths, held = [], [], [], 0
        ids.append(r["item_id"])
        sets.append(h)
        lengths.append(length)
        held += len(h)
    if ids:
        yield build_block(ids, sets, lengths, threshold)


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
              block_shingles: int = 1_000_000) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment``: one row per document row and
    test item that it holds at least to the threshold."""
    spark = docs.sparkSession
    docs = pick(docs)
    schema = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    out = None
    for block in item_blocks(benchmark, threshold, block_shingles):
        found = docs.mapInArrow(_searcher(block, threshold), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _searcher(block, threshold: float):
    def step(batches):
        for b in text_steps(batches):
            rows = search(block, b.column("text"), threshold)
            if rows:
                d, i, n = zip(*rows)
                size = np.array([len(block.sets[x]) for x in i])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(longs(d)), pa.array([block.item_ids[x] for x in i], pa.int64()), longs(n),
                     longs(size), pa.array(np.array(n) / size)],
                    ["doc_id", "item_id", "n_shared", "n_item", "containment"])
    return step


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
               block_shingles: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item."""
    for block in item_blocks(benchmark, threshold, block_shingles):
        docs = docs.mapInArrow(_cleaner(block, threshold), docs.schema)
    return docs


def _cleaner(block, threshold: float):
    def step(batches):
        for b in text_steps(batches):
            text = pc.fill_null(b.column(b.schema.get_field_index("text")), "")
            keep = np.ones(b.num_rows, bool)
            keep[[d for d, _, _ in search(block, text, threshold)]] = False
            yield b.filter(pa.array(keep))
    return step


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(lower(text), '{WORD_RX}') AS w FROM documents),
iw AS (SELECT i, item_id, w, least(len(w), {SHINGLE}) AS k FROM (
         SELECT row_number() OVER () AS i, item_id, regexp_extract_all(lower(text), '{WORD_RX}') AS w FROM benchmark)
       WHERE len(w) > 0),
si AS (SELECT DISTINCT i, item_id, k, array_to_string(w[x:x+k-1], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS x FROM iw)),
sizes AS (SELECT i, count(*) AS n_item FROM si GROUP BY i),
sd AS (SELECT DISTINCT d, doc_id, k, s FROM (
         SELECT d, doc_id, k, array_to_string(w[x:x+k-1], ' ') AS s
         FROM (SELECT d, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS x
               FROM w JOIN (SELECT DISTINCT k FROM iw) ON len(w) >= k))
       WHERE s IN (SELECT s FROM si)),
hit AS (SELECT d, doc_id, i, item_id, count(*) AS n_shared FROM sd JOIN si USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM hit JOIN sizes USING (i) WHERE n_shared >= {THRESHOLD} * n_item - 1e-9
"""
