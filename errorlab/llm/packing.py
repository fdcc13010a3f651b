"""Best-fit packing under conflicts.

Documents fill bins of ``capacity`` words.  No bin holds two documents of one source or
of one duplicate cluster.  A document longer than
the capacity is cut into full bins of its own and a rest, and the rest is packed like a
document, so nothing is dropped.

Best fit decreasing: the largest piece first, each into the compatible bin with the
least room that still holds it.  Open bins are ordered by their room; every bin carries
a bitmap of its sources and one of its duplicate clusters.  A search starts at the least
room that fits and goes from successor to successor until it meets the tightest
compatible bin.  A tree over the rooms holds for every range the bitmap that all its
bins have in common, so ranges without a compatible bin are skipped whole; this is what
keeps a hot source or cluster from making the search linear.

Only ``doc_id, n_words, source, cluster`` are shuffled.  Documents are dealt by a hash of
their key and row to shards of about ``shard_docs`` documents, at every size, and best
fit is sought inside a shard; the only price is the last, partly filled bins of a shard.
A hot source, cluster or key is dealt evenly like everything else.

Null sources and clusters conflict with nothing; empty and null texts (no words) take no
room, and still go to a bin; rows that repeat a key are packed as documents of their
own.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

CAPACITY = 2048
SHARD_DOCS = 20_000


class Bins:
    """Open bins ordered by room, with a tree of common bitmaps over the rooms."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()  # rooms 0 .. capacity
        self.common: list[int | None] = [None] * (2 * self.leaves)  # None: no bin there
        self.at: list[dict[int, list[int]]] = [{} for _ in range(self.leaves)]  # room -> bitmap -> bins

    def _set(self, room: int, value: int | None) -> None:
        node = self.leaves + room
        while self.common[node] != value:
            self.common[node] = value
            node >>= 1
            if not node:
                return
            left, right = self.common[2 * node], self.common[2 * node + 1]
            value = right if left is None else left if right is None else left & right

    def put(self, bin_id: int, room: int, bitmap: int) -> None:
        heapq.heappush(self.at[room].setdefault(bitmap, []), bin_id)
        now = self.common[self.leaves + room]
        self._set(room, bitmap if now is None else now & bitmap)

    def _successor(self, room: int, bits: int) -> int | None:
        """The least room from ``room`` on whose bins do not all share one of ``bits``."""
        def may(n: int) -> bool:
            return self.common[n] is not None and not self.common[n] & bits

        while room < self.leaves:
            node = self.leaves + room
            if may(node):
                return room
            while node > 1 and (node & 1 or not may(node + 1)):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves and (may(2 * node) or may(2 * node + 1)):
                node = 2 * node if may(2 * node) else 2 * node + 1
            if node >= self.leaves:
                return node - self.leaves
            while node < self.leaves:  # two bits, each common to one half: go on behind
                node = 2 * node + 1
            room = node - self.leaves + 1
        return None

    def take(self, size: int, bits: int) -> tuple[int, int, int] | None:
        """Remove and return the tightest compatible bin as ``(id, room, bitmap)``; of
        equal rooms the bin with the smallest id."""
        room = self._successor(size, bits)
        while room is not None:
            here = self.at[room]
            free = [(ids[0], bitmap) for bitmap, ids in here.items() if not bitmap & bits]
            if free:
                bin_id, bitmap = min(free)
                heapq.heappop(here[bitmap])
                if not here[bitmap]:
                    del here[bitmap]
                    left = None
                    for other in here:
                        left = other if left is None else left & other
                    self._set(room, left)
                return bin_id, room, bitmap
            room = self._successor(room + 1, bits)
        return None


def pack(sizes: Iterable[int], bits: Iterable[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece, in the given order."""
    bins, made, out = Bins(capacity), 0, []
    for size, own in zip(sizes, bits):
        got = bins.take(size, own)
        if got is None:
            got = (made, capacity, 0)
            made += 1
        bin_id, room, bitmap = got
        out.append((bin_id, capacity - room))
        bins.put(bin_id, room - size, bitmap | own)
    return out


def _bits(column: pd.Series, first: int) -> tuple[list[int], int]:
    """A bit for each value that occurs twice or more (others can't conflict)."""
    counts = column.dropna().value_counts()
    bit = {v: 1 << (first + i) for i, v in enumerate(sorted(counts[counts > 1].index))}
    return [bit.get(v, 0) for v in column], first + len(bit)


def pack_documents(sized: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``doc_id, piece, n_words, shard, bin, start`` for ``sized(doc_id, n_words, source,
    cluster)``: piece number ``piece`` lies at ``start`` in that bin of that shard."""
    sized = materialize(sized.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "source", "cluster"),
                        "sized")
    shards = max(1, -(-sized.count() // shard_docs))
    last = F.greatest(F.ceil(F.col("n_words") / capacity) - 1, F.lit(0))
    # The row's place in the written table is part of the deal: no key, null or repeated, fills a shard.
    deal = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(3)), F.lit(shards))
    pieces = sized.withColumn("shard", deal) \
        .select("doc_id", "n_words", "source", "cluster", "shard", F.explode(F.sequence(F.lit(0), last)).alias("piece")) \
        .select("doc_id", "piece", F.least(F.lit(capacity), F.col("n_words") - F.col("piece") * capacity).alias("n_words"),
                "source", "cluster", "shard")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        # A document's own full pieces never share a bin with it, being as large as one.
        pdf = pdf.sort_values(["n_words", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        source, used = _bits(pdf["source"], 0)
        cluster, _ = _bits(pdf["cluster"], used)
        placed = pack(pdf["n_words"], (a | b for a, b in zip(source, cluster)), capacity)
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "piece": pdf["piece"].to_numpy(),
                             "n_words": pdf["n_words"].to_numpy(), "shard": pdf["shard"].to_numpy(),
                             "bin": [b for b, _ in placed], "start": [s for _, s in placed]})

    return pieces.groupBy("shard").applyInPandas(
        fill, "doc_id long, piece long, n_words long, shard long, bin long, start long")


def sizes_of(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, source, cluster`` of documents: words are runs between white
    space; a cluster is the set of texts that agree in letters and digits, cases aside."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    cluster = F.when(F.trim(plain) != "", F.sha2(F.trim(plain), 256))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("n_words"),
                       F.col("source").cast("string").alias("source"), cluster.alias("cluster"))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(sizes_of(table(spark, sf_dir, "documents")))
