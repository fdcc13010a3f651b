"""Helpers the ten operators share: tables, materialised cuts, Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from errorlab.session import checkpoint_dir

#: Bytes of text that one vectorised step works on; bounds the memory of a task.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    lost executors cost nothing that was finished before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, text string`` (null text: empty) whatever else ``docs`` holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_steps(batches: Iterator[pa.RecordBatch], col: str = "text",
               max_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``max_bytes`` of ``col``; a longer
    text comes alone, whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        arr = batch.column(batch.schema.get_field_index(col))
        ends = _offsets(arr)
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(ends, ends[lo] + max_bytes, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _offsets(arr: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    if arr.buffers()[1] is None:
        return np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(arr.buffers()[1], kind, len(arr) + 1, arr.offset * kind.itemsize).astype(np.int64)


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its ``n + 1`` offsets, without copying rows."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offs = _offsets(arr)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int64))


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed, max_docs: int,
                    max_bytes: int, seed: int = 11) -> list[tuple[str, int]]:
    """At most ``max_docs`` labelled texts and ``max_bytes`` of them, whole, in the order
    of a hash of their keys.  ``allowed(key column)`` says which rows may be used."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")) \
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & allowed(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    first = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_docs)
    texts = pick(docs).join(F.broadcast(first), "doc_id")  # at most max_docs rows
    sizes = texts.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n"),
                                        F.xxhash64("doc_id", F.lit(seed)).alias("h")).collect()
    chosen, left = [], max_bytes
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] <= left:
            chosen.append(r["doc_id"])
            left -= r["n"]
    if not chosen:
        return []
    rows = texts.where(F.col("doc_id").isin(chosen)).groupBy("doc_id") \
        .agg(F.max("text").alias("text"), F.max("y").alias("y")).collect()
    place = {d: i for i, d in enumerate(chosen)}
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: place[r["doc_id"]])]


def row_id(key: Column, digest: Column) -> Column:
    """What tells rows apart when documents are dropped: the key (``-`` if null) and a
    digest of the text."""
    return F.concat(F.coalesce(key.cast("long").cast("string"), F.lit("-")), F.lit("|"), digest.cast("string"))


def keep_rows(docs: DataFrame, digest: Column, told: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay according to ``told(id,
    stays)``, which has a row per row of ``docs`` with its ``row_id``.  Of rows that stay
    under one id (repeated rows) one is kept.  Columns of any name pass through: the row
    travels as one struct."""
    rows = docs.select(F.struct("*").alias("row"), row_id(F.col("doc_id"), digest).alias("id"))
    drop = told.where(~F.col("stays")).select("id").distinct()
    repeated = told.where("stays").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    kept = rows.join(drop, "id", "left_anti")
    if not repeated.isEmpty():
        kept = kept.join(repeated, "id", "left_anti").unionByName(
            kept.join(repeated, "id", "left_semi").dropDuplicates(["id"]))
    return kept.select("row.*")
