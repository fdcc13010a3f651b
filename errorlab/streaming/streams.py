"""Structured Streaming operators.

Each function turns a streaming DataFrame into another; ``drain`` and ``replay`` run it
with ``availableNow`` into Parquet files, which is how the registered queries compare a
stream with its batch answer.  Files and checkpoints live under the session's shared
checkpoint folder, never on a machine-local path.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import decide as Pd
from ..operators import text as T
from ..session import checkpoint_dir


def _ckpt(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None,
                files_per_trigger: int = 1) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(path)


def drain(df: DataFrame, name: str) -> DataFrame:
    """Run an appending stream to its end; rows go to Parquet files in the shared folder,
    each exactly once."""
    spark = df.sparkSession
    path = _ckpt(spark, f"{name}-out")
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", _ckpt(spark, name)) \
        .trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


class KeyedTable:
    """A Parquet table that a stream keeps up to date: every micro-batch writes the rows
    that it changed to a folder of its own (a repeated batch overwrites that folder), and
    a reader takes each key's row of the last batch.  Nothing passes through the driver."""

    def __init__(self, spark: SparkSession, name: str, schema: StructType, keys: Sequence[str]):
        self.spark, self.keys = spark, list(keys)
        self.path, self.checkpoint = _ckpt(spark, f"{name}-table"), _ckpt(spark, name)
        self.values = [f.name for f in schema.fields if f.name not in keys]
        self.schema = StructType([*schema.fields, StructField("batch", LongType())])
        spark.createDataFrame([], schema).write.parquet(f"{self.path}/batch=-1")

    def _write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def advance(self, df: DataFrame, mode: str = "update") -> None:
        """Run the stream ``df`` over everything that has arrived; a later call goes on
        from the same checkpoint, with the state that was kept."""
        df.writeStream.foreachBatch(self._write).outputMode(mode).option("checkpointLocation", self.checkpoint) \
            .trigger(availableNow=True).start().awaitTermination()

    def read(self) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.values), "batch").alias("_v"))
        return last.select(*self.keys, *[F.col("_v")[v].alias(v) for v in self.values])


def replay(spark: SparkSession, arrivals: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], name: str,
           keys: Sequence[str], mode: str = "update") -> DataFrame:
    """Let tables arrive one after the other in a folder, run the stream ``build(source)``
    after each, and return its keyed table."""
    folder, table = _ckpt(spark, f"{name}-in"), None
    for rows in arrivals:
        rows.write.mode("append").parquet(folder)
        stream = build(spark.readStream.schema(rows.schema).parquet(folder))
        table = table or KeyedTable(spark, name, stream.schema, keys)
        table.advance(stream, mode)
    return table.read()


# Z1 ------------------------------------------------------------------------
def stream_token_counts(docs: DataFrame) -> DataFrame:
    """Running term frequencies of arriving documents (update mode: changed terms)."""
    return T.term_freq(T.words(T.tokenize(docs.select("doc_id", "text"))))


# Z2 ------------------------------------------------------------------------
def stream_metrics(events: DataFrame, window: str = "1 day", slide: str | None = None,
                   watermark: str = "1 hour") -> DataFrame:
    """Count and mean of the metric per event-time window and type.  A window's state is
    dropped when the watermark passes its end; rows that come later are dropped too."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))   # event time must be TIMESTAMP
    return (events.withWatermark("ts", watermark).groupBy(w.alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")))


def stream_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Per-user sessions (``session_window``) with event counts; a session is emitted once,
    when the watermark has passed its end (append mode)."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return (events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
            .agg(F.count(F.lit(1)).alias("n")))


# Z3 ------------------------------------------------------------------------
class EarlyStop(StatefulProcessor):
    """Best value of a run so far.  Emits a row when ``epoch - best_epoch`` exceeds
    ``patience``; epochs at or before the last one are ignored.  A timer, moved on by every
    row, removes the state of a run without news for ``idle_ms`` of event time."""

    def __init__(self, patience: int, idle_ms: int):
        self.patience, self.idle_ms = patience, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "best double, best_epoch int, last_epoch int, stopped boolean, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            best, best_epoch, last_epoch, stopped, timer = self.state.get()
            self.handle.deleteTimer(timer)
        else:
            best, best_epoch, last_epoch, stopped, timer = float("inf"), -1, -1, False, 0
        news, out = pd.concat(list(rows)).sort_values("epoch"), []
        for epoch, loss in zip(news["epoch"].tolist(), news["val_loss"].tolist()):
            if stopped or epoch <= last_epoch:
                continue
            last_epoch = epoch
            if loss < best:
                best, best_epoch = loss, epoch
            elif epoch - best_epoch > self.patience:
                stopped = True
                out.append((key[0], epoch, best_epoch, best))
        timer = max(timer, int(news["ts"].max().timestamp() * 1000) + self.idle_ms)
        self.handle.registerTimer(timer)
        self.state.update((best, best_epoch, last_epoch, stopped, timer))
        yield pd.DataFrame(out, columns=["run_id", "stop_epoch", "best_epoch", "best"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame([], columns=["run_id", "stop_epoch", "best_epoch", "best"])

    def close(self) -> None:
        pass


STOPS = "run_id long, stop_epoch int, best_epoch int, best double"


def stream_early_stop(epochs: DataFrame, patience: int, idle: timedelta = timedelta(days=365),
                      watermark: str = "1 hour") -> DataFrame:
    """A row per run that stops, from ``(run_id, epoch, ts, val_loss)`` with event time ``ts``.
    Needs the RocksDB state store (:func:`with_rocksdb`)."""
    return epochs.withWatermark("ts", watermark).groupBy("run_id").transformWithStateInPandas(
        EarlyStop(patience, int(idle.total_seconds() * 1000)), STOPS, "Append", "EventTime")


@contextmanager
def with_rocksdb(spark: SparkSession):
    """The state store that stateful processors need, for queries started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


# Z4 ------------------------------------------------------------------------
def stream_score(scores: DataFrame, m: float = 0.5) -> DataFrame:
    """Decision rules on arriving scores (stateless, same expressions as batch)."""
    return scores.select("vec_id", "current", Pd.margin_top_two("prob", "current", m).alias("decision"))
