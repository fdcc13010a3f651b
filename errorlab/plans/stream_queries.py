"""Registered streaming queries (Z1-Z4): each stream is drained and its sink
compared with the batch answer (the oracle SQL is the batch query's)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..streaming import streams as Z
from .catalog import register
from .fixtures import register_fixture_sql, with_fixtures
from .score_queries import r6, scores
from .sequence_queries import epochs


def _derived(fx, df, name, key):
    """Write a Spark-derived table into the shared checkpoint folder, as files
    a stream can pick up; rows of one key arrive together."""
    path = os.path.join(checkpoint_dir(fx.spark), "derived", f"{name}-{uuid.uuid4().hex}")
    df.repartition(4, key).write.mode("overwrite").parquet(path)
    return path


@register("Z1_stream_token_counts", with_fixtures("SELECT term, freq FROM freq", "freq"))
def z1(fx):
    """Documents arrive in three lots; the table holds each term's count after the last."""
    docs = fx.t("documents").select("doc_id", "text")
    lots = [docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == i) for i in range(3)]
    return Z.replay(fx.spark, lots, Z.stream_token_counts, "z1", ["term"])


QUARTERS, LATE = 4, 50


def arrivals(fx, late: bool = True):
    """The events in four lots by day; with ``late``, some rows of the first lot come with
    the last one, long after the watermark."""
    ev = fx.t("events")
    first, last = ev.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    days = (last - first).days + 1 if first else 1
    lot = F.floor(F.datediff(F.to_date("ts"), F.lit(first)) * QUARTERS / days).cast("int")
    if late:
        lot = F.when((lot == 0) & (F.col("event_id") % LATE == 0), QUARTERS - 1).otherwise(lot)
    return [ev.withColumn("lot", lot).filter(F.col("lot") == i).drop("lot") for i in range(QUARTERS)]


register_fixture_sql("on_time", (), f"""
    SELECT * FROM events, (SELECT min(ts)::DATE AS first, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS days FROM events)
    WHERE NOT (date_diff('day', first, ts::DATE) * {QUARTERS} // days = 0 AND event_id % {LATE} = 0)""")


def _windows(out):
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n",
                      r6(F.col("mean_value")).alias("mean_value"))


@register("Z2_stream_metrics", with_fixtures("""
    SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
           count(*) AS n, round(avg(value), 6) AS mean_value FROM on_time GROUP BY 1, 2""", "on_time"))
def z2(fx):
    """Daily metrics of events that arrive in four lots; late rows are dropped."""
    return _windows(Z.replay(fx.spark, arrivals(fx), Z.stream_metrics, "z2", ["w", "event_type"]))


@register("Z2_stream_sliding", with_fixtures("""
    SELECT strftime(time_bucket(INTERVAL 1 day, ts) - to_days(CAST(d AS INT)), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
           count(*) AS n, round(avg(value), 6) AS mean_value FROM on_time, (SELECT unnest([0, 1]) AS d) GROUP BY 1, 2""",
    "on_time"))
def z2_sliding(fx):
    """The same over two-day windows that start every day."""
    return _windows(Z.replay(fx.spark, arrivals(fx), lambda e: Z.stream_metrics(e, "2 days", "1 day"), "z2s",
                             ["w", "event_type"]))


@register("Z2_stream_sessions", """
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
        SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 minute THEN 0 ELSE 1 END AS fresh
        FROM events))
    GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 minute <= (SELECT max(ts) FROM events) - INTERVAL 1 hour""")
def z2_sessions(fx):
    """Sessions of each user that have ended (by the watermark) when all events are there."""
    out = Z.replay(fx.spark, arrivals(fx, late=False), Z.stream_sessions, "z2u", ["s", "user_id"], "append")
    return out.select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@register("Z3_stream_early_stop", with_fixtures("""
    SELECT CAST(run_id AS BIGINT) AS run_id, CAST(epoch AS INT) AS stop_epoch, CAST(best_epoch AS INT) AS best_epoch,
           round(best, 6) AS best
    FROM best_so_far WHERE epoch - best_epoch > 3
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch) = 1""", "best_so_far"))
def z3(fx):
    """Epochs of all runs arrive in three lots; a run without news for a year is forgotten."""
    ep = epochs(fx).select(F.col("run_id").cast("long"), F.col("epoch").cast("int"), "val_loss") \
        .withColumn("ts", F.timestamp_add("DAY", F.col("epoch"), F.lit("2024-01-01").cast("timestamp")))
    lots = [ep.filter(F.col("epoch").between(a, b)) for a, b in ((0, 9), (10, 19), (20, 1 << 30))]
    with Z.with_rocksdb(fx.spark):
        out = Z.replay(fx.spark, lots, lambda e: Z.stream_early_stop(e, 3), "z3", ["run_id"], "append")
    return out.select("run_id", "stop_epoch", "best_epoch", r6(F.col("best")).alias("best"))


@register("Z4_stream_score", with_fixtures(
    "SELECT vec_id, current, CASE WHEN best - second < 0.5 THEN current ELSE pred END AS decision FROM scored",
    "scored"))
def z4(fx):
    s = scores(fx)
    path = _derived(fx, s, "scores", "vec_id")
    stream = fx.spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return Z.drain(Z.stream_score(stream), "z4")
