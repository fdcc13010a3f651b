"""Streams: late rows, evicted state, expiry, and tables without the driver."""

from datetime import datetime, timedelta

import duckdb

import __spark_entry__ as E
from support import SF_SMALL
from errorlab.streaming import streams as Z

DAY = datetime(2024, 1, 1)


def at(hours):
    return DAY + timedelta(hours=hours)


def test_late_rows_and_updates(spark):
    schema = "ts timestamp, event_type string, value double"
    lots = [[(at(1), "a", 1.0), (at(2), "b", 5.0)], [(at(3), "a", 3.0), (at(60), "a", 7.0)], [(at(61), "a", 9.0)],
            [(at(4), "a", 100.0), (at(70), "b", 1.0)]]  # hour 4 is long past the watermark
    out = Z.replay(spark, [spark.createDataFrame(x, schema) for x in lots], Z.stream_metrics, "t", ["w", "event_type"])
    got = {(r.w.start.day, r.event_type): (r.n, r.mean_value) for r in out.collect()}
    assert got == {(1, "a"): (2, 2.0), (1, "b"): (1, 5.0), (3, "a"): (2, 8.0), (3, "b"): (1, 1.0)}


def test_state_of_an_idle_run_expires(spark):
    schema = "run_id long, epoch int, val_loss double, ts timestamp"
    lots = [[(1, 0, 1.0, at(0)), (2, 0, 1.0, at(0))], [(2, 1, 0.5, at(100)), (3, 0, 1.0, at(100))],
            [(3, 1, 2.0, at(101)), (2, 2, 0.6, at(101))],
            [(1, 10, 3.0, at(102)), (2, 20, 0.9, at(102))]]

    def stops(idle):
        with Z.with_rocksdb(spark):
            out = Z.replay(spark, [spark.createDataFrame(x, schema) for x in lots],
                           lambda e: Z.stream_early_stop(e, 3, idle), "t", ["run_id"], "append")
        return sorted(map(tuple, out.collect()))

    # Run 1 is silent for 100 hours: kept, its tenth epoch stops it; forgotten, it begins anew.
    assert stops(timedelta(days=30)) == [(1, 10, 0, 1.0), (2, 20, 1, 0.5)]
    assert stops(timedelta(hours=24)) == [(2, 20, 1, 0.5)]


def test_a_repeated_batch_replaces_its_rows(spark):
    rows = spark.createDataFrame([("a", 1)], "term string, freq long")
    table = Z.KeyedTable(spark, "t", rows.schema, ["term"])
    assert table.read().count() == 0
    for freq, batch in ((1, 0), (2, 1), (3, 1), (3, 1)):
        table._write(spark.createDataFrame([("a", freq), (f"b{batch}", 7)], rows.schema), batch)
    assert sorted(map(tuple, table.read().collect())) == [("a", 3), ("b0", 7), ("b1", 7)]


def test_some_rows_come_too_late(spark):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF_SMALL}/events.parquet')")
        total, kept = c.execute("SELECT count(*) FROM events").fetchone()[0], \
            c.execute("SELECT sum(n) FROM (" + E.oracle_sql()["Z2_stream_metrics"] + ")").fetchone()[0]
    assert 0 < total - kept < total / 10
