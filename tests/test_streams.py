"""Streams: late rows, zones and bounded state."""

from __future__ import annotations

import datetime
import random

import pytest

from tidewell.operators.time import interval_join
from tidewell.streaming import windows

EVENTS = "event_id long, ts timestamp_ntz, user_id long, value double"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def events(spark, rows):
    return spark.createDataFrame([(i, at(m) if m is not None else None, u, v) for i, m, u, v in rows], EVENTS)


def replayed(spark, folder, batches, make, name):
    """Rows that ``make`` of the stream appends, when the batches come one after another; and the rows of state after each."""
    import os

    for n, _ in enumerate(batches):
        os.makedirs(f"{folder}/in/{n}", exist_ok=True)
    source = lambda: spark.readStream.schema(EVENTS).parquet(f"{folder}/in/*")
    query = make(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").start()
    held = []
    try:
        for n, rows in enumerate(batches):
            events(spark, rows).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/{n}")
            query.processAllAvailable()
            held.append(sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]))
    finally:
        query.stop()
    return spark.table(name).collect(), held


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kathmandu"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_times_without_zone_are_utc_in_any_zone(spark, zone):
    """Also where the session's zone skips or repeats an hour, and before 1970."""
    times = [datetime.datetime(2024, 3, 10, 2, 30, 15, 123456), datetime.datetime(2024, 11, 3, 1, 30), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), datetime.datetime(1901, 2, 3), None]
    frame = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    from pyspark.sql import functions as F

    found = frame.select("ts", F.unix_micros(windows.instant(F.col("ts"))).alias("micros"), windows.zoneless(windows.instant(F.col("ts"))).alias("back")).collect()
    epoch = datetime.datetime(1970, 1, 1)
    assert all(r.back == r.ts and r.micros == (None if r.ts is None else (r.ts - epoch) // datetime.timedelta(microseconds=1)) for r in found)
    counts = windows.windowed_counts(events(spark, [(1, 30, 1, 1.0), (2, 24 * 60 - 1, 1, 2.0), (3, 24 * 60, 1, 4.0)]), time="ts", size="1 day").collect()
    assert sorted((r.start, r.end, r.n) for r in counts) == [(at(0), at(1440), 2), (at(1440), at(2880), 1)]


def test_streamed_sessions_and_late_rows(spark, tmp_path, zone):
    batches = [[(1, 0, 1, 1.0), (2, 60, 1, 1.0), (3, 10, 2, 1.0), (4, None, 1, 1.0)], [(5, 121, 1, 1.0), (6, 50, 2, 1.0)], [(7, 400, 3, 1.0)], [(8, 30, 2, 9.0), (9, 401, 3, 1.0)], [(10, 900, 4, 1.0)]]
    found, held = replayed(spark, tmp_path, batches, lambda s: windows.session_counts(s(), key="user_id", time="ts", gap="1 hour"), f"sessions_{zone[:2]}")
    # row 8 is behind the watermark and in no session
    assert sorted((r.user_id, r.n_events, r.first_ts, r.last_ts) for r in found) == [(1, 1, at(121), at(121)), (1, 2, at(0), at(60)), (2, 2, at(10), at(50)), (3, 2, at(400), at(401))]
    assert held[-1] <= 2


def test_streamed_join_equals_the_table_join(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, 3 * i + rng.randrange(-20, 20), rng.choice([1, 2, None]), float(i % 2)) for i in range(300)]
    batches = [rows[k : k + 30] for k in range(0, 300, 30)]
    make = lambda s: windows.interval_joined(s().filter("value = 1"), s().filter("value = 0"), key="user_id", time="ts", seconds=3600)
    found, held = replayed(spark, tmp_path, batches, make, "pairs")
    table = events(spark, rows)
    plain = interval_join(table.filter("value = 1"), table.filter("value = 0"), key="user_id", time="ts", seconds=3600).collect()
    assert sorted((r.event_id, r.before_event_id, r.ts, r.before_ts) for r in found) == sorted((r.event_id, r.before_event_id, r.ts, r.before_ts) for r in plain) and found
    assert max(held) <= 150 and held[-1] < len(rows) / 2  # rows behind both watermarks are let go


def test_streamed_join_leaves_out_late_rows(spark, tmp_path):
    batches = [[(1, 0, 1, 0.0)], [(2, 600, 1, 1.0), (3, 600, 1, 0.0)], [(4, 30, 1, 1.0)], [(5, 610, 1, 1.0)]]
    make = lambda s: windows.interval_joined(s().filter("value = 1"), s().filter("value = 0"), key="user_id", time="ts", seconds=3600)
    found, _ = replayed(spark, tmp_path, batches, make, "late_pairs")
    assert sorted((r.event_id, r.before_event_id) for r in found) == [(2, 3), (5, 3)]
