"""Every query with SQL gives the same rows in DuckDB; operators on odd rows."""

from __future__ import annotations

import datetime
import glob
import os
import random

import duckdb
import pytest

from tidewell.operators.ranking import top_per_group
from tidewell.operators.time import asof_join, in_blocks, interval_join, numbered, sessions
from tidewell.plans import catalog
from tidewell.streaming.windows import deduplicated, windowed_counts

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else value.isoformat() if hasattr(value, "isoformat") else str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    found = catalog.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    expected = db.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in found.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in expected)


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


EVENTS = "event_id long, ts timestamp_ntz, user_id long, value double"


def events(spark, rows):
    return spark.createDataFrame([(i, at(m), u, v) for i, m, u, v in rows], EVENTS)


def test_asof_ties_nulls_and_empty(spark):
    left = events(spark, [(1, 10, 1, 0.0), (2, 10, 2, 0.0), (3, 5, 1, 0.0), (4, 10, None, 0.0)])
    right = events(spark, [(11, 10, 1, 1.0), (12, 10, 1, 2.0), (13, 4, 1, None), (14, 11, 2, 5.0)])
    joined = {r.event_id: (r.asof_event_id, r.asof_value) for r in asof_join(left, right, key="user_id", time="ts", order="event_id", values=["event_id", "value"]).collect()}
    assert joined == {1: (12, 2.0), 2: (None, None), 3: (13, None), 4: (None, None)}
    assert asof_join(left.limit(0), right, key="user_id", time="ts", order="event_id", values=["value"]).collect() == []


def test_asof_over_stretches_of_a_hot_key(spark):
    rng = random.Random(5)
    lefts = [(i, rng.randrange(9000), rng.choice([1, 1, 1, 2]), 0.0) for i in range(300)]
    rights = [(1000 + i, rng.randrange(9000), rng.choice([1, 1, 2, 3]), float(i)) for i in range(40)]
    joined = {r.event_id: r.asof_event_id for r in asof_join(events(spark, lefts), events(spark, rights), key="user_id", time="ts", order="event_id", values=["event_id"], seconds=3600).collect()}
    for i, m, u, _ in lefts:
        assert joined[i] == max(((t, j) for j, t, v, _ in rights if v == u and t <= m), default=(0, None))[1]


def test_windows_in_blocks(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(i, rng.randrange(900), rng.choice([1, 1, 1, 2, None]), float(rng.randrange(99))) for i in range(200)]
    table = numbered(events(spark, rows), key="user_id", time="ts", order="event_id", seconds=3600)
    blocked, window, own = in_blocks(table, key="user_id", reach=2, rows=7)
    found = blocked.select("event_id", "number", F.sum("value").over(window.rowsBetween(-2, 0)).alias("s"), own.alias("own")).filter("own").collect()
    assert len(found) == len(rows)
    for r in found:
        user = next(u for i, _, u, _ in rows if i == r.event_id)
        ordered = sorted((m, i, v) for i, m, u, v in rows if u == user)
        at = [i for _, i, _ in ordered].index(r.event_id)
        assert r.number == at and r.s == sum(v for _, _, v in ordered[max(0, at - 2) : at + 1])
    assert numbered(events(spark, []), key="user_id", time="ts", order="event_id").collect() == []


def test_interval_join_edges(spark):
    left, right = events(spark, [(1, 60, 1, 0.0), (2, 61, 1, 0.0), (3, 60, None, 0.0)]), events(spark, [(11, 0, 1, 1.0), (12, 60, 1, 2.0), (13, 62, 1, 3.0), (14, 60, None, 1.0)])
    pairs = interval_join(left, right, key="user_id", time="ts", seconds=3600).collect()
    assert sorted((r.event_id, r.before_event_id) for r in pairs) == [(1, 11), (1, 12), (2, 12)]


def test_sessions_and_top(spark):
    rows = events(spark, [(1, 0, 1, 1.0), (2, 60, 1, 2.0), (3, 121, 1, 2.0), (4, 0, 2, 1.0)])
    assert sorted(r.n_events for r in sessions(rows, key="user_id", time="ts", gap="1 hour").collect()) == [1, 1, 2]
    top = top_per_group(rows, ["user_id"], [rows["value"].desc(), rows["event_id"]], 1).collect()
    assert sorted(r.event_id for r in top) == [2, 4]


def test_streams(spark, tmp_path):
    rows = [(1, 0, 1, 1.0), (2, 5, 1, 2.0), (2, 6, 1, 2.0), (3, 70, 1, 4.0), (4, 300, 1, 1.0)]
    events(spark, rows).write.parquet(f"{tmp_path}/in/a")
    late = [(5, 10, 1, 9.0), (6, 301, 1, 1.0)]  # the first is behind the watermark

    def run(make, name):
        source = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in/*")
        query = make(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.processAllAvailable()
        if name == "counts":
            events(spark, late).write.parquet(f"{tmp_path}/in/b")
            query.processAllAvailable()
        query.stop()
        return spark.table(name).collect()

    counts = run(lambda s: windowed_counts(s, time="ts", size="1 hour"), "counts")
    assert sorted((r.n, r.total) for r in counts) == [(1, 4.0), (3, 5.0)]
    once = run(lambda s: deduplicated(s, keys=["event_id"], time="ts"), "once")
    assert sorted(r.event_id for r in once) == [1, 2, 3, 4, 5, 6]
