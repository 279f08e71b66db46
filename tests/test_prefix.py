"""Ranks and running sums over ranges against windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators.prefix import ranked
from tidewell.sources import shared


def table(spark, n, hot=0.8):
    rng = random.Random(n)
    rows = [(i, "hot" if rng.random() < hot else rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, 1, 2, -3])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, key string, at int, value long").repartition(5)


@pytest.mark.parametrize("keys", [["key"], [], ["key", "at"]])
def test_equals_windows(spark, keys):
    rows = table(spark, 3000)
    order = [F.col("at").desc(), F.col("id")]
    window = Window.partitionBy(*keys).orderBy(*order)
    found = ranked(rows, keys=keys, order=order, rank="place", sums={"total": "value"}, ranges=16)
    assert found.columns == ["id", "key", "at", "value", "place", "total"]
    wanted = rows.select("*", F.row_number().over(window).alias("place"), F.sum("value").over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_hot_key_is_spread(spark):
    """One key holds nearly all rows; no range holds twice the mean, and no window more than a range."""
    rows = table(spark, 40_000, hot=0.99)
    with shared.tracked() as made:
        found = ranked(rows, keys=["key"], order=[F.col("at"), F.col("id")], ranges=16)
    assert found.agg(F.max("rank")).head()[0] == rows.filter("key = 'hot'").count()
    ranges = [r["count"] for r in spark.read.parquet(made[0]).groupBy("_range").count().collect()]
    assert len(ranges) >= 15 and max(ranges) < 2 * 40_000 / 16


def test_ties_get_all_ranks_and_empty(spark):
    rows = spark.createDataFrame([(1, "x")] * 50 + [(None, "x")] * 3, "id long, key string")
    assert sorted(r["rank"] for r in ranked(rows, keys=["key"], order=[F.col("id").asc_nulls_last()]).collect()) == list(range(1, 54))
    assert ranked(rows.limit(0), keys=["key"], order=[F.col("id")], sums={"s": "id"}).collect() == []


def test_tables_made_on_the_way_are_deleted(spark):
    rows = spark.range(10)
    with shared.tracked() as made:
        found = shared.alone(lambda: shared.written(rows, "a").join(shared.written(rows, "b"), "id"), "c")
    assert found.count() == 10 and len(made) == 3
    left = [p for p in made if spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    assert left == [found._written_to]
    shared.discard(found)
