"""Salted joins against plain ones."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewell.operators.salted import salted_join


def sides(spark, n=6000):
    rng = random.Random(3)
    left = [(i, 7 if i % 3 == 0 else rng.choice([None, *range(100)]), "x") for i in range(n)] + [(1, 7, "x"), (1, 7, "x")]
    right = [(k, f"r{k}") for k in [*range(0, 120, 2), 7, 7, None]]
    return spark.createDataFrame(left, "id long, key int, n string"), spark.createDataFrame(right, "key int, name string")


def test_equals_a_plain_join(spark):
    left, right = sides(spark)
    plain = sorted(map(str, left.join(right, "key").collect()))
    for options in ({}, {"rows": 100}, {"rows": 100, "most_hot": 0}, {"rows": 1}):
        found = salted_join(left, right, "key", **options)
        assert found.columns == left.join(right, "key").columns
        assert sorted(map(str, found.collect())) == plain
    counts = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(str, salted_join(left, right, "key", counts=counts, rows=50).collect())) == plain
    assert salted_join(left.limit(0), right, "key").collect() == salted_join(left, right.limit(0), "key").collect() == []


def test_hot_key_is_spread(spark):
    """A third of all rows has one key; no partition of the join holds a tenth of them."""
    left, right = sides(spark, 30_000)
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for c, v in zip(before, ("64", "false", "-1"), strict=True):
        spark.conf.set(c, v)
    try:
        largest = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).head()[0]
        joined = salted_join(left, right.dropDuplicates(["key"]), "key", rows=500)
        assert largest(left.join(right.dropDuplicates(["key"]), "key")) >= 10_000
        assert largest(joined) <= 3_500 and joined.filter("key = 7").count() == 10_000 + 2 + left.filter("key = 7 and id % 3 <> 0 and id <> 1 or key = 7 and id = 1").count() - 2
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
