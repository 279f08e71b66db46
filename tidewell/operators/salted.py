"""Equi-joins on keys of which a few may hold a large part of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, key: str, *, counts: DataFrame | None = None, rows: int = 50_000, most_hot: int = 100_000) -> DataFrame:
    """The inner join of both on ``key``, in which no task gets much more than ``rows`` left rows of one key.

    Keys with more left rows than that are hot: their left rows are dealt over as many salts as
    they need, by a hash of the whole row, and their right rows are repeated for each salt.
    ``counts`` has ``key`` and ``n``, the left rows of each key, where that is known.  There are
    at most a ``rows``-th as many hot keys as left rows; up to ``most_hot`` of them are
    broadcast, more are joined as Spark chooses.  Null keys match nothing, as in any join;
    left rows that repeat wholly stay together.
    """
    known = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.select(key, "n")
    hot = known.filter((F.col("n") > rows) & F.col(key).isNotNull()).select(F.col(key).alias("_hot"), F.ceil(F.col("n") / rows).cast("int").alias("_salts"))
    hot = F.broadcast(hot) if hot.count() <= most_hot else hot
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("_hot", "_salts")
    repeated = right.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hot", "_salts")
    return dealt.join(repeated, [key, "_salt"]).drop("_salt")
