"""Distinct counts by sketches that are stored once and merged to any coarser level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_sketches(df: DataFrame, *, by: list[str], of: str, bits: int = 14) -> DataFrame:
    """(by, sketch): a HyperLogLog sketch of the distinct values of ``of`` in each group; nulls don't count.

    A sketch has at most about ``2**bits`` bytes, whatever it counts; its relative error is about ``1.04 / sqrt(2**bits)``.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(of, F.lit(bits)).alias("sketch"))


def merged(sketches: DataFrame, *, by: list[str]) -> DataFrame:
    """(by, sketch): the sketches of coarser groups; merging in steps or at once, in any order, tells the same."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame, name: str) -> DataFrame:
    """The groups with the estimated number of distinct values as column ``name``."""
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")


def levels(sketches: DataFrame, *, by: list[str], name: str) -> DataFrame:
    """Estimates for each prefix of ``by``, the whole included; columns beyond the prefix are null."""
    out = estimated(sketches.select(*by, "sketch"), name)
    finer = sketches
    for n in reversed(range(len(by))):
        finer = merged(finer, by=by[:n])
        out = out.unionByName(estimated(finer, name), allowMissingColumns=True)
    return out
