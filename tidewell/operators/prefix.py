"""Ranks and running sums over tables in which one key may hold most rows, or all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.shared import written


def ranked(df: DataFrame, *, keys: list[str], order: list[Column], rank: str = "rank", sums: dict[str, str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds the place of each row among those of its keys (from 1), and running sums, this row included.

    As ``row_number() OVER (PARTITION BY keys ORDER BY order)``, and for each entry of ``sums``,
    new column to column, as ``sum(column) OVER (... ROWS UNBOUNDED PRECEDING)``, but no key is
    one window.  Rows are dealt into ranges of keys and order, so a key is in as many ranges as
    it needs, and written.  A row's place in its range, less the first one of its key there,
    plus the rows of that key in the ranges before, is its rank; sums go the same way.  What
    meets in one task for a key is a row for each range.

    Null keys are a key.  Nulls in ``order`` and ``sums`` are treated as by a window.  Rows that tie in
    ``order`` get different ranks, in no certain order; as they stay in one range, ``order``
    should tell apart rows that are many.  Without ``keys``, the table is ranked as a whole.
    """
    by = [*(F.col(k) for k in keys), *order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    placed = dealt.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())  # the range, and the place in it
    placed = written(placed.withColumn("_range", F.shiftright("_at", 33)), "ranges")

    sums = sums or {}
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()))
    totals = totals.select(
        *(F.col(k).alias(f"_key_{k}") for k in keys),
        F.col("_range").alias("_of"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        *(F.sum(f"_sum_{name}").over(earlier).alias(f"_before_{name}") for name in sums),
    )
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    own = Window.partitionBy("_range", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    within = placed.select("*", *(F.sum(c).over(own).alias(f"_own_{name}") for name, c in sums.items()))
    added = {name: F.coalesce(F.col(f"_before_{name}") + F.col(f"_own_{name}"), F.col(f"_before_{name}"), F.col(f"_own_{name}")) for name in sums}
    return within.join(totals, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(rank), *(value.alias(name) for name, value in added.items()))
