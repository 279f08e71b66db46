"""Joins and groupings along time that Spark SQL has no single operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def time_bucket(time: str, seconds: int) -> Column:
    """Which stretch of ``seconds`` a time is in; a key's rows are then many groups, not one."""
    return F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds)


def asof_join(left: DataFrame, right: DataFrame, *, key: str, time: str, order: str, values: list[str], seconds: int = 86_400) -> DataFrame:
    """Each left row with ``values`` of the last right row of its key at or before its time.

    Both sides are one union in one window by key and stretch of ``seconds``: no pairs, and a
    key with very many rows is many groups.  Where a stretch has no earlier right row, the last
    one of the stretches before counts: one row per key and stretch carries it.  Of right rows
    of one time the greatest ``order`` counts; left rows without an earlier right row get nulls,
    and so do those whose key or time is null.  Right rows with a null key or time are left out.
    """
    right = right.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    base = left.columns
    lefts = left.select(*base, F.lit(1).alias("_side"), *(F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values), F.lit(False).alias("_has"))
    rights = right.select(*(F.col(c) if c in (key, time, order) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in base), F.lit(0).alias("_side"), *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_has"))
    both = lefts.unionByName(rights).withColumn("_bucket", time_bucket(time, seconds))
    taken = F.when(F.col("_has"), F.struct(*(F.col(f"_{v}") for v in values)))
    carried = both.groupBy(key, "_bucket").agg(F.max(F.when(F.col("_has"), F.struct(F.col(time).alias("at"), F.col(order).alias("by"), taken.alias("taken")))).alias("_m"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.last("_m.taken", ignorenulls=True).over(earlier).alias("_before"))
    before = Window.partitionBy(key, "_bucket").orderBy(time, "_side", order).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_last", F.last(taken, ignorenulls=True).over(before)).filter("_side = 1")
    found = last.join(carried, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_b")), "left").withColumn("_last", F.coalesce("_last", "_before"))
    return found.select(*base, *(F.col(f"_last._{v}").alias(f"asof_{v}") for v in values))


def numbered(df: DataFrame, *, key: str, time: str, order: str, seconds: int = 86_400) -> DataFrame:
    """Adds ``number``, from 0: the place of a row among those of its key by time, then ``order``.

    Rows are sorted by key and stretch of ``seconds``; counts of the stretches before are added.
    """
    placed = df.withColumn("_bucket", time_bucket(time, seconds))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(time, order)) - 1
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_b"))
    return placed.withColumn("_within", within).join(counts, same).withColumn("number", F.col("_start") + F.col("_within")).drop("_key", "_b", "_start", "_within", "_bucket")


def in_blocks(df: DataFrame, *, key: str, reach: int, rows: int = 100_000) -> tuple[DataFrame, WindowSpec, Column]:
    """For windows that look back ``reach`` rows: a numbered table in blocks of ``rows`` rows of
    a key, each with the ``reach`` rows before it; their window; and which rows are a block's own."""
    block = F.floor(F.col("number") / rows)
    again = F.col("number") % rows >= rows - reach
    blocked = df.withColumn("_block", F.explode(F.when(again, F.array(block, block + 1)).otherwise(F.array(block))))
    return blocked, Window.partitionBy(key, "_block").orderBy("number"), F.col("_block") == block


def interval_join(left: DataFrame, right: DataFrame, *, key: str, time: str, seconds: int, condition: Column | None = None) -> DataFrame:
    """Pairs of one key where the right row is at most ``seconds`` before the left one, not after.

    Time is cut into buckets of ``seconds``; a right row is put into its own and the next
    bucket, so that key and bucket are an equi-join and no key's rows all meet.  Columns of the
    right side get the prefix ``before_``.
    """
    bucket = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds)
    lefts = left.withColumn("_bucket", bucket)
    rights = right.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1))).select(*(F.col(c).alias(c if c in (key, "_bucket") else f"before_{c}") for c in [*right.columns, "_bucket"]))
    joined = lefts.join(rights, [key, "_bucket"])
    inside = (F.col(f"before_{time}") <= F.col(time)) & (F.col(f"before_{time}") >= F.col(time) - F.make_dt_interval(secs=F.lit(seconds)))
    return joined.filter(inside if condition is None else inside & condition).drop("_bucket")


def sessions(events: DataFrame, *, key: str, time: str, gap: str, seconds: int = 86_400) -> DataFrame:
    """Count and ends of each session: rows of a key not more than ``gap`` apart.

    Rows are put in order within stretches of ``seconds``, so a key with very many rows is many
    groups.  A stretch gives fragments: sessions as far as it shows them.  Only its first and its last one can
    go on in another stretch; these are joined along the key, two rows for each stretch.  A
    null key is a key; rows without a time are in no session.
    """
    placed = events.filter(F.col(time).isNotNull()).select(key, time).withColumn("_bucket", time_bucket(time, seconds))
    apart = F.expr(f"INTERVAL {gap}")

    def begins(at: str, before: str, order: WindowSpec) -> Column:
        last = F.lag(before).over(order)
        return F.coalesce((F.col(at) > last + apart).cast("int"), F.lit(1))

    within = Window.partitionBy(key, "_bucket").orderBy(time)
    marked = placed.withColumn("_new", begins(time, time, within)).withColumn("_part", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = marked.groupBy(key, "_bucket", "_part").agg(F.count(F.lit(1)).alias("n_events"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))
    parts = parts.withColumn("_edge", (F.col("_part") == 1) | (F.col("_part") == F.max("_part").over(Window.partitionBy(key, "_bucket"))))
    along = Window.partitionBy(key).orderBy("_bucket", "_part")
    edges = parts.filter("_edge").withColumn("_new", begins("first_ts", "last_ts", along)).withColumn("_session", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy(key, "_session").agg(F.sum("n_events").alias("n_events"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")).drop("_session")
    return joined.unionByName(parts.filter("not _edge").select(key, "n_events", "first_ts", "last_ts"))
