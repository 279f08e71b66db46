"""Event streams: windows and sessions with late data, deduplication and joins with bounded state.

Watermarks need points in time.  Times without a zone are taken as UTC, whatever the session's
zone, and given back the same way, so a stream's result depends on no setting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def instant(time: Column) -> Column:
    """The point in time of a time without a zone, taken as UTC."""
    days, seconds = F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("long"), F.date_part(F.lit("SECOND"), time)
    whole = (days * 86_400 + F.hour(time) * 3600 + F.minute(time) * 60) * 1_000_000
    return F.timestamp_micros(whole + (seconds * 1_000_000).cast("long"))


def zoneless(time: Column) -> Column:
    """The time in UTC of a point in time, without a zone."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.unix_micros(time).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def timed(events: DataFrame, time: str, late: str) -> tuple[DataFrame, list[str]]:
    """The events with a watermark, and the names of the columns that had no zone."""
    bare = isinstance(events.schema[time].dataType, T.TimestampNTZType)
    at = instant(F.col(time)) if bare else F.col(time).cast("timestamp")
    return events.withColumn(time, at).withWatermark(time, late), [time] if bare else []


def windowed_counts(events: DataFrame, *, time: str, size: str, slide: str | None = None, late: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """Rows and their summed ``value`` in time windows; the watermark bounds the state.

    Works on streams and tables alike; rows without a time are in no window.
    """
    marked, bare = timed(events, time, late)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    back = zoneless if bare else lambda c: c
    counts = marked.groupBy(window.alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(back(F.col("w.start")).alias("start"), back(F.col("w.end")).alias("end"), *(by or []), "n", "total")


def session_counts(events: DataFrame, *, key: str, time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Count and ends of each session: rows of a key not more than ``gap`` apart.

    A session is given out when the watermark passes its last row by ``gap``; rows that come later than ``late`` are in none.
    """
    marked, bare = timed(events, time, late)
    back = zoneless if bare else lambda c: c
    found = marked.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))
    return found.select(key, "n_events", back(F.col("first_ts")).alias("first_ts"), back(F.col("last_ts")).alias("last_ts"))


def deduplicated(events: DataFrame, *, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    marked, bare = timed(events, time, late)
    once = marked.dropDuplicatesWithinWatermark(keys)
    return once.withColumn(time, zoneless(F.col(time))) if bare else once


def interval_joined(left: DataFrame, right: DataFrame, *, key: str, time: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Pairs of one key where the right row is at most ``seconds`` before the left one, not after; both sides are streams.

    A pair is given out when its second row comes.  A left row is kept until the watermark
    passes it, and a right one for ``seconds`` more.  Columns of the right side get the prefix
    ``before_``.
    """
    lefts, bare = timed(left, time, late)
    rights, _ = timed(right, time, late)
    rights = rights.select(*(F.col(c).alias(f"before_{c}") for c in rights.columns))
    inside = (F.col(f"before_{time}") <= F.col(time)) & (F.col(f"before_{time}") >= F.col(time) - F.make_dt_interval(secs=F.lit(seconds)))
    pairs = lefts.join(rights, (F.col(key) == F.col(f"before_{key}")) & inside).drop(f"before_{key}")
    return pairs.withColumns({c: zoneless(F.col(c)) for c in (time, f"before_{time}")}) if bare else pairs
