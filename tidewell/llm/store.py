"""Helpers on written tables and on tables with columns of any name."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is written meanwhile: rows that hold whole texts need much memory."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def small(table: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``table``, to be broadcast if it has at most ``most_rows`` rows (counted), else to be joined as Spark chooses."""
    return F.broadcast(table) if table.count() <= most_rows else table


class Carried:
    """A table under neutral column names, so that its columns clash with no working column."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.kept = [f"_c{i}" for i in range(len(self.names))]
        self.frame = df.toDF(*self.kept)

    def of(self, name: str) -> str:
        """The neutral name of a column."""
        return self.kept[self.names.index(name)]

    def back(self, df: DataFrame, **changed: Column) -> DataFrame:
        """The table's own columns and names, some with other values."""
        return df.select(*(changed.get(n, F.col(c)).alias(n) for n, c in zip(self.names, self.kept, strict=True)))
