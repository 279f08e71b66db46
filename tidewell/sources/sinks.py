"""Writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, by: list[str], rows: int = 5_000_000) -> None:
    """Writes ``df`` as Parquet under ``path``, a folder for each value of ``by``; running it again changes nothing.

    Folders of the values that ``df`` holds are replaced as a whole, once all are written, and
    others stay.  A value's rows go to one task, or to several by a hash of the row where there are more than ``rows``.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    most = counts.agg(F.max("_rows")).head()[0] or 0
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(max(1, -(-most // rows))))
    df.repartition(*by, salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
