"""JSON columns of a known schema, and maps made by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows with ``column`` as a typed struct, and apart those whose JSON is malformed or of other types.

    The second table keeps the JSON as it came.  Null JSON gives a null struct, and a field
    that isn't there a null; both are in the first table.
    """
    typed = F.from_json(column, f"{schema}, _malformed STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    read = df.withColumn("_read", typed)
    bad = F.col("_read._malformed").isNotNull()
    fields = df.sparkSession.createDataFrame([], schema).columns
    struct = F.when(F.col(column).isNotNull(), F.struct(*(F.col("_read")[f].alias(f) for f in fields)))
    good = read.filter(~F.coalesce(bad, F.lit(False))).withColumn(column, struct).drop("_read")
    return good, read.filter(bad).drop("_read")


def map_sums(df: DataFrame, *, by: list[str], entry: str, value: str, name: str) -> DataFrame:
    """(by, name): a map from each ``entry`` of the group to the sum of its ``value``; null entries have none.

    Entries are summed before they are gathered, so a map holds a group's distinct entries only.
    """
    sums = df.filter(F.col(entry).isNotNull()).groupBy(*by, F.col(entry).alias("_entry")).agg(F.sum(value).alias("_sum"))
    return sums.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_entry", "_sum")))).alias(name))
