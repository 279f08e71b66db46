"""Running a stream over all that its source has now, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.sources.shared import new_path, remove


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What the stream appends until its source is used up, as a table in the shared folder.

    The checkpoint, which lies there as well, is deleted at the end.  Rows that wait for the watermark are not appended.
    """
    spark = stream.sparkSession
    path = new_path(spark, name)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    remove(spark, f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
