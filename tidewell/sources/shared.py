"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Lists that get each new path, of this thread and context only.
_TRACKS: ContextVar[tuple[list[str], ...]] = ContextVar("tracks", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a local one, for local sessions (tests) only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-tidewell-"))
    return _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    path = f"{shared_folder(spark)}/tidewell-{name}-{uuid.uuid4().hex}"
    for track in _TRACKS.get():
        track.append(path)
    return path


@contextmanager
def tracked() -> Iterator[list[str]]:
    """A list that gets the paths made meanwhile, but for those that other threads make."""
    made: list[str] = []
    token = _TRACKS.set((*_TRACKS.get(), made))
    try:
        yield made
    finally:
        _TRACKS.reset(token)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders; those that are gone already don't matter."""
    context = spark.sparkContext
    for name in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: survives lost executors, computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no later result reads."""
    for table in tables:
        remove(table.sparkSession, table._written_to)


def alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``make`` gives, written; all tables made on the way to it are deleted."""
    with tracked() as made:
        df = make()
    found = written(df, name)
    remove(found.sparkSession, *made)
    return found
